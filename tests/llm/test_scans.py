"""Language ID, token counts and license scan."""

import random
import re
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from rillflow.llm import langid, licenses, tokens
from rillflow.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_language_of_pages(spark):
    folder = "/root/testdata/sf0.01"
    res = {r["page_id"]: r for r in QUERIES["op1_language_id"](spark, folder).collect()}
    pages = duckdb.sql(f"select page_id, url, html from '{folder}/pages.parquet'").fetchall()
    assert set(res) == {p for p, _, _ in pages}
    right = sum(res[p]["lang"] == re.search(r'lang="(..)"', h)[1] for p, _, h in pages)
    assert right >= 0.97 * len(pages), right
    assert all(0 < r["confidence"] <= 1 for r in res.values())


def test_held_out_text_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs.where("doc_id % 2 = 0"))
    rest = docs.where("doc_id % 2 = 1").withColumn("n_chars", F.col("lang")).withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit(None).cast("string"))
    res = {r["doc_id"]: r["lang"] for r in langid.identify_documents(rest, model).collect()}
    want = {r["doc_id"]: r["n_chars"] for r in rest.collect()}
    assert sum(res[d] == want[d] for d in want) >= 0.97 * len(want)


def test_evidence_fuses(spark):
    rng = random.Random(2)
    vowels = {"aa": "abcde", "bb": "mnopq"}
    word = lambda l: "".join(rng.choice(vowels[l]) for _ in range(5))
    docs = [(i, " ".join(word(l) for _ in range(40)), l, "s", 0) for i, l in enumerate(["aa", "bb"] * 30)]
    model = langid.fit(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"))
    assert model.languages == ["aa", "bb"]
    page = lambda l, t: f'<html lang="{l}"><script>{word("aa")} </script><p>{t}</p></html>'
    pages = [(i, f"http://x.{l}site.org/{l}/{i}", page(l, " ".join(word(l) for _ in range(30)))) for i, l in enumerate(["aa", "bb"] * 40)]
    odd = [(1000, "http://x.aasite.org/aa/q", page("aa", "zz")), (1001, "http://x.bbsite.org/q", "zz"), (1002, None, None), (1003, "http://x.bbsite.org/bb/9", page("bb", " ".join(word("aa") for _ in range(30)))), (None, "http://x.bbsite.org/bb/9", page("bb", "")), (None, "http://x.bbsite.org/bb/9", page("bb", ""))]
    df = spark.createDataFrame([(*r, "h", "d") for r in pages + odd], "page_id long, url string, html string, host string, declared string")
    rows = langid.identify_pages(df, model).collect()
    assert len(rows) == len(pages) + len(odd)
    res = {r["page_id"]: r for r in rows}
    assert all(res[p]["lang"] == u[7 + 2 : 7 + 4] for p, u, _ in pages)
    assert res[1000]["lang"] == "aa" and res[1001]["lang"] == "bb" and res[1003]["lang"] == "aa" and res[None]["lang"] == "bb"
    assert res[1000]["confidence"] > 0.9 and res[1002]["confidence"] < 0.9
    assert langid.identify_pages(df.limit(0), model).count() == 0
    empty = langid.fit(df.limit(0).select(F.col("html").alias("text"), F.col("url").alias("lang")))
    assert {r["lang"] for r in langid.identify_pages(df, empty).collect()} == {None}


def test_declared_language_of_pages(spark):
    pages = ['<html lang="fr">', "<HTML class=x LANG=de-AT>", '<html xml:lang="es">', '<meta http-equiv="content-language" content="it">', "<meta name=a content=b><META content='pt-BR' http-equiv=Content-Language>", "<p lang=en>", None, '<html xml:lang="nl" lang="da">', '<meta name="x" content="en">']
    rows = spark.createDataFrame([(i, None, p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    got = {r["page_id"]: r["declared"] for r in langid.page_evidence(rows).collect()}
    assert got == dict(enumerate(["fr", "de", "es", "it", "pt", "", "", "da", ""]))


def test_posterior_against_a_recomputation(spark):
    """All sums and products of the fusion once more, row by row in Python, from the text likelihoods."""
    rng = random.Random(3)
    docs = [(i, " ".join("".join(rng.choice(a) for _ in range(4)) for _ in range(30)), l, "s", 0) for i, (l, a) in enumerate([("aa", "abcdef"), ("bb", "defghi"), ("cc", "ghijkl")] * 20)]
    model = langid.fit(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"))
    rows = []
    for i in range(150):
        a = rng.choice(["abcdef", "defghi", "ghijkl", "adgjl"])
        host = rng.choice(["w.x.org", "v.x.org", "y.net", "", None])
        rows.append((i, host, {"w.x.org": "x.org", "v.x.org": "x.org"}.get(host, host), rng.choice(["aa", "bb", "cc", "", None]), rng.choice(["aa", "zz", ""]), " ".join("".join(rng.choice(a) for _ in range(3)) for _ in range(rng.choice([0, 1, 2, 9])))))
    rows.append((900, "y.net", "y.net", "aa", "", "abcdef " * 60_000))
    df = spark.createDataFrame(rows, "id long, host string, domain string, declared string, suffix string, text string")
    ll = {r["id"]: np.array(r["ll"]) for r in langid.text_evidence(df.select("id", "text"), model, "text").collect()}
    post = {i: np.exp(x) / np.exp(x).sum() for i, x in ll.items()}
    row = {r[0]: [x or "" for x in r[1:5]] for r in rows}
    whole = sum(post.values())
    prior = (whole + 0.5) / (whole + 0.5).sum()
    for r in langid.fused(df, model, "id", "text").collect():
        i = r["id"]
        host, domain, declared, suffix = row[i]
        score = ll[i].copy()
        for c, value in ((2, declared), (3, suffix)):
            same = sum(post[j] for j in row if row[j][c] == value)
            score += np.log((same + 0.5) / (whole + 0.5 * len({x[c] for x in row.values()})))
        smoothed = prior
        for level in (lambda x: x[1] == domain, lambda x: x[0] == host and x[1] == domain):
            own = np.maximum(sum(post[j] for j in row if level(row[j])) - post[i], 0)
            smoothed = (own + 5 * smoothed) / (own.sum() + 5)
        score += np.log(smoothed)
        want = np.exp(score - score.max())
        assert r["lang"] == model.languages[int(score.argmax())] and abs(r["confidence"] - 1 / want.sum()) < 1e-6


def test_token_counts(spark, sf):
    enc = tokens.encoder()
    docs = duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall()
    got = {r["doc_id"]: r["n_tokens"] for r in QUERIES["op4_token_counts"](spark, sf).collect()}
    assert got == {d: len(enc.encode_ordinary(t or "")) for d, t in docs}


@pytest.mark.parametrize("block_bytes", [2, 6, 34, 1 << 20])
def test_scan_stitches_blocks(spark, tmp_path, block_bytes):
    rng = np.random.default_rng(4)
    want = {}
    for name, lengths, tail in (("a", [0, 0, 3, 50, 1, 0, 17], 0), ("b", [], 9), ("c", [4, 4], 2), ("d", [120], 0), ("e", [], 0)):
        ids = []
        for n in lengths:
            ids += [*rng.integers(0, 50000, n), tokens.END]
        ids += [*rng.integers(0, 50000, tail)]
        (tmp_path / f"{name}.tok").write_bytes(np.array(ids, "<u2").tobytes())
        want |= {(f"{name}.tok", k): n for k, n in enumerate(lengths + [tail] * (tail > 0))}
    got = {(r["file"], r["ordinal"]): r["n_tokens"] for r in tokens.scan_token_files(spark, str(tmp_path), block_bytes=block_bytes).collect()}
    assert got == want


@pytest.mark.parametrize("segment", [2, 3])
def test_scan_of_one_large_file_in_segments(spark, tmp_path, monkeypatch, segment):
    """Blocks of 32 bytes, segments of a few blocks, and documents that cross several of both."""
    rng = np.random.default_rng(6)
    lengths = [int(x) for x in rng.choice([0, 1, 5, 15, 16, 40, 200], 120)]
    ids = [x for n in lengths for x in (*rng.integers(0, 50000, n), tokens.END)]
    (tmp_path / "a.tok").write_bytes(np.array(ids, "<u2").tobytes())
    monkeypatch.setattr(tokens, "SEGMENT", segment)
    got = {r["ordinal"]: r["n_tokens"] for r in tokens.scan_token_files(spark, str(tmp_path), block_bytes=32).collect()}
    assert got == dict(enumerate(lengths))


def test_leftover_files_are_not_read(spark, tmp_path):
    df = spark.createDataFrame([(i, "some words " * i) for i in range(9)], "doc_id long, text string")
    order = tokens.write_token_files(df, str(tmp_path))
    (tmp_path / "killed.tok").write_bytes(b"abc")
    got = order.join(tokens.scan_token_files(spark, str(tmp_path), order), ["file", "ordinal"])
    enc = tokens.encoder()
    assert {r["id"]: r["n_tokens"] for r in got.collect()} == {i: len(enc.encode_ordinary("some words " * i)) for i in range(9)}
    with pytest.raises(Exception, match="no whole number of ids"):
        tokens.scan_token_files(spark, str(tmp_path)).collect()


def test_vocabularies_that_do_not_fit(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    for end in (100, 70_000):
        with pytest.raises(ValueError, match="ids go up to"):
            tokens.write_token_files(df, str(tmp_path), end=end)


def test_token_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "<|endoftext|> x"), (3, "a " * 50_000), (3, "b"), (3, "b")]
    df = spark.createDataFrame([(*r, "f", 0) for r in rows], "doc_id long, text string, file string, ordinal long")
    enc = tokens.encoder()
    assert sorted(r["n_tokens"] for r in tokens.token_counts(df).collect()) == sorted(len(enc.encode_ordinary(t or "")) for _, t in rows)
    assert tokens.token_counts(df.limit(0)).count() == 0


def test_long_runs_are_split_where_it_changes_nothing():
    enc = tokens.encoder()
    rng = random.Random(4)
    with open(tokens.VOCABULARY, "rb") as f:
        short = tokens.Encoder({__import__("base64").b64decode(a): int(b) for a, b in map(bytes.split, f)}, 2)
    for _ in range(3_000):
        text = "".join(rng.choice([" ", "\n", "\u00a0", "\t", "\u3000"]) * rng.choice([1, 1, 2, 3, 9]) if rng.random() < 0.6 else rng.choice(["a", "it's", "12", "!?", "é", "\x1c"]) for _ in range(rng.randrange(12)))
        assert short.encode_ordinary(text) == enc.plain(text), repr(text)
    for run in (" ", "\n", " \n\t"):
        for text in (run * 30_000, "a" + run * 30_000, run * 30_000 + "b", "a" + run * 30_000 + "b c"):
            assert enc.encode_ordinary(text) == enc.plain(text)


def test_texts_that_never_end(spark):
    """Runs that the pattern alone can't take, through the whole operator."""
    texts = ["a" + " " * 5_000_000 + "b", "x" * 1_000_000, "!" * 1_000_000, "a" + " \n\t\u00a0" * 250_000 + "b", "\n" * 1_000_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.token_counts(df).collect()}
    enc = tokens.encoder()
    assert got[0] == len(enc.plain("a")) + len(enc.whole(" " * 4_999_999)) + len(enc.plain(" b"))
    assert got[1] == len(enc.plain("x" * 1_000_000)) and got[2] == len(enc.plain("!" * 1_000_000))
    assert got[3] == 1 + len(enc.whole((" \n\t\u00a0" * 250_000)[:-1])) + len(enc.plain("\u00a0b")) and got[4] == len(enc.whole("\n" * 1_000_000))


MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "".join(map(chr, range(0x2000, 0x2040)))


def sequence(text):
    """Shingles of the words that count: without marks at their ends, and not of marks only."""
    w = [x.strip(MARKS) for x in WORD.findall((text or "").translate(UPPER))]
    w = [x for x in w if x]
    return [tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))] if w else []


def brute_licenses(docs, templates, least=0.75):
    """Best containment of passages of 2**c shingles, from every start."""
    seqs = [(d, sequence(t)) for d, t in docs]
    out = {}
    for name, t in templates.items():
        own = set(sequence(t))
        w = 1 << (len(own) - 1).bit_length()
        for d, seq in seqs:
            if len(own.intersection(seq)) < least * len(own):
                continue
            hits = [i for i, x in enumerate(seq) if x in own]
            best = max(len(own & set(seq[s : s + w])) / len(own) for s in hits)
            if best >= least:
                out[d, name] = best
    return out


def test_license_query(spark):
    folder = "/root/testdata/sf0.01"
    docs = duckdb.sql(f"select doc_id, text from '{folder}/documents.parquet'").fetchall()
    got = {(r["doc_id"], r["template"]): r["containment"] for r in QUERIES["op7_license_scan"](spark, folder).collect()}
    assert got == brute_licenses(docs, licenses.TEMPLATES) and len(got) >= 30


def test_license_planted(spark):
    rng = random.Random(8)
    docs = [(1, None), (2, ""), (3, "Released under the MIT License.")]
    for i, t in enumerate(list(licenses.TEMPLATES.values()) * 8):
        w = t.split()
        for _ in range(i % 4):
            w[rng.randrange(len(w))] = "changed"
        docs.append((10 + i, " ".join([f"x{k}" for k in range(rng.randrange(300))] + w + ["end"] * rng.randrange(5))))
    docs.append((9000, "y " * 60_000 + licenses.TEMPLATES["MIT"]))
    df = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, template string, start long")
    rows = licenses.license_hits(df).collect()
    want = brute_licenses(docs, licenses.TEMPLATES)
    texts = dict(docs)
    for r in rows:
        own, seq = set(sequence(licenses.TEMPLATES[r["template"]])), sequence(texts[r["doc_id"]])
        assert seq[r["start"]] in own and len(own.intersection(seq[r["start"] : r["start"] + r["n_words"] - 4])) / len(own) == r["containment"]
    best = {(r["doc_id"], r["template"]): r["containment"] for r in rows if r["rival"] is None}
    assert {(r["doc_id"], r["template"]) for r in rows} == set(want) and all(want[x] == best[x] for x in best)
    as_table = spark.createDataFrame([*licenses.TEMPLATES.items(), ("none", None)], "name string, text string")
    assert sorted(licenses.license_hits(df, as_table).collect(), key=str) == sorted(rows, key=str)
    assert licenses.license_hits(df, {}).count() == 0 and licenses.license_hits(df.limit(0)).count() == 0


def test_license_lines_of_the_corpus(spark):
    """The lines are found by regular expression, not by the templates."""
    docs = duckdb.sql("select doc_id, text from '/root/testdata/sf0.01/documents.parquet'").fetchall()
    lines = {"Apache-2.0 line": r"Apache License,? Version 2", "GPL-3.0 line": r"General Public License,? version 3", "GPL-2.0 line": r"General Public License,? version 2", "MIT line": r"under the MIT License", "CC-BY-NC-4.0 line": r"under CC BY-NC 4"}
    want = {(d, name) for d, t in docs for name, line in lines.items() if re.search(line, t or "")}
    rows = QUERIES["op7_license_scan"](spark, "/root/testdata/sf0.01").collect()
    assert {n for _, n in want} >= {"Apache-2.0 line", "GPL-3.0 line"}
    assert {(r["doc_id"], r["template"]) for r in rows if r["rival"] is None} == want


def test_license_punctuation_and_versions(spark):
    gpl = "This work is licensed under the GNU General Public License, version"
    pad = " ".join(f"p{i}" for i in range(200))
    texts = [f'# "Licensed under the Apache License - Version 2.0!', "(Released under the \u201cMIT\u201d License);", f"{gpl} 2.", f"{gpl} 3,", f"{gpl} 2. {pad} {gpl} 3."]
    texts += [" ".join(f"q{i}" for i in range(n)) + f" {gpl} 3. {pad}" for n in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in licenses.license_hits(df).where("rival is null").collect():
        got.setdefault(r["doc_id"], set()).add(r["template"])
    want = [{"Apache-2.0 line"}, {"MIT line"}, {"GPL-2.0 line"}, {"GPL-3.0 line"}, {"GPL-2.0 line", "GPL-3.0 line"}] + [{"GPL-3.0 line"}] * 20
    assert got == dict(enumerate(want))


def test_many_templates_are_prepared_fast():
    """5,000 templates with siblings among them, against all pairs on a part."""
    rng = random.Random(12)
    words = [f"w{i}" for i in range(3_000)]
    texts = {}
    for i in range(5_000):
        if i % 5 == 4:
            w = texts[f"t{i - 1}"].split()
            w[rng.randrange(len(w))] = "changed"
            texts[f"t{i}"] = " ".join(w)
        else:
            texts[f"t{i}"] = "common words of all licenses here " + " ".join(rng.choice(words) for _ in range(rng.randrange(60, 300)))
    start = time.time()
    prepared = licenses._prepared(texts, licenses.BANDS)
    found = licenses._rivals(prepared, 0.75)
    assert time.time() - start < 20
    assert len(found) >= 1_900
    some = prepared[:300]
    want = {}
    for a in some:
        near = sorted(b[0] for b in some if a[0] != b[0] and len(np.intersect1d(a[2], b[2])) >= 0.75 * max(len(a[2]), len(b[2])))
        if near:
            want[a[0]] = near
    assert {k: sorted(n for n, _ in v) for k, v in licenses._rivals(some, 0.75).items()} == want
