"""Sharding, quality rules, archive and chat formatting against brute force."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from rillflow.llm import chat, quality, sharding, warc
from rillflow.llm.queries import ORACLES, QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = "doc_id long, text string, lang string, source string, n_chars long, shard int, slot long, n_words string"


def odd_docs(spark):
    long = " ".join(f"w{i % 900}" for i in range(30_000))
    rows = [(1, None, "en", None), (2, "", None, "a"), (3, " \n\t ", "en", "a"), (None, "a b c a b c", "en", "a"), (4, long, "fr", "b")]
    rows += [(5, "same text here", "en", "a")] * 3 + [(6, "same text here", "en", "a")]
    return spark.createDataFrame([(*r, 0, 9, 9, "x") for r in rows], ODD)


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def read(sf, name):
    con = duckdb.connect()
    cur = con.execute(f"select * from '{sf}/{name}.parquet'")
    names = [c[0] for c in cur.description]
    return [dict(zip(names, r)) for r in cur.fetchall()]


def test_sharding_is_exact_and_gapless(spark, sf):
    got = rows_of(QUERIES["op2_sharding"](spark, sf))
    docs = {d["doc_id"]: d["text"] for d in read(sf, "documents")}
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    sizes = Counter(r["shard"] for r in got)
    assert set(sizes) == set(range(16)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n))
    for r in got:
        data = (docs[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(data) + 1, zlib.crc32(data))
    again = {r["doc_id"]: (r["shard"], r["slot"]) for r in rows_of(QUERIES["op2_sharding"](spark, sf))}
    assert again == {r["doc_id"]: (r["shard"], r["slot"]) for r in got}


def test_sharding_draws_follow_the_exact_law(spark):
    """Chi-square of 20,000 draws against the probabilities themselves, for a small and a skewed case."""
    for total, good, n in ((11, 6, 5), (40, 3, 25), (30, 28, 7)):
        got = Counter(r[0] for r in spark.range(20_000).select(F.expr(sharding._draw(f"{total}L", f"{good}L", f"{n}L", "rand(5)"))).collect())
        law = {x: math.comb(good, x) * math.comb(total - good, n - x) / math.comb(total, n) for x in range(max(0, n + good - total), min(n, good) + 1)}
        assert set(got) <= set(law)
        common = [x for x in law if law[x] * 20_000 >= 5]
        assert sum((got[x] - 20_000 * law[x]) ** 2 / (20_000 * law[x]) for x in common) < 30


def test_sharding_matrix_sums_and_law(spark):
    counts = spark.createDataFrame([(b, 10 + b % 7) for b in range(500)], "block long, n long")
    total = sum(10 + b % 7 for b in range(500))
    sizes = [total // 5 + (s < total % 5) for s in range(5)]
    m = {r["block"]: r["sent"] for r in sharding.communication_matrix(counts, sizes, 9, 3).collect()}
    assert [sum(m[b][s] for b in m) for s in range(5)] == sizes
    assert all(sum(m[b]) == (10 + b % 7 if b < 500 else 0) for b in m)
    square = []
    for b in range(500):
        n = 10 + b % 7
        for s in range(5):
            p = sizes[s] / total
            square.append((m[b][s] - n * p) ** 2 / (n * p * (1 - p) * (total - n) / (total - 1)))
    assert abs(sum(square) / len(square) - 1) < 0.12, "the mean of 2,500 squared deviations, by the exact variance of each"


def test_sharding_scatters_copies_and_one_key(spark):
    """Each row twice: pairs meet in one shard and as neighbours as often as chance has it; null keys and a hot key go everywhere."""
    rows = [(i, f"text {i}") for i in range(4000) for _ in (0, 1)] + [(None, "none")] * 3000 + [(-1, "hot")] * 3000
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = rows_of(sharding.shuffle_to_shards(docs, 16, rows_per_range=100))
    where = {}
    for r in got:
        where.setdefault(r["doc_id"], []).append((r["shard"], r["slot"]))
    pairs = [where[i] for i in range(4000)]
    same = sum(a[0] == b[0] for a, b in pairs)
    assert abs(same - 250) < 5 * 15.3
    assert sum(a[0] == b[0] and abs(a[1] - b[1]) == 1 for a, b in pairs) <= 5
    for hot in (None, -1):
        shards = Counter(s for s, _ in where[hot])
        assert len(shards) == 16 and max(shards.values()) < 3000 / 16 * 1.5
        slots = sorted(x for s, x in where[hot] if s == 0)
        assert slots[0] < 60 and slots[-1] > 14000 / 16 - 60
    order = [r["doc_id"] for r in sorted(got, key=lambda r: (r["shard"], r["slot"])) if r["doc_id"] not in (None, -1)]
    up = sum(a < b for a, b in zip(order, order[1:]))
    assert abs(up - len(order) / 2) < 5 * math.sqrt(len(order) / 12)


def test_sharding_sends_whole_rows_once(spark, sf):
    plan = QUERIES["op2_sharding"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert sum("hashpartitioning" in line and "text" in line for line in plan.split("\n")) <= 1
    assert "Python" not in plan and "Arrow" not in plan


def test_sharding_odd_rows(spark):
    docs = odd_docs(spark)
    got = rows_of(sharding.shuffle_to_shards(docs, 4))
    assert len(got) == docs.count() and sorted(Counter(r["shard"] for r in got).values()) == [2, 2, 2, 3]
    assert sharding.shuffle_to_shards(docs.limit(0), 4).count() == 0
    clash = docs.select(*docs.columns[:5], *[F.lit(i).alias(c) for i, c in enumerate(("number", "order", "block", "rank", "sent", "part", "begin", "Slot", "n", "held", "__rank", "a.b"))])
    rows = rows_of(sharding.shuffle_to_shards(clash, 4))
    assert len(rows) == docs.count() and {(r["number"], r["order"], r["begin"], r["n"], r["held"], r["__rank"], r["a.b"]) for r in rows} == {(0, 1, 6, 8, 9, 10, 11)}
    assert sorted(set(rows[0]) - set(clash.columns)) == ["shard", "slot"] and "Slot" not in rows[0]
    long = spark.createDataFrame([(i, "x" * (3_000_000 if i == 5 else 3)) for i in range(40)], "doc_id long, text string")
    assert sorted(len(r["text"]) for r in rows_of(sharding.shuffle_to_shards(long, 3)))[-2:] == [3, 3_000_000]


def brute_quality(text):
    w = WORD.findall(text or "")
    c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {i + k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(text.count(x) for x in "#*$%&|<>") if text else 0, len(lines) - len(set(lines)), len(hit)


def test_quality_counts(spark, sf):
    texts = {d["doc_id"]: d["text"] for d in read(sf, "documents")}
    got = rows_of(QUERIES["op5_quality_rules"](spark, sf))
    assert len(got) == len(texts)
    for r in got:
        want = brute_quality(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["base_failed"] and r["kept"])


def test_quality_odd_rows(spark):
    docs = odd_docs(spark)
    got = rows_of(quality.judged(docs))
    assert len(got) == docs.count()
    want = Counter(brute_quality(r["text"]) for r in rows_of(docs))
    assert Counter((r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == want
    assert quality.judged(docs.limit(0)).count() == 0


def test_quality_fence_finds_outliers(spark):
    clean = [(i, " ".join(f"wor{(i * 7 + k * (k + i)) % 1009}d" for k in range(80)), "en", f"s{i % 2}", 0) for i in range(300)]
    junk = [(1000 + i, " ".join(f"### w{(i + k * k) % 997} $$$" for k in range(80)), "en", "s0", 0) for i in range(5)]
    docs = spark.createDataFrame(clean + junk, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in rows_of(quality.judged(docs)) if r["kept"]}
    assert kept == set(range(300))


def spread_docs(spark):
    """Two sources of 700 documents with little and much spread in all four rates, one of 12, and outliers for the first."""
    rng = random.Random(31)
    rows = []

    def add(source, chars, symbols, dups, repeats, lang="en"):
        lines = [" ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(chars)) for _ in range(12)) for _ in range(20)]
        lines += [lines[0]] * dups + ["# " * symbols]
        lines += [f"again and {i} again and {i} again and {i} again" for i in range(repeats)]
        rows.append((len(rows), "\n".join(lines), lang, source, 0))

    for _ in range(700):
        add("calm", rng.choice([5, 5, 5, 6]), rng.choice([0, 0, 0, 1]), 0, 0)
        add("wild", rng.choice([4, 5, 6, 7, 9]), rng.choice([0, 5, 20, 40]), rng.choice([0, 2, 6, 12]), rng.choice([0, 2, 5, 9]))
    for _ in range(12):
        add("rare", 5, 0, 0, 0, rng.choice(["en", None]))
    for x in ((16, 0, 0, 0), (5, 60, 0, 0), (5, 0, 16, 0), (5, 0, 0, 9)):
        add("calm", *x)
        add("wild", *x)
    rows.extend([(9000, None, None, None, 0), (9001, "", "en", "calm", 0)])
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_quality_sql_with_large_groups(spark, tmp_path):
    """Groups far larger than PRIOR, so that a group's own quantiles decide."""
    spread_docs(spark).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    cur = con.execute(ORACLES["op5_quality_rules"])
    names = [c[0] for c in cur.description]
    want = sorted(cur.fetchall(), key=str)
    got = QUERIES["op5_quality_rules"](spark, str(tmp_path)).select(names).collect()
    assert sorted(map(tuple, got), key=str) == want and 1300 <= sum(r["kept"] for r in got) < len(got)


def test_quality_of_few_repeated_lines(spark):
    """Where most documents repeat no line, ten repeated lines count by the length of the document, and one that repeats most of its lines fails."""
    rng = random.Random(5)
    line = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(3))
    texts = ["\n".join(line() for _ in range(60)) for _ in range(190)]
    texts += ["\n".join([line() for _ in range(40)] + ["}"] * 6) for _ in range(10)]
    texts += ["\n".join([line() for _ in range(9_989)] + ["}"] * 11), "\n".join([line() for _ in range(50)] + ["a b c"] * 60)]
    docs = spark.createDataFrame([(i, t, "en", "code") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    failed = {r["doc_id"]: r["failed"] for r in quality.judged(docs).collect()}
    assert failed[200] == [] and "dup_lines_k" in failed[201]
    assert not any("dup_lines_k" in failed[i] for i in range(200))


def test_quality_bounds_follow_their_source(spark):
    docs = spread_docs(spark)
    counts = quality.measured(docs).withColumns({k: F.expr(f"1000 * {c} div greatest({of}, 1)") for k, (c, of, _) in quality.RATES.items()})
    got = {(r["source"], r["rate"]): r for r in quality.bounds(quality.sketches(counts.where("n_words >= 50"), ["lang", "source"])).where("lang = 'en'").collect()}
    for rate in quality.RATES:
        assert got["calm", rate]["high"] < got["wild", rate]["high"], rate
    assert got["calm", "word_chars_k"]["low"] > got["wild", "word_chars_k"]["low"]
    failed = {r["doc_id"]: r["failed"] for r in quality.judged(docs).collect()}
    for i, (calm, rate) in enumerate(zip(range(1412, 1420, 2), ("word_chars_k", "symbols_k", "dup_lines_k", "repeats_k"))):
        assert rate in failed[calm] and rate not in failed[calm + 1], (i, rate)


@pytest.mark.parametrize("least", [0, 10**9, 40])
def test_archive(spark, least):
    rows = [(1, "http://a/", "x" * 50), (3, "http://b/", "x" * 50), (2, None, "é" * 30), (4, "u", None), (5, "u", ""), (7, "u", "x" * 50), (7, "u", "x" * 50), (None, "n", "é" * 30)]
    pages = spark.createDataFrame([(*r, "h") for r in rows], "page_id long, url string, html string, header string")
    got = rows_of(warc.archive_roundtrip(pages, least))
    assert len(got) == len(rows)
    first, largest = Counter(), {}
    for p, _, h in rows:
        largest[h or ""] = max(largest.get(h or "", -1), p or -1)
    for r in got:
        body = bytes(r["payload"])
        head = r["head"]
        kind = re.search("WARC-Type: (.*?)\r", head)[1]
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert f"WARC-Payload-Digest: sha1:{digest}\r" in head
        assert bytes(r["record"]) == head.encode() + (b"" if kind == "revisit" else body) + b"\r\n\r\n"
        if kind == "revisit":
            assert len(body) >= least and f"WARC-Refers-To: <urn:rillflow:{largest[body.decode()]}:" in head
        first[body.decode(), kind] += 1
    for h in {h or "" for _, _, h in rows}:
        n = sum((x or "") == h for _, _, x in rows)
        assert first[h, "response"] == (1 if len(h.encode()) >= least else n)


def test_archive_query(spark, sf):
    pages = read(sf, "pages")
    best = {}
    for p in pages:
        best[p["html"]] = max(best.get(p["html"], -1), p["page_id"])
    got = {r["page_id"]: r for r in rows_of(QUERIES["op6_warc"](spark, sf))}
    for p in pages:
        body, own = (p["html"] or "").encode(), best[p["html"]]
        want = (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if own == p["page_id"] else "revisit", None if own == p["page_id"] else own)
        r = got[p["page_id"]]
        assert (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) == want
    assert len(got) == len(pages)


def parsed_record(data):
    """A record read by the format's rules alone: version line, named fields, block of Content-Length bytes, two line ends."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8").split("\r\n")
    fields = dict(re.fullmatch(r"([A-Za-z-]+): (.*)", line).groups() for line in lines)
    n = int(fields["Content-Length"])
    assert version == "WARC/1.1" and rest[n:] == b"\r\n\r\n" and len(lines) == len(fields)
    for name in ("WARC-Record-ID", "WARC-Date", "WARC-Type", "Content-Length"):
        assert fields[name], name
    assert re.fullmatch(r"<[a-z]+:[^\s<>]+>", fields["WARC-Record-ID"]) and re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", fields["WARC-Date"])
    assert (fields["WARC-Type"] == "revisit") == ("WARC-Profile" in fields) == ("WARC-Refers-To" in fields)
    return fields, rest[:n]


def test_records_are_valid_and_stable(spark):
    """All records parse, ids are unique, every revisit refers to a response of its payload, and nothing depends on partitions."""
    rows = [(i % 7, f"http://a/{i % 3}", "é" * (i % 4)) for i in range(80)] + [(None, None, None)] * 9 + [(5, "u\r\nx", "z" * 2_000_000)] * 3
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    runs = [sorted(bytes(r["record"]) for r in warc.archive_roundtrip(p).collect()) for p in (pages.repartition(5), pages.coalesce(1))]
    assert runs[0] == runs[1] and len(runs[0]) == len(rows)
    records = [parsed_record(x) for x in runs[0]]
    ids = {f["WARC-Record-ID"]: f for f, _ in records}
    assert len(ids) == len(rows)
    for f, block in records:
        if f["WARC-Type"] == "revisit":
            other = ids[f["WARC-Refers-To"]]
            assert block == b"" and other["WARC-Type"] == "response" and other["WARC-Payload-Digest"] == f["WARC-Payload-Digest"]
        else:
            assert "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode() == f["WARC-Payload-Digest"]
    assert warc.archive_roundtrip(pages.limit(0)).count() == 0


def test_archive_finds_damage(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "abc")], "page_id long, url string, html string")
    warc.write_archive(pages, f"{tmp_path}/a")
    spark.read.parquet(f"{tmp_path}/a/payloads").select("sha256", F.encode(F.lit("abd"), "UTF-8").alias("payload")).write.parquet(f"{tmp_path}/b/payloads")
    spark.read.parquet(f"{tmp_path}/a/headers").write.parquet(f"{tmp_path}/b/headers")
    with pytest.raises(Exception, match="payload missing or altered"):
        warc.read_records(spark, f"{tmp_path}/b").collect()


def brute_chat(turns):
    turns = [(r or "", t or "") for _, r, t in turns]
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_chat_query(spark, sf):
    convs = {-7: [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]}
    for r in read(sf, "conversations"):
        convs.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"]))
    got = {r["conv_id"]: r for r in rows_of(QUERIES["op10_chat_formatting"](spark, sf))}
    assert set(got) == set(convs)
    for c, turns in convs.items():
        r = got[c]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == brute_chat(sorted(turns, key=lambda x: x[0]))


def test_chat_examples(spark):
    rows = [(1, 0, "system", "be < brief \\"), (1, 1, "user", "hi</s>"), (1, 2, "assistant", "<m>a\\<s>"), (1, 3, "user", None), (1, 4, "assistant", "b\n<"), (1, 5, "user", "tail"), (2, 0, None, "x"), (None, 0, "assistant", ""), (3, 0, "assistant", "é😀"), (3, 0, "assistant", "é😀")]
    df = spark.createDataFrame([(*r, "t") for r in rows], "conv_id long, turn long, role string, text string, n_turns string")
    ex = rows_of(chat.prefix_targets(df))
    assert Counter(r["conv_id"] for r in ex) == {1: 3, 2: 1, None: 1, 3: 2}
    one = sorted((r for r in ex if r["conv_id"] == 1), key=lambda r: r["n_turns"])
    assert [r["n_turns"] for r in one] == [3, 5, 6]
    assert one[0]["text"][one[0]["loss_start"] :][: one[0]["loss_chars"]] == "<\\m>a\\\\<\\s>"
    assert one[1]["text"].startswith(one[0]["text"]) and one[2]["loss_chars"] == 0
    got = {r["conv_id"]: r for r in rows_of(chat.digests(chat.prefix_targets(df)))}
    for c in (1, 2, 3, None):
        turns = [r[1:] for r in rows if r[0] == c]
        r = got[c]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == brute_chat(turns)
        assert r["formatted_chars"] == sum(len(e["text"]) for e in ex if e["conv_id"] == c)
    assert chat.digests(chat.prefix_targets(df.limit(0))).count() == 0


def test_chat_very_long(spark):
    """A conversation of 3,000 turns, and a turn of 2,000,000 characters."""
    turns = [(i, "user" if i % 100 else "assistant", f"t{i} <") for i in range(3000)]
    long = [(0, "user", "<\\" * 1_000_000), (1, "assistant", "é" * 500_000)]
    df = spark.createDataFrame([(1, *t) for t in turns] + [(2, *t) for t in long], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in rows_of(chat.digests(chat.prefix_targets(df)))}
    for c, own in ((1, turns), (2, long)):
        assert (got[c]["n_turns"], got[c]["turns_sha256"], got[c]["loss_chars"], got[c]["loss_sha256"]) == brute_chat(own)
