"""The pipeline's stages against brute force on a small fixture."""

import random
from collections import Counter

import corpus_pipeline
import pytest
from test_decontaminate import brute as brute_hits
from test_neardup import brute as brute_groups
from test_mixing import WORD, brute_targets

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    letters = {"en": "abcdefgh", "fr": "opqrstuv"}
    word = lambda l: "".join(rng.choice(letters[l]) for _ in range(rng.randrange(2, 7)))
    items = [(i, " ".join(word("en") for _ in range(20))) for i in range(5)]
    docs = []
    for d in range(240):
        lang = rng.choice(["en", "fr"])
        docs.append([d, " ".join(word(lang) for _ in range(rng.randrange(20, 90))), lang, f"s{rng.randrange(4)}", 0])
    for d in range(0, 40, 2):
        docs[d][1] = docs[d + 1][1] + " tail"
        docs[d][2] = docs[d + 1][2]
    for d in range(50, 55):
        docs[d][1:3] = [" ".join(word("en") for _ in range(9)) + " " + items[d % 5][1], "en"]
    docs += [[900, None, "en", "s0", 0], [901, "", None, None, 0], [902, "12 34 !!", "fr", "s1", 0], [903, " ".join(word("en") for _ in range(60)), "fr", "s1", 0], docs[100], docs[100]]
    docs += [[None, " ".join(word("fr") for _ in range(30)), None, None, 0]]
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame([tuple(r) for r in docs], COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    items = rows_of(spark.read.parquet(f"{folder}/benchmark.parquet"))
    outs = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        assert k == 4 or out.dtypes == docs.dtypes
        out.write.parquet(f"{tmp_path}/{k}")
        outs.append((rows_of(docs), rows_of(spark.read.parquet(f"{tmp_path}/{k}"))))
        docs = spark.read.parquet(f"{tmp_path}/{k}")

    before, after = outs[0]
    assert Counter(before) - Counter(after) == Counter([r for r in before if r[0] in (900, 901, 902, 903)])

    before, after = outs[1]
    groups = {(d, c) for d, _, c, _ in brute_groups([r[:2] for r in before])}
    assert sorted(r[0] for r in after if r[0] is not None) == sorted({c for _, c in groups if c is not None}) and sum(r[0] is None for r in after) == 1
    assert not Counter(after) - Counter(before)

    before, after = outs[2]
    hit = {d for d, _ in brute_hits([r[:2] for r in before], items)}
    assert hit and Counter(after) == Counter(r for r in before if r[0] not in hit)

    before, after = outs[3]
    sizes, taken = Counter(), Counter()
    for r in before:
        sizes[r[3]] += len(WORD.findall(r[1]))
    for r in after:
        taken[r[3]] += len(WORD.findall(r[1]))
    assert set(after) <= set(before) and max(Counter(after).values()) <= 2
    assert all(abs(taken[s] - t) <= 25 for s, t in brute_targets(sizes).items())

    before, after = outs[4]
    assert Counter(r[:5] for r in after) == Counter(before)
    counts = Counter(r[5] for r in after)
    assert len(counts) == 16 and max(counts.values()) - min(counts.values()) <= 1
    assert all(sorted(r[6] for r in after if r[5] == s) == list(range(n)) for s, n in counts.items())


def test_run(spark, folder):
    assert corpus_pipeline.run(spark, folder).count() > 100


def test_language_keeps_all_labels(spark):
    """Seventy languages, and labels with a region, in capitals or spelled out."""
    rng = random.Random(6)
    names = [f"{a}{b}" for a in "abcdefg" for b in "abcdefghij"]
    labels = {"aa": ["aa", "aa-US", "AA", "aa_GB"], "bb": ["bbnese"]}
    rows = []
    for name in names:
        own = [chr(0x4E00 + rng.randrange(20000)) for _ in range(8)]
        for i in range(4):
            rows.append((len(rows), " ".join("".join(rng.choice(own) for _ in range(4)) for _ in range(40)), labels.get(name, [name])[i % len(labels.get(name, [name]))], "s", 0))
    docs = spark.createDataFrame(rows, COLUMNS)
    kept = rows_of(corpus_pipeline.language(spark, docs, ""))
    assert sorted(r[0] for r in kept) == [r[0] for r in rows]


def test_odd_tables(spark, tmp_path):
    """No documents, no benchmark, very long texts, and columns with the names that stages use."""
    items = spark.createDataFrame([], "item_id long, text string")
    names = ["shard", "slot", "__id", "row_hash", "n", "times", "again", "d_id", "d_hash", "d_text", "rid", "text_hash"]
    long = " ".join(f"abc{i % 7}d def{i}" for i in range(40_000))
    rows = [(1, long, "en", "s"), (2, "abc def ghi " * 30, "en", "s"), (None, "abc dez ghi jkl mno " * 9, "en", None), (4, long + " end", "en", "t"), (5, None, None, None), (5, None, None, None)]
    docs = spark.createDataFrame([(*r, 0, *range(len(names))) for r in rows], COLUMNS + "".join(f", `{n}` long" for n in names))
    for k, some in enumerate((docs, docs.limit(0))):
        folder = f"{tmp_path}/{k}"
        items.write.parquet(f"{folder}/benchmark.parquet")
        some.write.parquet(f"{folder}/documents.parquet")
        out = spark.read.parquet(f"{folder}/documents.parquet")
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, out, folder)
            assert out.columns == docs.columns if i < 4 else set(out.columns) == set(docs.columns)
            out.write.parquet(f"{folder}/out{i}")
            out = spark.read.parquet(f"{folder}/out{i}")
            if i == 1:
                assert sorted(r["doc_id"] or 0 for r in out.collect()) == ([0, 1, 2] if k == 0 else [])
        assert corpus_pipeline.run(spark, folder).count() == out.count() and (out.count() > 0) == (k == 0)


def test_rows_that_differ_elsewhere(spark):
    """Rows equal in id, text and source, but not in all columns, keep what is theirs, in every run."""
    rng = random.Random(2)
    text = [" ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(40)) for _ in range(50)]
    docs = spark.createDataFrame([(i, text[i], "en", "s", n) for i in range(50) for n in (1, 2, 2)], COLUMNS)
    mixed = corpus_pipeline.mix(spark, docs, "").collect()
    assert Counter(mixed) == Counter(corpus_pipeline.mix(spark, docs.repartition(3), "").collect())
    assert {r["n_chars"] for r in mixed} == {1, 2} and set(mixed) <= set(docs.collect())


def test_twins_of_other_languages(spark):
    """Of rows with one id and text, the one whose declared language is wrong goes, and the right one stays."""
    rng = random.Random(8)
    word = {l: (lambda a: lambda: "".join(rng.choice(a) for _ in range(4)))(a) for l, a in (("en", "abcdefgh"), ("fr", "opqrstuv"))}
    rows = []
    for i in range(200):
        own, other = rng.choice([("en", "fr"), ("fr", "en")])
        text = " ".join(word[own]() for _ in range(40))
        rows.append((i // 2, text, own, f"s{i % 3}", 0))
        rows += [(i // 2, text, other, f"s{i % 3}", 0)] * (i % 10 == 3) + [(i // 2, text, own, f"s{i % 3}", 1)] * (i % 7 == 0)
    kept = rows_of(corpus_pipeline.language(spark, spark.createDataFrame(rows, COLUMNS), ""))
    right = {"en": "abcdefgh", "fr": "opqrstuv"}
    assert Counter(kept) == Counter(r for r in rows if r[1][0] in right[r[2]])


def test_copies_are_scattered(spark):
    """The mix makes copies right before the shards: they aren't neighbours."""
    docs = spark.createDataFrame([(i // 2, f"text {i // 2}", "en", "s", 0) for i in range(4000)], COLUMNS)
    got = sorted(rows_of(corpus_pipeline.shards(spark, docs, "").select("shard", "slot", "doc_id")))
    assert sum(a[2] == b[2] and a[0] == b[0] for a, b in zip(got, got[1:])) <= 8
