"""Decontamination against all windows of all documents."""

import random
import re
from collections import Counter, defaultdict

import duckdb

from rillflow.llm import decontaminate
from rillflow.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return WORD.findall((text or "").translate(UPPER))


def bag(w, k):
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def brute(docs, items, least=0.75):
    out = {}
    for i, t in items:
        w = tokens(t)
        if not w:
            continue
        k = min(5, len(w))
        own, shingles = bag(w, k), {tuple(w[p : p + k]) for p in range(len(w) - k + 1)}
        for d, text in docs:
            dw = tokens(text)
            if not any(tuple(dw[p : p + k]) in shingles for p in range(len(dw) - k + 1)):
                continue
            for s in range(max(1, len(dw) - len(w) + 1)):
                b = bag(dw[s : s + len(w)], k)
                sim = sum((own & b).values()) / sum((own | b).values())
                if sim >= least:
                    out[d, i] = max(out.get((d, i), (0, 0)), (sim, -s, len(w)))
    return out


def got(df):
    rows = df.collect()
    assert all(0 <= r["distance"] <= decontaminate.RADIUS and (r["distance"] == 0 or r["similarity"] < 1) for r in rows)
    return {(r["doc_id"], r["item_id"]): (r["similarity"], -r["start"], r["n_words"]) for r in rows}


def test_query(spark, sf):
    docs = duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall()
    items = duckdb.sql(f"select item_id, text from '{sf}/benchmark.parquet'").fetchall()
    res = got(QUERIES["op3_decontamination"](spark, sf))
    assert res and res == brute(docs, items)


def test_planted(spark):
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(3000)}"
    items = [(i, " ".join(word() for _ in range(rng.randrange(12, 60)))) for i in range(30)] + [(100, "two words"), (101, ""), (102, None), (103, "ab ab ab ab ab ab ab ab")]
    docs = []
    for d in range(200):
        w = [word() for _ in range(rng.randrange(0, 120))]
        if d % 3 == 0:
            part = tokens(items[d % 30][1])
            for _ in range(d % 4):
                part[rng.randrange(len(part))] = word()
            at = rng.randrange(len(w) + 1)
            w[at:at] = part
        if d % 50 == 1:
            w += ["Two", "WORDS"]
        if d % 50 == 2:
            w += ["ab"] * 8
        docs.append((d, " \n".join(w)))
    docs += [(500, None), (501, ""), (502, tokens(items[0][1])[0]), (503, " ".join(tokens(items[1][1])[1:]))]
    df = spark.createDataFrame([(*r, "x", 0, 0) for r in docs], "doc_id long, text string, item_id string, n int, k int")
    res = got(decontaminate.contaminated(df, spark.createDataFrame(items, "item_id long, text string")))
    assert res == brute(docs, items)
    assert any(v[0] < 1 for v in res.values())


def test_odd_tables(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "A b c d e f"), (1, "A b c d e f"), (2, "a b c d e f")], "item_id long, text string")
    assert decontaminate.contaminated(docs, items).count() == 4
    assert decontaminate.contaminated(docs.limit(0), items).count() == 0
    assert decontaminate.contaminated(docs, items.limit(0)).count() == 0


def test_every_fingerprint_in_radius_is_found(spark):
    """Pairs at the radius, in all kinds of spread over the blocks; of random pairs the index meets few and returns those within the radius."""
    rng = random.Random(9)
    bits, n = 64 * decontaminate.WORDS, 300
    words = lambda x: [(x >> (64 * i)) % (1 << 64) - ((x >> (64 * i + 63)) % 2 << 64) for i in range(decontaminate.WORDS)]
    a = [rng.getrandbits(bits) for _ in range(n)]
    flips = [rng.sample(range(bits), decontaminate.RADIUS) for _ in range(n // 2)] + [[b + 16 * i for b in range(12) for i in range(4)][: decontaminate.RADIUS] for _ in range(n // 2)]
    b = [x ^ sum(1 << i for i in f) for x, f in zip(a, flips)]
    left = spark.createDataFrame([(9, words(x)) for x in a], "n int, fp array<long>")
    right = spark.createDataFrame([(9, words(x)) for x in b] + [(8, words(x)) for x in a], "n int, i_fp array<long>")
    got = {(tuple(r["fp"]), tuple(r["i_fp"])): r["distance"] for r in decontaminate.near_pairs(left, right).collect()}
    want = {(tuple(words(x)), tuple(words(y))): (x ^ y).bit_count() for x in a for y in b if (x ^ y).bit_count() <= decontaminate.RADIUS}
    assert len(want) >= n and got == want


def test_index_is_selective(spark):
    from pyspark.sql import functions as F

    rng = random.Random(4)
    one = lambda name: spark.createDataFrame([(9, [rng.getrandbits(64) - (1 << 63) for _ in range(decontaminate.WORDS)]) for _ in range(400)], f"n int, {name} array<long>")
    left = one("fp").withColumn("b", F.explode(decontaminate.blocks("fp"))).select("fp", "b.*")
    right = one("i_fp").withColumn("b", F.explode(decontaminate.near_blocks("i_fp", decontaminate.RADIUS))).select("i_fp", "b.*")
    met = left.join(right, ["block", "value"]).select("fp", "i_fp").distinct().count()
    assert 0 < met < 0.15 * 400 * 400


def test_fingerprint(spark):
    """Against hashes that Spark computes: the majority of each bit, also in a bag of more than 32,767."""
    from pyspark.sql import functions as F

    rng = random.Random(1)
    bags = [[rng.getrandbits(64) - (1 << 63) for _ in range(n)] for n in (1, 2, 7, 40, 40_000)]
    df = spark.createDataFrame([(s,) for s in bags], "sh array<long>").withColumn("fp", decontaminate.fingerprint("sh"))
    hashed = lambda seed: F.transform("sh", lambda x: F.xxhash64(x, F.lit(seed))).alias(f"h{seed}")
    own = [hashed(seed) for seed in range(decontaminate.WORDS)]
    for r in df.select("sh", "fp", *own).collect():
        for seed in range(decontaminate.WORDS):
            ones = Counter(b for x in r[f"h{seed}"] for b in range(64) if x >> b & 1)
            assert r["fp"][seed] % (1 << 64) == sum(1 << b for b in range(64) if 2 * ones[b] > len(r["sh"]))


def test_moved_parts(spark):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(5000)}"
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([80, 80, 80, 50, 7])]
    docs = []
    for i, t in items[:4]:
        w = tokens(t)
        for moved in (12, 16, 20, 24, 40):
            docs.append((len(docs), " ".join([word() for _ in range(rng.randrange(90))] + w[moved:] + w[:moved] + [word() for _ in range(rng.randrange(90))])))
            docs.append((len(docs), " ".join(w[moved:] + w[:moved])))
    docs += [(900, items[4][1]), (901, " ".join(tokens(items[0][1])[2:70]))]
    want = brute(docs, items)
    assert {d for d, _ in want} == {d for d, _ in docs}
    assert got(decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))) == want


def test_swapped_inserted_and_very_long(spark):
    """Halves swapped inside other words, words put in, and a text of 80,000 words with an item at its end."""
    rng = random.Random(21)
    word = lambda: f"w{rng.randrange(9000)}"
    item = [word() for _ in range(40)]
    around = lambda w, n=100: " ".join([word() for _ in range(n)] + w + [word() for _ in range(n)])
    docs = [(1, around(item[20:] + item[:20])), (2, around(item[:30] + ["new"] + item[30:])), (3, around(item[:10] + ["a"] + item[10:])), (4, around(item[:20] + ["b", "c", "d"] * 8 + item[20:]))]
    docs += [(5, around(item[1:39], 40_000)), (6, " ".join(item[20:] + item[:20])), (7, around(item[:20])), (8, around([x for x in item for _ in (0, 1)]))]
    items = [(1, " ".join(item)), (2, " ".join(["again", "and"] * 15)), (3, " ".join(item[5:36]))]
    docs += [(9, around(["again", "and"] * 14 + ["again"])), (10, " ".join(["and", "again"] * 9))]
    want = brute(docs, items)
    assert {(1, 1), (2, 1), (5, 1), (6, 1), (9, 2)} <= set(want) and 7 not in {d for d, _ in want}
    assert got(decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))) == want


def test_recall_near_the_threshold(spark):
    """Items with as many words changed as leave a similarity just above 0.75: nearly all are within the radius."""
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(9000)}"
    items = [(i, [word() for _ in range(rng.randrange(30, 60))]) for i in range(60)]
    docs = []
    for i, w in items:
        for _ in range(5):
            cut = int(0.143 * (len(w) - 4))
            docs.append((len(docs), " ".join([word() for _ in range(20)] + w[cut:] + [word() for _ in range(20)])))
    want = brute(docs, [(i, " ".join(w)) for i, w in items])
    res = got(decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")))
    assert len(want) == 300 and all(res[x] <= want[x] for x in res) and len(res) >= 0.98 * len(want)
