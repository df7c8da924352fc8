"""Near duplicates against all pairs."""

import random
import re

import duckdb
import pytest

from rillflow.llm import neardup
from rillflow.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(UPPER))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else frozenset()


def brute(rows):
    """(id, n_shingles, component_id, kept) of (id, text) rows."""
    sets = [shingles(t) for _, t in rows]
    at = {}
    for i, s in enumerate(sets):
        for x in s:
            at.setdefault(x, []).append(i)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    seen = set()
    for group in at.values():
        for k, i in enumerate(group):
            for j in group[:k]:
                if (i, j) not in seen:
                    seen.add((i, j))
                    if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                        root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    out = []
    for i, (d, _) in enumerate(rows):
        c = least.get(find(i)) if sets[i] else d
        out.append((d, len(sets[i]), c, d == c))
    return sorted(out, key=str)


def got(df):
    return sorted(((r[0], r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query(spark, folder):
    rows = duckdb.sql(f"select doc_id, text from '{folder}/documents.parquet'").fetchall()
    assert got(QUERIES["op9_near_dedup"](spark, folder)) == brute(rows)


def test_dense_group_in_blocks(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.choice([1, 2, 3, 6, 9])):
            w[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    common = " ".join(f"p{i}" for i in range(60))
    rows += [(1000 + i, common + " " + " ".join(f"u{i}_{k}" for k in range(20 + i))) for i in range(60)]
    monkeypatch.setattr(neardup, "BLOCK_NODES", 40)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(neardup.near_duplicates(df)) == brute(rows)


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(40_000))
    rows = [(5, "A b"), (4, "a B"), (3, None), (2, ""), (2, " \n"), (None, "a b"), (None, "only here now"), (7, "A b c d e"), (8, "a b c d e"), (8, "a b c d e"), (9, long), (10, long + " end"), (11, "É a"), (12, "é a")]
    df = spark.createDataFrame([(*r, 1, "x", 0) for r in rows], "doc_id long, text string, n int, sketch string, rid long")
    res = neardup.near_duplicates(df)
    want = [(d, n, c, k if d is not None else c is None) for d, n, c, k in brute(rows)]
    assert got(res) == sorted(want, key=str)
    stays = res.where("stays").collect()
    assert len(stays) == len(rows) - 5, "one of {a b} x3, {a b c d e} x3 and {long} x2"
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_chain_of_near_texts(spark, monkeypatch):
    """Each text is near the next (J about 0.57), none are to be linked: verifications grow with the pairs that overlap, not with the square of the chain."""
    words = [f"c{i}" for i in range(30 * 400 + 200)]
    rows = [(i, " ".join(words[30 * i : 30 * i + 110])) for i in range(400)]
    counts = []
    plain = neardup._verified
    monkeypatch.setattr(neardup, "_verified", lambda pairs, *a: counts.append(pairs.count()) or plain(pairs, *a))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(neardup.near_duplicates(df)) == brute(rows)
    assert sum(counts) <= 3 * len(rows), counts


def test_one_list_in_many_blocks(spark, monkeypatch):
    """A group of close texts much larger than a block, with outsiders in the same lists: verifications stay linear."""
    rng = random.Random(17)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(600):
        w = list(base)
        w[rng.randrange(150)] = f"x{i}"
        rows.append((i, " ".join(w)))
    for i in range(12):
        w = list(base)
        for k in range(3 + 12 * i % 30, 150, 11):
            w[k] = f"y{i}_{k}"
        rows.append((2000 + i, " ".join(w)))
    monkeypatch.setattr(neardup, "BLOCK_NODES", 50)
    counts = []
    plain = neardup._verified
    monkeypatch.setattr(neardup, "_verified", lambda pairs, *a: counts.append(pairs.count()) or plain(pairs, *a))
    assert got(neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)
    assert counts[0] <= len(rows) and counts[1] <= 20 * len(rows), counts
