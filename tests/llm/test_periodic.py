"""Periodic runs against a search by definition."""

import hashlib
import random
import re
import zlib

import duckdb
import pytest

from rillflow.llm.periodic import Extensions, find_runs, runs
from rillflow.llm.queries import QUERIES


def by_definition(w, least=24, power=3):
    found, n = set(), len(w)
    for q in range(1, n // power + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            b = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            own = w[b : i + q]
            if len(own) >= max(least, power * q) and not any(own[p:] == own[:-p] for p in range(1, q)):
                found.add((b, len(own), q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def planted(rng, n):
    w = [rng.randint(1, rng.choice([1, 2, 3, 5])) for _ in range(n)]
    for _ in range(rng.randint(0, 3) if n > 10 else 0):
        a, p, m = rng.randrange(len(w)), rng.randint(1, 12), rng.randint(10, 70)
        block = w[a : a + p]
        w[a : a + m] = (block * m)[:m]
    return w


def test_extensions():
    rng = random.Random(3)
    for _ in range(60):
        w = planted(rng, rng.randint(2, 40))
        tree = Extensions(w)
        pairs = [(i, j) for i in range(len(w)) for j in range(len(w)) if i != j]
        lce = lambda i, j: next((k for k in range(len(w)) if i + k >= len(w) or j + k >= len(w) or w[i + k] != w[j + k]), len(w))
        import numpy as np

        i, j = map(np.array, zip(*pairs))
        assert tree.common(i, j).tolist() == [lce(*p) for p in pairs]


@pytest.mark.parametrize("least", [6, 24])
def test_runs_of_random_words(least):
    rng = random.Random(least)
    for _ in range(600):
        w = planted(rng, rng.randint(0, 90))
        assert runs(w, least) == by_definition(w, least), w


def test_texts(spark):
    """Whole texts with runs next to each other, in each other, at both ends, apart, and none; odd rows; columns that clash."""
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(40)] + ["é", "</s>", " "]
    texts = [None, "", " \n ", "a", "a " * 23, "a " * 24, "a b c d e f g h " * 3, "a b c d e f g h i " * 2 + "a b c d e f g"]
    for _ in range(300):
        parts = []
        for _ in range(rng.randint(1, 6)):
            block = [rng.choice(vocabulary) for _ in range(rng.randint(1, 15))]
            parts += (block * rng.choice([1, 1, 2, 3, 4, 9]))[: rng.randint(1, 80)]
        texts.append("".join(w + rng.choice([" ", "\n", "\t \r", "\x0b\x0c"]) for w in parts))
    texts += ["x " * 40_000 + " ".join(f"n{i}" for i in range(5_000)) + " y z" * 30_000, texts[20], texts[20]]
    rows = [(None if i % 50 == 7 else i, t, i, 0) for i, t in enumerate(texts)]
    got = find_runs(spark.createDataFrame(rows, "doc_id long, text string, id long, runs int").repartition(5)).collect()
    want = []
    for i, t, _, _ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        if len(w) > 10_000:
            own = [(0, 40_000, 1), (45_000, 60_000, 2)]
        else:
            own = by_definition(w)
        gone = {k for b, n, q in own for k in range(b + q, b + n)}
        want.append((i, len(w), own, " ".join(x for k, x in enumerate(w) if k not in gone)))
    assert sorted(((r[0], r[1], [tuple(x) for x in r[2]], r[3]) for r in got), key=str) == sorted(want, key=str)
    assert find_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    got = {r["doc_id"]: tuple(r) for r in QUERIES["op13_periodic_runs"](spark, folder).collect()}
    rows = duckdb.sql(f"select doc_id, text from '{folder}/documents.parquet'").fetchall()
    assert len(got) == len(rows)
    some = 0
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        n, h = len(w), zlib.crc32(str(i).encode())
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        if n > 3_000:
            continue
        own = by_definition(w)
        some += len(own)
        best = max(own, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
        gone = {k for b, m, q in own for k in range(b + q, b + m)}
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        told = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        assert got[i] == (i, len(own), *told, sha("".join(f"{b},{m},{q}\n" for b, m, q in own)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))
    assert some > 10
