"""Mixing to target weights."""

import math
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from rillflow.llm import mixing
from rillflow.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes):
    """sizes: source -> words. Reshare the excess until no target is above twice its source."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] >= 2 * sizes[s]}
        if not full:
            return out | share
        for s in full:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= full
    return out


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query(spark, folder):
    docs = duckdb.sql(f"select doc_id, text, source from '{folder}/documents.parquet'").fetchall()
    words = {d: len(WORD.findall(t or "")) for d, t, _ in docs}
    sizes = Counter()
    for d, _, s in docs:
        sizes[s] += words[d]
    want = brute_targets(sizes)
    res = QUERIES["op8_mixing"](spark, folder).collect()
    assert sorted(r["doc_id"] for r in res) == sorted(words)
    taken = Counter()
    for r in res:
        s = r["source"]
        assert r["size"] == words[r["doc_id"]] and r["source_size"] == sizes[s]
        assert math.isclose(r["target"], want[s], rel_tol=1e-9) and r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    for s in sizes:
        least = min(r["size"] for r in res if r["source"] == s and r["size"])
        assert abs(taken[s] - want[s]) <= max(least, 20), (s, taken[s], want[s])
    again = QUERIES["op8_mixing"](spark, folder).collect()
    assert Counter(res) == Counter(again)


def test_rates_are_tilted(spark):
    cells = spark.createDataFrame([("a", s, 10, 800.0, 1000) for s in (2, 5, 13)] + [("a", 80, 10, 800.0, 1000), ("b", 7, 3, 42.0, 21), ("b", 0, 5, 42.0, 21)], "source string, size long, n long, target double, words long")
    got = defaultdict(dict)
    for r in mixing.rates(cells).collect():
        got[r["source"]][r["size"]] = r["rate"]
    assert math.isclose(sum(10 * s * r for s, r in got["a"].items()), 800, rel_tol=1e-6)
    slope = {s: math.log(r / (2 - r)) / s for s, r in got["a"].items()}
    assert max(slope.values()) - min(slope.values()) < 1e-9, "one multiplier for all documents of a source"
    assert got["b"] == {7: 2.0, 0: 2.0}


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "a"), (None, "one two", None), (3, "x " * 50_000, "b"), (4, "y z", "")] + [(5, "same words", "b")] * 40
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, source string, size string, part int")
    res = mixing.mix(df).collect()
    assert len(res) == len(rows) and all(0 <= r["copies"] <= 2 for r in res)
    assert sum(r["copies"] for r in res if r["size"] == 0) == 0
    sizes = Counter()
    for r in res:
        sizes[r["source"]] += r["size"]
    want = brute_targets(sizes)
    assert all(math.isclose(r["target"], want[r["source"]], rel_tol=1e-9) for r in res)
    assert mixing.mix(df.limit(0)).count() == 0
    one = mixing.mix(df.where(F.col("doc_id") == 4)).collect()
    assert [r["copies"] for r in one] == [2] or [r["copies"] for r in one] == [1]


def test_targets_of_many_sources(spark):
    """As many sources as hosts have, of which most are full, against resharing source by source."""
    rng = __import__("random").Random(3)
    sizes = {f"h{i}é": rng.choice([0, 1, 2, 10, 1000]) for i in range(600)} | {None: 50, "": 7, "Z": 10**6}
    for some in (sizes, {s: n for s, n in sizes.items() if n < 5}, {"a": 0, "b": 0}):
        got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(some.items()), "source string, words long")).collect()}
        want = brute_targets(some)
        assert set(got) == set(want) and all(math.isclose(got[s], want[s], rel_tol=1e-9, abs_tol=1e-9) for s in want)


def test_rates_that_do_not_converge(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ROUNDS", 1)
    cells = spark.createDataFrame([("a", s, 10, 900.0, 1000) for s in (2, 5, 13, 80)], "source string, size long, n long, target double, words long")
    with pytest.raises(RuntimeError, match="did not converge"):
        mixing.rates(cells)


def test_copies_by_rate_and_rounding(spark):
    """Copies of a size are its rate's, rounded with what larger sizes leave over; no two documents of one size differ by more than one."""
    rows = [(i, "w " * (3 + i % 5), "abc"[i % 3]) for i in range(900)]
    res = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for s in "abc":
        own = [r for r in res if r["source"] == s]
        sizes = sorted({r["size"] for r in own}, reverse=True)
        lam = [0.0]

        def got(x):
            return sum(r["size"] * 2 / (1 + math.exp(-x * r["size"])) for r in own)

        lo, hi = -5.0, 5.0
        for _ in range(200):
            lam = (lo + hi) / 2
            lo, hi = (lam, hi) if got(lam) < own[0]["target"] else (lo, lam)
        carry = 0.0
        for size in sizes:
            copies = [r["copies"] for r in own if r["size"] == size]
            want = len(copies) * 2 / (1 + math.exp(-lam * size)) * size + carry
            assert abs(sum(copies) - want / size) <= 0.5 + 1e-6 and max(copies) - min(copies) <= 1
            carry = want - sum(copies) * size
