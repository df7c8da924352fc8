"""Substring dedup against a plain search for windows."""

import hashlib
import random
import re

import duckdb
import pytest

from rillflow.llm import substrings
from rillflow.llm.queries import QUERIES


def plain(rows):
    """[(doc_id, n_words, n_removed, text)] of (doc_id, text)."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    first = {}
    for (i, _), w in zip(rows, words):
        if i is not None:
            for s in range(len(w) - 12):
                g = tuple(w[s : s + 13])
                first[g] = min(first.get(g, i), i)
    out = []
    for (i, _), w in zip(rows, words):
        gone = set()
        for s in range(len(w) - 12) if i is not None else ():
            if first[tuple(w[s : s + 13])] < i:
                gone.update(range(s, s + 13))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


def found(spark, rows, partitions=5):
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id long, text string, tag int, doc string").repartition(partitions)
    return sorted((tuple(r) for r in substrings.without_repeats(df).collect()), key=str)


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query(spark, folder):
    got = {r["doc_id"]: tuple(r) for r in QUERIES["op12_substring_dedup"](spark, folder).collect()}
    want = plain(duckdb.sql(f"select doc_id, text from '{folder}/documents.parquet'").fetchall())
    assert len(got) == len(want)
    for i, n, removed, text in want:
        assert got[i] == (i, n, removed, hashlib.sha256(text.encode()).hexdigest())
    assert sum(r[2] for r in want) > 1000


@pytest.mark.parametrize("seed", range(4))
def test_random_tables(spark, seed, monkeypatch):
    """Few words, so that anchors recur inside and between documents; passages cut, joined and changed by a word; odd rows."""
    rng = random.Random(seed)
    monkeypatch.setattr(substrings, "PIECES", 5)
    vocabulary = [f"w{k}" for k in range(3 if seed < 2 else 400)] + ["é"]
    passages = [[rng.choice(vocabulary) for _ in range(rng.choice([12, 13, 14, 30, 2_500 if k == 0 else 60]))] for k in range(12)]
    rows = []
    for i in range(160):
        parts = []
        for _ in range(rng.randint(0, 5)):
            p = list(rng.choice(passages))
            a = rng.randrange(len(p))
            p = rng.choice([p, p[:a], p[a:], p[:a] + ["odd"] + p[a:], [rng.choice(vocabulary) for _ in range(20)]])
            parts += p
        rows.append((i * 7 % 161, "".join(w + rng.choice([" ", "\n", "\t", "  "]) for w in parts)))
    rows += [rows[3], rows[3], (rows[5][0], rows[6][1]), (rows[8][0], rows[2][1]), (None, rows[4][1]), (None, rows[4][1]), (None, None), (500, None), (501, ""), (502, " \n"), (-4, rows[9][1])]
    assert found(spark, rows) == plain(rows)


def test_common_passage(spark, monkeypatch):
    """A passage of all documents, among words of their own: one block, many pieces."""
    rng = random.Random(9)
    monkeypatch.setattr(substrings, "PIECES", 20)
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(i, " ".join(f"x{rng.random()}" for _ in range(30)) + f" {passage} " + " ".join(f"x{rng.random()}" for _ in range(30))) for i in range(300)]
    got = found(spark, rows)
    assert got == plain(rows)
    assert sorted(r[2] for r in got) == [0] + [60] * 299


def test_empty(spark):
    assert found(spark, []) == []
