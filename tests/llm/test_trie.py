"""Prefix trie against a plain one."""

import hashlib
import math
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from rillflow.llm import trie
from rillflow.llm.queries import QUERIES

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(convs):
    """Nodes of {conv_id: [(role, text)]}."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    leaves, saved, children = {}, {}, {}
    for path in sorted(members, key=len, reverse=True):
        leaves[path] = leaves.get(path, 0) or 1
        saved[path] = saved.get(path, 0) + (len(members[path]) - 1) * (len(path[-1][1].encode()) if path else 0)
        if path:
            up = path[:-1]
            leaves[up], saved[up], children[up] = leaves.get(up, 0) + leaves[path], saved.get(up, 0) + saved[path], children.get(up, 0) + 1
    out = []
    for path, own in members.items():
        ends = ",".join(str(c) for c in sorted(own) if len(convs[c]) == len(path))
        out.append((min(own), len(path), min(members[path[:-1]]) if path else None, len(own), children.get(path, 0), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def ordered(rows):
    """{conv_id: turns} of rows (conv_id, turn, role, text)."""
    convs = {}
    digest = lambda r, t: hashlib.sha256(f"{len(r.encode())}:{r}{t}".encode()).hexdigest()
    for c, t, r, x in sorted(((c, t, r or "", x or "") for c, t, r, x in rows if c is not None), key=lambda q: (q[0], q[1] is not None, q[1] or 0, digest(q[2], q[3]))):
        convs.setdefault(c, []).append((r, x))
    return convs


def rebuild(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - int(math.fmod(c, 5)), [])[:h] + own[h:]
    return out


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query(spark, folder):
    got = sorted((tuple(r) for r in QUERIES["op11_prefix_trie"](spark, folder).select(COLUMNS).collect()), key=str)
    rows = duckdb.sql(f"select conv_id, turn, role, text from '{folder}/conversations.parquet'").fetchall()
    assert got == plain(rebuild(ordered(rows)))


@pytest.mark.parametrize("few", [1, 3, 6, 1000])
def test_random_tables(spark, few):
    """Shared beginnings, copies, long chains, turnless and null ones, ties and repeated rows, whatever is peeled in tasks."""
    rng = random.Random(few)
    rows = []
    for c in range(-8, 30):
        n = rng.choice([1, 2, 3, 5, 9, 12])
        rows += [(c, None if k == 0 and c % 3 == 0 else k, rng.choice(["u", None]) if c % 7 == 0 else "ua"[k % 2], rng.choice(["x", "yé", None] if k < 4 else ["z"])) for k in range(n)]
    rows += [(5, 1, "u", "x"), (5, 1, "u", "y"), (5, 1, "u", "x"), (None, 0, "u", "x"), (40, 0, "u", ""), (41, 0, None, None)]
    rows += [(c, k, "u", "same") for c in (50, 51, 52) for k in range(14)]
    df = spark.createDataFrame([(*r, "e") for r in rows], "conv_id long, turn long, role string, text string, key string").repartition(3)
    convs = ordered(rows)
    own = trie.prefix_trie(trie.numbered(df), few=few)
    assert sorted((tuple(r) for r in own.select(COLUMNS).collect()), key=str) == plain(convs)
    turns, every = trie.rebuilt(df)
    again = trie.prefix_trie(turns, every, few)
    assert sorted((tuple(r) for r in again.select(COLUMNS).collect()), key=str) == plain(rebuild(convs))


def test_turnless_and_empty(spark):
    rows = spark.createDataFrame([(1, 0, "u", "a")], "conv_id long, turn long, role string, text string")
    more = spark.createDataFrame([(1,), (7,), (10,), (None,)], "conv long")
    got = {tuple(r)[:6] for r in trie.prefix_trie(trie.numbered(rows), more).select(COLUMNS).collect()}
    assert got == {(1, 0, None, 3, 1, 1), (1, 1, 1, 1, 0, 1)}
    root = [r for r in trie.prefix_trie(trie.numbered(rows), more).collect() if r["depth"] == 0][0]
    assert root["ends_sha256"] == hashlib.sha256(b"7,10").hexdigest()
    assert trie.prefix_trie(trie.numbered(rows.limit(0))).count() == 0


def test_very_long_conversation(spark):
    """One conversation of 3,000 turns takes no rounds of its own."""
    rows = spark.range(200).select(F.col("id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("u").alias("role"), F.lit("hi").alias("text"))
    long = spark.range(3_000).select(F.lit(7).alias("conv_id"), (F.col("id") + 1).alias("turn"), F.lit("u").alias("role"), F.col("id").cast("string").alias("text"))
    got = trie.prefix_trie(trie.numbered(rows.unionByName(long)))
    assert got.count() == 3_002
    first = got.where("depth = 1").first()
    assert (first["n_convs"], first["n_children"], first["n_leaves"], first["saved_tokens"]) == (200, 1, 1, 398)
