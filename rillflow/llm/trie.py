"""Prefix trie of conversations by truncation peeling: from the greatest depth up, strip the last turn and regroup."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_dir, written

ROOT = hashlib.sha256(b"").digest()
FEW = 64  #: conversations of a depth below which deeper levels are peeled inside tasks

NODE = "key binary, depth int, conv long, parent binary, n_convs long, n_children long, n_leaves long, saved long, ends string"


def numbered(rows: DataFrame) -> DataFrame:
    """(conv, place, turn_hash, size) of rows (conv_id, turn, role, text): turns in order, from 1; null turns first, ties by hash. ``size`` is the UTF-8 bytes of the text, null role and text are empty, rows without conv_id are left out."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    whole = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    narrow = rows.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), "turn", whole.alias("turn_hash"), F.octet_length(text).cast("long").alias("size"))
    place = F.row_number().over(Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "turn_hash"))
    return narrow.select("conv", place.alias("place"), "turn_hash", "size")


def _chained(batches: Iterator[pa.RecordBatch], cut: int) -> Iterator[pa.RecordBatch]:
    """Keys of the prefixes of conversations, each the hash of the one before and a turn: (conv, depth, key, parent, above, size), ``above`` the key at depth ``cut`` for deeper ones."""
    conv, key, above = None, ROOT, ROOT
    for batch in batches:
        keys, parents, tops = [], [], []
        for c, d, h in zip(*(batch.column(x).to_pylist() for x in ("conv", "place", "turn_hash"))):
            if c != conv:
                conv, key, above = c, ROOT, ROOT
            parents.append(key)
            key = hashlib.sha256(key + h).digest()
            keys.append(key)
            if d == cut:
                above = key
            tops.append(above if d > cut else None)
        yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("place"), pa.array(keys, pa.binary()), pa.array(parents, pa.binary()), pa.array(tops, pa.binary()), batch.column("size")], ["conv", "depth", "key", "parent", "above", "size"])


def _endings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations that end in one node: (key, depth, conv, n, ends, above), from rows sorted by key and conv. Numbers are hashed as they come, so a node with very many takes no memory."""
    now, out = None, []
    for batch in batches:
        for key, depth, above, conv in zip(*(batch.column(x).to_pylist() for x in ("key", "depth", "above", "conv"))):
            if now is None or key != now[0]:
                if now:
                    out.append((*now[:4], now[4].hexdigest(), now[5]))
                now = [key, depth, conv, 0, hashlib.sha256(), above]
            else:
                now[4].update(b",")
            now[3] += 1
            now[4].update(str(conv).encode())
        if out:
            yield _rows(out)
            out = []
    if now:
        yield _rows([(*now[:4], now[4].hexdigest(), now[5])])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["key", "depth", "conv", "n", "ends", "above"])


def _peel_here(rows: pd.DataFrame) -> pd.DataFrame:
    """All nodes of the depths in ``rows``: prefixes (n null: conv, depth, key, parent, size) and endings (key, depth, conv, n, ends)."""
    prefixes = rows[rows["n"].isna()]
    known = {(c, d): (p, s) for c, d, p, s in zip(prefixes["conv"], prefixes["depth"], prefixes["parent"], prefixes["size"])}
    ended: dict[int, list] = {}
    done = rows[rows["n"].notna()]
    for key, d, conv, n, ends in zip(done["key"], done["depth"], done["conv"], done["n"], done["ends"]):
        ended.setdefault(int(d), []).append((key, int(conv), int(n), ends))
    out, alive = [], {}
    for d in range(max(ended, default=0), int(rows["depth"].min()) - 1, -1):
        for key, conv, n, ends in ended.get(d, ()):
            node = alive.setdefault(key, [conv, 0, 0, 0, 0, None])
            node[0], node[1], node[5] = min(node[0], conv), node[1] + n, ends
        above: dict[bytes, list] = {}
        for key, (conv, n, children, leaves, saved, ends) in alive.items():
            parent, size = known[conv, d]
            leaves, saved = leaves or 1, saved + (n - 1) * size
            out.append((key, d, conv, parent, n, children, leaves, saved, ends))
            node = above.setdefault(parent, [conv, 0, 0, 0, 0, None])
            above[parent] = [min(node[0], conv), node[1] + n, node[2] + 1, node[3] + leaves, node[4] + saved, None]
        alive = above
    return pd.DataFrame(out, columns=["key", "depth", "conv", "parent", "n_convs", "n_children", "n_leaves", "saved", "ends"])


def prefix_trie(turns: DataFrame, conversations: DataFrame | None = None, few: int = FEW) -> DataFrame:
    """One row for each distinct sequence of first turns of a conversation, from the root without turns on: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    turns: (conv, place, turn_hash, size) as ``numbered`` gives them, places from 1 without gaps; ``conversations`` (conv) are members without turns
    as well. A node is named by its smallest member. n_leaves counts the childless nodes of its subtree; saved_tokens sums (members - 1) times the bytes of the last text over the subtree; ends_sha256
    hashes the numbers of the conversations that end in the node, ascending, joined by commas.

    Peeling: the nodes of a depth are the conversations that end there and the survivors of the depth below, grouped by the key of their turns. Each then
    loses its last turn, and what it has gathered (least member, members, one child, leaves, savings) is all that goes on, so that a level shuffles a
    row a node and sums are combined before. A level is written before the next one starts, hence a lost executor repeats one level. Levels that fewer than ``few`` conversations reach
    are peeled first, inside tasks by their prefix at the last common level, as they hold fewer than ``few`` rows each: rounds don't follow the one very long conversation of a table.
    An empty table gives no rows.
    """
    spark = turns.sparkSession
    depths = {r["place"]: r["count"] for r in turns.groupBy("place").count().collect()}  # as many rows as the longest conversation has turns
    cut = max((d for d, n in depths.items() if n >= few), default=0)
    chain = turns.repartition("conv").sortWithinPartitions("conv", "place")
    chain = chain.mapInArrow(lambda b: _chained(b, cut), "conv long, depth int, key binary, parent binary, above binary, size long")
    base = shared_dir(spark)
    chain.withColumn("level", F.least("depth", F.lit(cut + 1))).write.partitionBy("level").parquet(f"{base}/prefixes")
    prefixes = spark.read.schema("conv long, depth int, key binary, parent binary, above binary, size long, level int").parquet(f"{base}/prefixes")

    last = prefixes.groupBy("conv").agg(F.max("depth").alias("depth"))
    ended = prefixes.join(last, ["conv", "depth"]).select("key", "depth", "above", "conv")
    if conversations is not None:
        silent = conversations.select("conv").where("conv is not null").distinct().join(prefixes.where("depth = 1").select("conv"), "conv", "left_anti")
        ended = ended.unionByName(silent.select(F.lit(ROOT).alias("key"), F.lit(0).alias("depth"), F.lit(None).cast("binary").alias("above"), "conv"))
    ended = ended.repartition("key").sortWithinPartitions("key", "conv").mapInArrow(_endings, "key binary, depth int, conv long, n long, ends string, above binary")
    ended = written(ended)

    def level_of(name: int, rows: DataFrame) -> DataFrame:
        path = f"{base}/nodes/level={name}"
        rows.write.option("compression", "zstd").parquet(path)
        return spark.read.schema(NODE).parquet(path)

    below = spark.createDataFrame([], NODE)
    if cut < max(depths, default=0):
        none = lambda kind, name: F.lit(None).cast(kind).alias(name)
        rows = prefixes.where(F.col("level") > cut).select("key", "depth", "conv", "parent", "size", none("double", "n"), none("string", "ends"), "above")
        rows = rows.unionByName(ended.where(F.col("depth") > cut).select("key", "depth", "conv", none("binary", "parent"), none("long", "size"), F.col("n").cast("double").alias("n"), "ends", "above"))
        below = level_of(cut + 1, rows.groupBy("above").applyInPandas(_peel_here, NODE))
    for depth in range(cut, -1, -1):
        last_turn = F.col("depth") == depth + 1
        alive = below.where(last_turn).select(F.col("parent").alias("key"), "conv", F.col("n_convs").alias("n"), F.lit(1).alias("child"), "n_leaves", "saved", F.lit(None).cast("string").alias("ends"))
        here = ended.where(F.col("depth") == depth).select("key", "conv", "n", F.lit(0).alias("child"), F.lit(0).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved"), "ends")
        level = alive.unionByName(here).groupBy("key").agg(F.min("conv").alias("conv"), F.sum("n").alias("n_convs"), F.sum("child").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"), F.max("ends").alias("ends"))
        if depth:
            level = level.join(prefixes.where(F.col("level") == depth).select("conv", "parent", "size"), "conv")
        else:
            level = level.withColumns({"parent": F.lit(None).cast("binary"), "size": F.lit(0).cast("long")})
        saved = F.col("saved") + (F.col("n_convs") - 1) * F.col("size")
        below = level_of(depth, level.select("key", F.lit(depth).alias("depth"), "conv", "parent", "n_convs", "n_children", F.greatest("n_leaves", F.lit(1)).alias("n_leaves"), saved.alias("saved"), "ends"))
    every = spark.read.schema(NODE).parquet(f"{base}/nodes")
    above = every.where("n_children > 0").select(F.col("key").alias("parent"), F.col("conv").alias("parent_conv_id"))
    named = every.join(above, "parent", "left")
    return named.select(F.col("conv").alias("conv_id"), F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def rebuilt(rows: DataFrame, shared: int = 9, family: int = 5) -> tuple[DataFrame, DataFrame]:
    """Turns and numbers of conversations c that begin with the first h turns of conversation c - c % family, h = crc32(c) % shared, and go on with their own turns after the first h."""
    own = written(numbered(rows))
    convs = written(rows.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv")).distinct())
    h = (F.crc32(F.col("conv").cast("string")) % shared).cast("int")
    base = (F.col("conv") - F.col("conv") % family).alias("base")
    plan = convs.select("conv", base, h.alias("h"))
    starts = own.where(F.col("place") < shared).withColumnRenamed("conv", "base")
    lent = plan.join(starts, "base").where("place <= h").select("conv", "place", "turn_hash", "size")
    borrowed = lent.groupBy("conv").agg(F.count(F.lit(1)).cast("int").alias("lent"))
    rest = own.join(plan.select("conv", "h"), "conv").where("place > h").join(borrowed, "conv", "left")
    rest = rest.select("conv", (F.col("place") - F.col("h") + F.coalesce("lent", F.lit(0))).alias("place"), "turn_hash", "size")
    return lent.unionByName(rest), convs
