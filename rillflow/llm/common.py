"""Shared helpers: reading tables, cutting lineage through the shared folder, connected components."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder

#: Java regular expression of one word, and of what stands between two.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"

_made: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder that driver and executors share (see ``session.shared_folder``); ``release`` removes it."""
    path = shared_folder(spark)
    _made.append(path)
    return path


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: its lineage is cut, any executor can read it again, and its size is known to the planner, which then decides on broadcasting from that size."""
    path = shared_dir(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def made() -> int:
    """How many shared folders this process has made and not removed."""
    return len(_made)


def release(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Remove the shared folders made since ``made()`` was ``since``, but for the last ``keep``. Call it when no lazy result needs them any more."""
    upto = len(_made) - keep
    for path in _made[since:upto]:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    del _made[since:upto]


def unused(taken: Iterable[str], *wanted: str) -> list[str]:
    """Column names like ``wanted`` that clash with none of ``taken``."""
    used = {c.lower() for c in taken}
    out = []
    for name in wanted:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def words(text: Column) -> Column:
    """Array of the words of a text; no element where there is no word or no text."""
    bare = F.btrim(text, F.lit(BLANKS))
    return F.when(F.coalesce(F.length(bare), F.lit(0)) > 0, F.split(bare, GAP)).otherwise(F.array().cast("array<string>"))


def fold(text: Column) -> Column:
    """A-Z in lower case, all else unchanged. A text in ASCII alone takes the faster way."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (u, v): one row (node, root) for each node of an edge, root the smallest node.

    Alternating large-star and small-star steps: each is one grouped minimum, combined before the
    shuffle, and one join back, whose large groups adaptive execution splits. The edges of each round are written
    to the shared folder, so that a lost executor repeats one round only.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        if large:
            return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        low = written(low)
        joined = both.join(low, "u")
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        return out.where("u > v").distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())

    edges = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = state(edges)
    while before[0]:
        edges = written(star(star(edges, True), False))
        after = state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
