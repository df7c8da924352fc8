"""Keyed tables: upserts, changelogs, merges and snapshots over plain Parquet tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert_latest(df: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """One row per key: the one with the greatest ``version``. An aggregation with partial results, so hot keys shrink before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*version)).alias("x")).select(*keys, *[F.col(f"x.{c}").alias(c) for c in rest])


def upsert(base: DataFrame, deltas: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """``base`` with ``deltas`` written over it; the greatest ``version`` of a key stays, columns missing on one side are null."""
    return upsert_latest(base.unionByName(deltas, allowMissingColumns=True), keys, version)


def parse_cdc(df: DataFrame, payload: str, row_schema: str) -> DataFrame:
    """Change envelopes (JSON with before, after, op, ts_ms) as typed rows: op, ts_ms and the row after the change (before it for deletions). Malformed ones are left out."""
    x = F.from_json(payload, f"before struct<{row_schema}>, after struct<{row_schema}>, op string, ts_ms bigint")
    out = df.withColumn("__x", x).where("__x.op is not null and (__x.after is not null or __x.before is not null)")
    row = F.when(F.col("__x.op") == "d", F.col("__x.before")).otherwise(F.col("__x.after"))
    return out.select(F.col("__x.op").alias("op"), F.col("__x.ts_ms").alias("ts_ms"), row.alias("__row")).select("op", "ts_ms", "__row.*")


def apply_cdc(base: DataFrame, changes: DataFrame, keys: list[str], version: list[str], op: str = "op") -> DataFrame:
    """``base`` after a changelog: the last change of a key counts, 'd' deletes it. Both sides are reduced per key, then joined once."""
    last = upsert_latest(changes, keys, version)
    cols = base.columns
    b = base.select(F.struct(*cols).alias("__b"), *keys)
    c = last.select(F.struct(*[F.col(x) for x in cols]).alias("__c"), F.col(op).alias("__op"), *keys)
    both = b.join(c, keys, "full").where("__op is null or __op <> 'd'")
    return both.select(F.coalesce("__c", "__b").alias("x")).select("x.*")


def merge_into(target: DataFrame, source: DataFrame, keys: list[str], update: dict[str, Column], insert: dict[str, Column]) -> DataFrame:
    """MERGE: matched rows get ``update``, unmatched source rows become ``insert``; source columns are named s_<column>. A target row matched twice fails the job."""
    again = Window.partitionBy(*keys)
    s = source.withColumn("__n", F.count(F.lit(1)).over(again))
    s = s.withColumn("__ok", F.when(F.col("__n") > 1, F.raise_error(F.lit("a key is matched by several source rows")).cast("boolean")).otherwise(F.lit(True)))
    s = s.select(*[F.col(c).alias(f"s_{c}") for c in source.columns], "__ok")
    on = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"s_{k}") for k in keys])
    both = target.withColumn("__t", F.lit(True)).join(s, on, "full").where("__ok is null or __ok")
    matched, only_source = F.col("__t") & F.col("__ok"), F.col("__t").isNull()
    return both.select(*[F.when(only_source, insert.get(c, F.lit(None))).when(matched, update.get(c, F.col(c))).otherwise(F.col(c)).alias(c) for c in target.columns])


def partial_update(df: DataFrame, keys: list[str], columns: list[str], version: str) -> DataFrame:
    """Per key and column the last value that isn't null."""
    return df.groupBy(*keys).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(version))).alias(c) for c in columns])


def merge_aggregate(df: DataFrame, keys: list[str], sums: list[str], maxes: list[str], sets: list[str]) -> DataFrame:
    """A keyed table whose columns are added, kept at their maximum or collected as sorted distinct lists when rows are written."""
    return df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums], *[F.max(c).alias(c) for c in maxes], *[F.array_sort(F.collect_set(c)).alias(c) for c in sets])


def delete_where(df: DataFrame, predicate: Column) -> DataFrame:
    """Rows for which ``predicate`` is not true; rows where it is null stay."""
    return df.where(~F.coalesce(predicate, F.lit(False)))


def add_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``df`` with those of ``columns`` (name -> type) that it lacks, as nulls."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns})


def snapshot(log: DataFrame, keys: list[str], version: str, upto: int, op: str = "op") -> DataFrame:
    """State of a changelog as of version ``upto``: the last row of each key, without deleted ones."""
    return upsert_latest(log.where(F.col(version) <= upto), keys, [version]).where(F.col(op) != "d").drop(op)


def between_snapshots(log: DataFrame, keys: list[str], version: str, after: int, upto: int, op: str = "op") -> DataFrame:
    """Rows that differ between two versions: keys, kind ('+' new or changed to, '-' gone or changed from) and the columns. The log is folded once, into both states of each key."""
    rest = [c for c in log.columns if c not in (*keys, version, op)]
    held = F.struct(F.col(op).alias("__op"), *rest)
    at = lambda v: F.max_by(held, F.when(F.col(version) <= v, F.col(version)))
    both = log.where(F.col(version) <= max(after, upto)).groupBy(*keys).agg(at(after).alias("__a"), at(upto).alias("__b"))
    state = lambda c: F.when(F.col(f"{c}.__op") != "d", F.struct(*[F.col(f"{c}.{x}").alias(x) for x in rest]))
    both = both.select(*keys, state("__a").alias("__a"), state("__b").alias("__b")).where(~F.col("__a").eqNullSafe(F.col("__b")))
    sides = F.array(F.struct(F.lit("+").alias("kind"), F.col("__b").alias("x")), F.struct(F.lit("-").alias("kind"), F.col("__a").alias("x")))
    out = both.select(*keys, F.explode(sides).alias("s")).where("s.x is not null")
    order = [c for c in log.columns if c not in (version, op)]
    return out.select(*[F.col(c) if c in keys else F.col(f"s.x.{c}").alias(c) for c in order], "s.kind")


def history(log: DataFrame, version: str) -> DataFrame:
    """The versions of a table that holds all its changes: version and n, its rows."""
    return log.groupBy(version).agg(F.count(F.lit(1)).alias("n"))
