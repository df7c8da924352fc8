"""Interval, window, as-of, lookup and rule joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .aggregates import block_of


def micros(c: str) -> Column:
    """Microseconds since the epoch of a timestamp column with or without zone."""
    return F.unix_micros(F.col(c).cast("timestamp"))


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], lt: str, rt: str, back: float, ahead: float) -> DataFrame:
    """Inner join on ``keys`` and lt - back <= rt <= lt + ahead (seconds, both ends included).

    Time is cut into buckets of back + ahead: a left row meets at most two of them, a right row lies in one. The equi-join
    on keys and bucket spreads a hot key over its time range and never compares rows further apart than two buckets.
    """
    lo, width = int(back * 1e6), max(1, int((back + ahead) * 1e6))
    own = F.floor((micros(lt) - lo) / width)
    l = left.withColumn("__bucket", F.explode(F.array(own, own + 1)))  # noqa: E741
    r = right.withColumn("__bucket", F.floor(micros(rt) / width))
    both = l.join(r, [*keys, "__bucket"])
    return both.where(micros(rt).between(micros(lt) - lo, micros(lt) + int(ahead * 1e6))).drop("__bucket")


def window_join(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join rows of the same key and window (window_start, window_end on both sides)."""
    return left.join(right, [*keys, "window_start", "window_end"], how)


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], lt: str, rt: str, values: list[str], rows_per_block: int = 1_000_000) -> DataFrame:
    """Each left row with ``values`` of the right row of its key that has the greatest rt <= lt, else nulls.

    One shuffle of the rows: both sides in one table, in time order with right rows first, and the last right row carried forward.
    Of right rows with one time, the one greatest by ``values`` counts. Rows with a null key or time match nothing. Beyond ``rows_per_block`` left rows, time is cut into blocks, so
    that a key with a large share of all rows is many tasks' work; the last right row of each key and block, a narrow table, is carried to later blocks.
    """
    names = [c for c in left.columns if c not in keys]
    l = left.select(*keys, F.col(lt).alias("__t"), F.lit(1).alias("__side"), F.struct(*names).alias("__l"), F.lit(None).alias("__r"))  # noqa: E741
    r = right.where(F.col(rt).isNotNull()).select(*keys, F.col(rt).alias("__t"), F.lit(0).alias("__side"), F.lit(None).alias("__l"), F.struct(*values).alias("__r"))
    at = F.unix_micros(F.col("__t").cast("timestamp")) if "timestamp" in dict(left.dtypes)[lt] else F.col("__t").cast("long")
    block = block_of(l.select(at.alias("__at")), "__at", rows_per_block)
    both = l.unionByName(r).withColumn("__at", at).withColumn("__block", block)
    w = Window.partitionBy(*keys, "__block").orderBy("__t", "__side", "__r").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__m", F.last("__r", ignorenulls=True).over(w)).where("__side = 1")
    lasts = both.where("__side = 0").groupBy(*keys, "__block").agg(F.max(F.struct("__t", "__r")).alias("x"))
    blocks = both.select(*keys, "__block").distinct()
    carried = blocks.join(lasts, [*keys, "__block"], "left")
    over = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    carried = carried.select(*keys, "__block", F.last("x.__r", ignorenulls=True).over(over).alias("__c")).where("__c is not null")
    out = found.join(carried, [*keys, "__block"], "left").withColumn("__m", F.coalesce("__m", "__c"))
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys], F.col("__t").isNotNull())
    return out.select(*keys, *[F.col(f"__l.{c}").alias(c) for c in names], *[F.when(known, F.col(f"__m.{c}")).alias(c) for c in values])


def lookup_join(left: DataFrame, dim: DataFrame, keys: list[str], defaults: dict[str, object]) -> DataFrame:
    """Left join to a dimension; missing rows get ``defaults``. Spark broadcasts the dimension if its size allows."""
    out = left.join(dim, keys, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def rule_filter(events: DataFrame, rules: DataFrame, keys: list[str], et: str, rt: str, field: str, rule: str) -> DataFrame:
    """Events whose ``field`` equals the newest rule at their time."""
    return asof_join(events, rules, keys, et, rt, [rule]).where(F.col(field) == F.col(rule))


def gate(events: DataFrame, switches: DataFrame, keys: list[str], et: str, st: str, seconds: float) -> DataFrame:
    """Events of a key in the ``seconds`` after one of its switch rows, switch time included and end excluded. One shuffle: the last switch at or before an event decides."""
    s = switches.select(*keys, F.col(st).alias("__switch"))
    found = asof_join(events, s, keys, et, "__switch", ["__switch"])
    return found.where(micros(et) < micros("__switch") + int(seconds * 1e6)).drop("__switch")


def not_in(left: DataFrame, right: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Left rows whose ``column`` is NOT IN that of the right rows of the same keys, with SQL's nulls: a null on the right rejects all, a null on the left is rejected unless the right has no row.

    Two equi-joins: one with a row per key (are there rows, are there nulls), one anti-join.
    """
    about = right.groupBy(*keys).agg(F.max(F.col(column).isNull()).alias("__null"))
    kept = left.join(about, keys, "left").where("__null is null or (not __null and {} is not null)".format(column)).drop("__null")
    return kept.join(right.select(*keys, column), [*keys, column], "left_anti")
