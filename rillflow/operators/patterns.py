"""Row patterns over ordered rows of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .aggregates import ROWS_PER_BLOCK, large_keys, neighbours, running
from .windows import timer_chain


def v_shape(df: DataFrame, keys: list[str], ts: str, price: str, rows_per_block: int | None = ROWS_PER_BLOCK) -> DataFrame:
    """START DOWN+ UP: keys, start_ts, bottom_ts, end_ts of each match, resumed at its last row.

    A run of falling rows of length two or more, the row before it, and the row after it if its price is above the second-last of the run. Runs
    share no row but a start that ends the match before, so no search is needed: one sort of each key, of blocks of it where it is large.
    """
    size = large_keys(df, keys, rows_per_block)
    p, t = F.col(price), F.col(ts)
    rows = neighbours(df, keys, [ts], {"__p": p, "__t": t}, {"__next": p, "__next_t": t}, size)
    rows = rows.withColumn("__down", F.coalesce(p < F.col("__p"), F.lit(False))).withColumn("__step", F.when(F.col("__down"), 0).otherwise(1))
    rows = running(rows, keys, [ts], {"__run": (F.sum, "__step")}, size)
    runs = rows.where("__down").groupBy(*keys, "__run").agg(F.count(F.lit(1)).alias("n"), F.min("__t").alias("start_ts"), F.max(ts).alias("bottom_ts"), F.max_by("__p", ts).alias("second"), F.max_by("__next", ts).alias("up"), F.max_by("__next_t", ts).alias("end_ts"))
    return runs.where("n >= 2 and up > second").select(*keys, "start_ts", "bottom_ts", "end_ts")


def followed_elsewhere(df: DataFrame, keys: list[str], ts: str, place: str, within: str) -> DataFrame:
    """e1 e2+ WITHIN: from each row, the longest run of rows right after it with another ``place`` than its own and less than ``within`` later: keys, start_ts, end_ts, n. Tried from every row.

    The run ends before the next row of the row's own place (or of no place) and before the time limit, whichever is first. Rows are numbered; the number of the next later row, also of one place or of none, is the least
    one that a pass from the last row back has seen, and the time limit is looked up among the rows by one pass over both, so that the work doesn't depend on how many rows a limit spans.
    """
    order = F.unix_micros(F.col(ts).cast("timestamp"))
    length = df.sparkSession.range(1).select(F.expr(f"cast(unix_micros(timestamp'1970-01-01 00:00:00+00:00' + interval {within}) as bigint)")).first()[0]
    rows = df.select(*keys, F.col(ts).alias("__ts"), order.alias("__t"), F.col(place).alias("__place")).where("__t is not null")
    rows = rows.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy("__t", F.col("__place").isNull(), "__place")))
    back = lambda *by: Window.partitionBy(*keys, *by).orderBy(F.desc("__t")).rangeBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"__from": F.min("__rn").over(back()), "__none": F.min(F.when(F.col("__place").isNull(), F.col("__rn"))).over(back())}).withColumn("__same", F.min("__rn").over(back("__place")))
    seen = rows.select(*keys, F.col("__t").alias("__at"), F.lit(0).alias("__ask"), F.struct("__rn", "__ts").alias("__seen"), F.lit(None).alias("__row"))
    asks = rows.where("__place is not null and __from is not null").select(*keys, (F.col("__t") + length - 1).alias("__at"), F.lit(1).alias("__ask"), F.lit(None).alias("__seen"), F.struct("__ts", "__from", "__none", "__same").alias("__row"))
    upto = Window.partitionBy(*keys).orderBy("__at", "__ask").rowsBetween(Window.unboundedPreceding, 0)
    found = seen.unionByName(asks).withColumn("__to", F.max("__seen.__rn").over(upto)).where("__ask = 1").select(*keys, "__row.*", "__to")
    found = found.withColumn("__last", F.least("__to", F.col("__same") - 1, F.col("__none") - 1)).where("__last >= __from")
    ends = rows.select(*keys, F.col("__rn").alias("__last"), F.col("__ts").alias("end_ts"))
    return found.join(ends, [*keys, "__last"]).select(*keys, F.col("__ts").alias("start_ts"), "end_ts", (F.col("__last") - F.col("__from") + 1).cast("long").alias("n"))


def consecutive(df: DataFrame, keys: list[str], order: list[str], ts: str, hit: Column, times: int = 3, rows_per_block: int | None = ROWS_PER_BLOCK) -> DataFrame:
    """``times`` neighbouring rows that all satisfy ``hit``: keys, t1 ... tn. Matches overlap."""
    size = large_keys(df, keys, rows_per_block)
    rows = df.withColumns({"t1": F.col(ts), "__h1": hit})
    for i in range(2, times + 1):
        rows = neighbours(rows, keys, order, {}, {f"t{i}": F.col(f"t{i - 1}"), f"__h{i}": F.col(f"__h{i - 1}")}, size)
    return rows.where(" and ".join(f"__h{i}" for i in range(1, times + 1))).select(*keys, *[f"t{i}" for i in range(1, times + 1)])


def relaxed_times(df: DataFrame, keys: list[str], order: list[str], ts: str, hit: Column, times: int = 3) -> DataFrame:
    """``times`` neighbours among the rows that satisfy ``hit``, whatever lies between: keys, t1 ... tn. Matches overlap."""
    return consecutive(df.where(hit), keys, order, ts, F.lit(True), times)


def rising_alerts(df: DataFrame, keys: list[str], ts: str, value: str, seconds: int, rows_per_block: int | None = ROWS_PER_BLOCK) -> DataFrame:
    """Alerts while values rise without a break: keys, alert_ts.

    A row above the one before (the first row of a key too) arms a timer ``seconds`` later if none is armed; a row that isn't above cancels it. When the timer fires, there is an alert, and the next rising row arms it again. A
    timer due at the time of the row that breaks the run still fires; at the end of the input, those due by the run's last row fire.
    """
    size = large_keys(df, keys, rows_per_block)
    rows = neighbours(df, keys, [ts], {"__p": F.col(value), "__has": F.lit(1)}, {"__next": F.col(ts)}, size)
    rows = rows.withColumn("__rise", F.coalesce(F.col(value) > F.col("__p"), F.col("__has").isNull())).withColumn("__step", F.when(F.col("__rise"), 0).otherwise(1))
    rows = running(rows, keys, [ts], {"__run": (F.sum, "__step")}, size).where("__rise")
    ends = rows.groupBy(*keys, "__run").agg(F.max(F.coalesce("__next", ts)).alias("__end"))
    ticks = timer_chain(rows.select(*keys, "__run", ts), [*keys, "__run"], ts, seconds)
    return ticks.join(ends, [*keys, "__run"]).where("fired <= __end").select(*keys, F.col("fired").alias("alert_ts"))
