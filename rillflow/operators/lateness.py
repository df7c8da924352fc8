"""Lateness in arrival order: which rows a watermark of ``max(ts) - disorder`` lets pass.

Rows are ordered by a whole-number arrival column, m is the greatest ts before a row, [s, e) its tumbling window. The
watermark is of the whole stream, not of a key. ``aggregates.block_prefix_max`` gives m without a window over the whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .aggregates import block_prefix_max, running
from .joins import asof_join


def _seen(df: DataFrame, ts: str, arrival: str, size: str | None = None) -> DataFrame:
    rows = block_prefix_max(df, arrival, ts, "__m")
    if size:
        rows = rows.withColumn("__w", F.window(ts, size)).withColumns({"window_start": F.col("__w.start"), "window_end": F.col("__w.end")}).drop("__w")
    return rows


def _passed(moment: str, limit: str) -> Column:
    return F.coalesce(F.expr(f"{moment} >= {limit}"), F.lit(False))


def flag_late(df: DataFrame, ts: str, arrival: str, disorder: str) -> DataFrame:
    """Adds late: ts is before m - disorder - 1 ms."""
    rows = _seen(df, ts, arrival)
    late = F.expr(f"{ts} < __m - interval {disorder} - interval '0.001' second")
    return rows.withColumn("late", F.coalesce(late, F.lit(False))).drop("__m")


def drop_late(df: DataFrame, ts: str, arrival: str, size: str, disorder: str) -> DataFrame:
    """Rows whose window is still open when they arrive, with window_start and window_end."""
    rows = _seen(df, ts, arrival, size)
    return rows.where(~_passed(f"__m - interval {disorder}", "window_end")).drop("__m")


def split_late(df: DataFrame, ts: str, arrival: str, size: str, disorder: str, lateness: str) -> DataFrame:
    """Adds side: the row comes more than the allowed lateness after its window closed."""
    rows = _seen(df, ts, arrival, size)
    return rows.withColumn("side", _passed(f"__m - interval {disorder}", f"window_end + interval {lateness}")).drop("__m")


def refire(df: DataFrame, keys: list[str], ts: str, arrival: str, size: str, disorder: str, lateness: str, flush: bool = False) -> DataFrame:
    """Counts that windows emit: window_start, window_end, keys, fire_no (from 1), n.

    A window fires first when the watermark reaches its end, with the rows so far, and once more for each late row within
    ``lateness``. Windows that the watermark doesn't reach are emitted only with ``flush``.
    """
    rows = _seen(df, ts, arrival, size)
    last = F.expr(f"{'timestamp_ntz' if dict(df.dtypes)[ts] == 'timestamp_ntz' else 'timestamp'}'9999-01-01'") if flush else None
    top = df.agg(F.max(ts)).first()[0]
    reached = last if flush else F.lit(top).cast(dict(df.dtypes)[ts]) - F.expr(f"interval {disorder}")
    rows = rows.where(~_passed(f"__m - interval {disorder}", f"window_end + interval {lateness}"))
    rows = rows.withColumn("__again", _passed(f"__m - interval {disorder}", "window_end").cast("int"))
    group = [*keys, "window_start", "window_end"]
    w = Window.partitionBy(*group).orderBy(arrival)
    rows = rows.withColumns({"n": F.row_number().over(w), "__later": F.sum("__again").over(w), "__nexts": F.lead("__again").over(w)})
    first = rows.where((F.col("__again") == 0) & (F.coalesce("__nexts", F.lit(1)) == 1) & (F.col("window_end") <= reached))
    early = first.select(*group, F.lit(1).cast("long").alias("fire_no"), F.col("n").cast("long").alias("n"))
    had = rows.groupBy(*group).agg(F.max((F.col("__again") == 0).cast("int")).alias("__had"))
    again = rows.where("__again = 1").join(had, group).select(*group, (F.col("__later") + F.col("__had")).cast("long").alias("fire_no"), F.col("n").cast("long").alias("n"))
    return early.unionByName(again)


def released(df: DataFrame, keys: list[str], ts: str, arrival: str, mark: Column) -> DataFrame:
    """Rows with late and released_by, for a watermark of each key that moves with its rows.

    ``mark`` is the watermark that a row announces for the rows after it, or null (``streaming.marked`` has the usual ones). A row at or before the watermark is late; others wait for the
    first row of their key whose watermark reaches them, released_by is its ``arrival``, null if none does. The watermark is a running maximum (in blocks for large keys), its steps are
    one row for each value, and a row's step is an as-of look-up. Rows with a null time are left out.
    """
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    rows = df.where(F.col(ts).isNotNull()).withColumns({"__own": micros(mark), "__t": micros(F.col(ts))})
    rows = running(rows, keys, [arrival], {"__mark": (F.max, "__own")})
    rows = rows.withColumns({"late": F.coalesce(F.col("__t") <= F.col("__mark"), F.lit(False)), "__need": -F.col("__t")})
    steps = rows.where("__mark is not null").groupBy(*keys, "__mark").agg(F.min(arrival).alias("released_by")).select(*keys, (-F.col("__mark")).alias("__have"), "released_by")
    found = asof_join(rows.drop("__own", "__mark", "__t"), steps, keys, "__need", "__have", ["released_by"])
    return found.withColumn("released_by", F.when(~F.col("late"), F.col("released_by"))).drop("__need")
