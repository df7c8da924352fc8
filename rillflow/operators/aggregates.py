"""Running, incremental and keyed aggregates."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a key beyond which its rows are dealt to several tasks.
ROWS_PER_BLOCK = 1_000_000

#: Keys of several rows that are sent to all tasks at most.
SHARED_KEYS = 1_000_000


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys``, null keys being equal; of the key columns the left ones stay."""
    r = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
    return left.join(r, on, how).drop(*[f"__r_{k}" for k in keys])


def lower_bound(sorted_array: Column, value: Column) -> Column:
    """Index of the first element that isn't below ``value``, the array's size if there is none: a binary search. The array should be a column or a lambda's variable, as it is named in each step."""
    mid = lambda s: F.floor((s["lo"] + s["hi"]) / 2).cast("int")
    step = lambda s, _: F.when(s["lo"] >= s["hi"], s).when(F.get(sorted_array, mid(s)) < value, F.struct((mid(s) + 1).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), mid(s).alias("hi")))
    return F.aggregate(F.sequence(F.lit(0), F.char_length(F.bin(F.size(sorted_array)))), F.struct(F.lit(0).alias("lo"), F.size(sorted_array).alias("hi")), step)["lo"]


def large_keys(df: DataFrame, keys: list[str], rows_per_block: int | None = ROWS_PER_BLOCK) -> int | None:
    """``rows_per_block`` if a key has more rows than that, else None: one count by key, combined in each task, for operators that would ask for blocks several times."""
    if rows_per_block is None or df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > rows_per_block).isEmpty():
        return None
    return rows_per_block


def key_blocks(df: DataFrame, keys: list[str], order: str, rows_per_block: int | None = ROWS_PER_BLOCK, most: int = 1024) -> DataFrame | None:
    """``df`` with __block, which cuts the rows of large keys at approximate quantiles of ``order`` (a number or a time), or None if no key has more than ``rows_per_block`` rows (or that is None).

    Blocks of a key ascend with ``order``, equal values (and nulls, which come first) are in one block, and keys that aren't large have block 0. What
    is read ahead is a count of rows by key, combined in each task. Quantiles are taken of large keys only; they are joined to the rows by key, a join whose large keys adaptive execution splits.
    """
    kind = dict(df.dtypes)[order]
    if rows_per_block is None or "timestamp" not in kind and kind not in ("date", "tinyint", "smallint", "int", "bigint", "float", "double") and "decimal" not in kind:
        return None
    value = F.unix_micros(F.col(order).cast("timestamp")) if kind == "date" or "timestamp" in kind else F.col(order).cast("long")
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > rows_per_block)
    top = counts.agg(F.max("__n")).first()[0]
    if top is None:
        return None
    pieces = min(-(-top // rows_per_block), most)
    large = null_safe(df.select(*keys, value.alias("__v")), counts.select(*keys), keys)
    cuts = large.groupBy(*keys).agg(F.percentile_approx("__v", [i / pieces for i in range(1, pieces)], 4 * pieces).alias("__cuts"))
    rows = null_safe(df.withColumn("__v", value), cuts, keys, "left")
    return rows.withColumn("__block", F.coalesce(lower_bound(F.col("__cuts"), F.col("__v") + 1), F.lit(0))).drop("__v", "__cuts")


def _row_counts(df: DataFrame, keys: list[str], array: Column, element: str) -> DataFrame:
    """A row for each distinct element of each row's array: where it starts in the sorted array tells how often it is there. The outer inline keeps Spark from building the array a second time to test for empty ones."""
    a = F.col("__a")
    rows = df.select(*keys, F.sort_array(array).alias("__a"))
    first = F.when(F.size(a) > 0, F.filter(F.sequence(F.lit(1), F.size(a)), lambda i: (i == 1) | ~F.get(a, i - 1).eqNullSafe(F.get(a, i - 2))))
    rows = rows.select(*keys, "__a", first.alias("__first"))
    each = F.transform("__first", lambda i, k: F.struct(F.get(a, i - 1).alias(element), (F.coalesce(F.get("__first", k + 1), F.size(a) + 1) - i).cast("long").alias("n")))
    return rows.select(*keys, F.inline_outer(each)).where(F.col("n").isNotNull())


def element_counts(df: DataFrame, keys: list[str], array: Column, element: str, shared_keys: int = SHARED_KEYS) -> DataFrame:
    """How often (n) each element is in the arrays of a key: what groups the exploded rows by key and ``element``, without a shuffle of them.

    Elements are counted inside each row; only rows whose key others share are exploded and grouped, with a shuffle. Which keys these are is read ahead, as a count of rows by
    key; they are broadcast, and with more than ``shared_keys`` of them all rows are grouped. A row's array has to fit in a task, as it has for explode.
    """
    shared = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > 1).select(*keys)
    several = shared.count()
    if not several:
        return _row_counts(df, keys, array, element)
    grouped = lambda rows: rows.select(*keys, F.explode(array).alias(element)).groupBy(*keys, element).agg(F.count(F.lit(1)).alias("n"))
    if several > shared_keys:
        return grouped(df)
    alone = null_safe(df, F.broadcast(shared), keys, "left_anti")
    return _row_counts(alone, keys, array, element).unionByName(grouped(null_safe(df, F.broadcast(shared), keys, "left_semi")))


def _added(a: Column, b: Column) -> Column:
    return F.coalesce(a + b, a, b)


#: How totals of blocks go on: the aggregate of totals, and what puts two of them together.
_MERGES: dict[Callable, tuple] = {F.sum: (F.sum, _added), F.count: (F.sum, _added), F.max: (F.max, F.greatest), F.min: (F.min, F.least)}


def running(df: DataFrame, keys: list[str], order: list[str], aggs: dict[str, Column | tuple], rows_per_block: int | None = ROWS_PER_BLOCK) -> DataFrame:
    """Each row with aggregates of its key over all rows up to it. aggs: name -> aggregate column, or (F.sum, F.count, F.max or F.min, column).

    In the second form a key with more than ``rows_per_block`` rows is the work of many tasks: aggregates run inside blocks of its rows (``key_blocks``), totals of blocks, a
    narrow table, are carried to later ones, and both are put together. ``order`` should tell rows apart.
    """
    blocked = key_blocks(df, keys, order[0], rows_per_block) if all(isinstance(a, tuple) for a in aggs.values()) else None
    up_to = lambda *by: Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    if blocked is None:
        return df.withColumns({n: (a[0](a[1]) if isinstance(a, tuple) else a).over(up_to(*keys)) for n, a in aggs.items()})
    inside = blocked.withColumns({n: f(c).over(up_to(*keys, "__block")) for n, (f, c) in aggs.items()})
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    totals = blocked.groupBy(*keys, "__block").agg(*[f(c).alias(n) for n, (f, c) in aggs.items()])
    totals = totals.select(*keys, "__block", *[_MERGES[f][0](n).over(before).alias(f"__b_{n}") for n, (f, _) in aggs.items()])
    out, kinds = null_safe(inside, totals, [*keys, "__block"]), dict(inside.dtypes)
    return out.withColumns({n: _MERGES[f][1](F.col(n), F.col(f"__b_{n}")).cast(kinds[n]) for n, (f, _) in aggs.items()}).select(*df.columns, *aggs)


def neighbours(df: DataFrame, keys: list[str], order: list[str], before: dict[str, Column], after: dict[str, Column], rows_per_block: int | None = ROWS_PER_BLOCK) -> DataFrame:
    """Each row with columns of the row before it and after it in its key: name -> column.

    A key with more than ``rows_per_block`` rows is cut into blocks; a block's first and last row get their neighbours from a table of the blocks' ends. ``order`` should tell rows apart.
    """
    blocked = key_blocks(df, keys, order[0], rows_per_block)
    w = Window.partitionBy(*keys, *([] if blocked is None else ["__block"])).orderBy(*order)
    beside = {n: F.lag(c).over(w) for n, c in before.items()} | {n: F.lead(c).over(w) for n, c in after.items()}
    if blocked is None:
        return df.withColumns(beside)
    rows = blocked.withColumns(beside | {"__start": F.lag(F.lit(1)).over(w).isNull(), "__end": F.lead(F.lit(1)).over(w).isNull()})
    pack = lambda columns: F.struct(*[c.alias(n) for n, c in columns.items()], F.lit(1).alias("__one"))
    ends = blocked.groupBy(*keys, "__block").agg(F.max_by(pack(before), F.struct(*order)).alias("__tail"), F.min_by(pack(after), F.struct(*order)).alias("__head"))
    by = Window.partitionBy(*keys).orderBy("__block")
    ends = ends.select(*keys, "__block", F.lag("__tail").over(by).alias("__tail"), F.lead("__head").over(by).alias("__head"))
    out = null_safe(rows, ends, [*keys, "__block"])
    of = {n: F.when(F.col("__start"), F.col(f"__tail.{n}")).otherwise(F.col(n)) for n in before} | {n: F.when(F.col("__end"), F.col(f"__head.{n}")).otherwise(F.col(n)) for n in after}
    return out.withColumns(of).select(*df.columns, *before, *after)


def extreme_row(df: DataFrame, keys: list[str], value: str, tie: str, largest: bool = True) -> DataFrame:
    """The whole row with the greatest (or least) value per key; of equal ones the first by ``tie``. One aggregation with partial results, no sort of groups."""
    rest = [c for c in df.columns if c not in keys]
    by = F.struct(value, -F.col(tie)) if largest else F.struct(value, tie)
    pick = (F.max_by if largest else F.min_by)(F.struct(*rest), by)
    return df.groupBy(*keys).agg(pick.alias("x")).select(*keys, "x.*")


def first_row(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """First row per key by ``order``."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("x")).select(*keys, "x.*")


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int, name: str = "rank") -> DataFrame:
    """The first ``n`` rows per key with their rank; Spark cuts to n rows per key before the shuffle."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= n)


def every_n_sum(df: DataFrame, keys: list[str], order: list[str], value: Column, n: int, drop_nth: bool = False, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Sum over each ``n`` rows of a key, emitted when full. With ``drop_nth`` the n-th row fires the sum but isn't in it. Rows of a large key are numbered in blocks (``running``)."""
    rows = running(df, keys, order, {"__rn": (F.count, F.lit(1))}, rows_per_block).withColumn("block", F.floor((F.col("__rn") - 1) / n))
    counted = F.when(F.col("__rn") % n != 0, value) if drop_nth else value
    out = rows.groupBy(*keys, "block").agg(F.count(F.lit(1)).alias("__n"), F.sum(counted).alias("total"))
    return out.where(F.col("__n") == n).drop("__n")


def block_of(df: DataFrame, column: str, rows_per_block: int = 20_000, most: int = 16_384) -> Column:
    """Number of the block of a row: ``column`` (a whole number) is cut at approximate quantiles into blocks of about ``rows_per_block`` rows, larger ones where that would be more than ``most`` blocks.

    Blocks are in the order of the column, and equal values are in one block. Skew in the column makes no large block, unless one value is that frequent. The cuts go to the tasks as a literal; how well
    they hit the quantiles changes the size of blocks only.
    """
    blocks = min(max(1, -(-df.count() // rows_per_block)), most)
    if blocks == 1:
        return F.lit(0)
    found = df.stat.approxQuantile(column, [i / blocks for i in range(1, blocks)], max(1 / (4 * blocks), 1e-5))
    cuts = sorted({int(c) for c in found})
    mid = lambda s: ((s["lo"] + s["hi"]) / 2).cast("int")
    step = lambda s, _: F.when(s["lo"] >= s["hi"], s).when(F.get(F.lit(cuts), mid(s)) <= F.col(column), F.struct((mid(s) + 1).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), mid(s).alias("hi")))
    return F.aggregate(F.sequence(F.lit(0), F.lit(len(cuts).bit_length())), F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi")), step)["lo"]


def block_prefix_max(df: DataFrame, order: str, value: str, name: str, rows_per_block: int = 200_000, blocks_per_group: int = 1024) -> DataFrame:
    """Adds the maximum of ``value`` over all rows before a row in ``order`` (a whole number), without a window over the whole table.

    Maxima of blocks (see ``block_of``) are scanned over groups of blocks, then over the blocks of a group, and then inside each block.
    """
    df = df.withColumn("__block", block_of(df, order, rows_per_block))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    tops = df.groupBy("__block").agg(F.max(value).alias("__top")).withColumn("__group", F.expr(f"__block div {blocks_per_group}"))
    wide = tops.groupBy("__group").agg(F.max("__top").alias("__wide"))
    wide = wide.select("__group", F.max("__wide").over(before(Window.orderBy("__group"))).alias("__wide"))
    tops = tops.select("__block", "__group", F.max("__top").over(before(Window.partitionBy("__group").orderBy("__block"))).alias("__before")).join(wide, "__group")
    inside = before(Window.partitionBy("__block").orderBy(order))
    out = df.withColumn("__in", F.max(value).over(inside)).join(tops, "__block")
    return out.withColumn(name, F.greatest("__in", "__before", "__wide")).drop("__block", "__in", "__before", "__wide", "__group")
