"""Time and count windows.

Time windows are aligned to the epoch. Window columns are plain: window_start, window_end (exclusive) and window_time (end less 1 ms).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import kept
from .aggregates import ROWS_PER_BLOCK, key_blocks, large_keys, lower_bound, neighbours, null_safe, running


def _with_bounds(df: DataFrame, w: str) -> DataFrame:
    return df.withColumns({"window_start": F.col(f"{w}.start"), "window_end": F.col(f"{w}.end"), "window_time": F.expr(f"{w}.end - interval '0.001' second")}).drop(w)


def tumble(df: DataFrame, ts: str, size: str) -> DataFrame:
    """Each row with its tumbling window."""
    return _with_bounds(df.withColumn("__w", F.window(ts, size)), "__w")


def hop(df: DataFrame, ts: str, size: str, slide: str) -> DataFrame:
    """Each row once for every hopping window that holds it; ``slide`` need not divide ``size``."""
    return _with_bounds(df.withColumn("__w", F.window(ts, size, slide)), "__w")


def cumulate(df: DataFrame, ts: str, size: str, step: str) -> DataFrame:
    """Each row once for every cumulating window that holds it: windows of one start that end after each ``step`` up to ``size``."""
    df = df.withColumn("__w", F.window(ts, size))
    ends = F.expr(f"sequence(__w.start + interval {step}, __w.end, interval {step})")
    df = df.withColumn("window_end", F.explode(F.filter(ends, lambda e: e > F.col(ts))))
    return df.withColumns({"window_start": F.col("__w.start"), "window_time": F.expr("window_end - interval '0.001' second")}).drop("__w")


def cumulate_agg(df: DataFrame, keys: list[str], ts: str, size: str, step: str, sums: dict[str, Column], count: str | None = None) -> DataFrame:
    """Sums (and a row count) per key over cumulating windows.

    Rows are aggregated once per step, then the steps of a window are added up: the shuffle carries a row per key and
    step instead of one per input row and window. Windows in which no row has arrived yet are absent; later steps without rows repeat the sums so far.
    """
    parts = [F.sum(c).alias(n) for n, c in sums.items()] + ([F.count(F.lit(1)).alias(count)] if count else [])
    names = [*sums, *([count] if count else [])]
    rows = df.withColumn("__w", F.window(ts, size)).withColumn("__s", F.window(ts, step))
    per = rows.groupBy(*keys, F.col("__w.start").alias("window_start"), F.col("__w.end").alias("__end"), F.col("__s.end").alias("__at")).agg(*parts)
    w = Window.partitionBy(*keys, "window_start").orderBy("__at")
    run = per.select(*keys, "window_start", "__end", "__at", F.lead("__at").over(w).alias("__next"), *[F.sum(n).over(w).alias(n) for n in names])
    ends = F.expr(f"sequence(__at, coalesce(__next - interval {step}, __end), interval {step})")
    return run.withColumn("window_end", F.explode(ends)).select(*keys, "window_start", "window_end", *names)


def session(df: DataFrame, keys: list[str], ts: str, gap: str, *aggs: Column) -> DataFrame:
    """Aggregates per key and session; rows exactly one gap apart are in one session."""
    out = df.groupBy(*keys, F.session_window(ts, gap).alias("w")).agg(*aggs)
    return out.withColumns({"window_start": F.col("w.start"), "window_end": F.col("w.end")}).drop("w")


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "rn", rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Rows numbered from 1 per key; a large key is numbered in blocks by many tasks (``aggregates.running``)."""
    return running(df, keys, order, {name: (F.count, F.lit(1))}, rows_per_block)


def count_tumble(df: DataFrame, keys: list[str], order: list[str], n: int, *aggs: Column, full_only: bool = True, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Aggregates over each ``n`` rows of a key in order; only full windows fire unless ``full_only`` is off."""
    rows = numbered(df, keys, order, "__rn", rows_per_block).withColumn("window_no", F.floor((F.col("__rn") - 1) / n))
    out = rows.groupBy(*keys, "window_no").agg(F.count(F.lit(1)).alias("__n"), *aggs)
    return (out.where(F.col("__n") == n) if full_only else out).drop("__n")


def count_slide(df: DataFrame, keys: list[str], order: list[str], size: int, slide: int, aggs: dict[str, tuple], rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Every ``slide``-th row of a key fires over its last ``size`` rows. aggs: name -> (function, column).

    Where a key has more than ``rows_per_block`` rows, rows are numbered in blocks, and each is dealt to the fires that hold it, which are grouped as windows of time would be.
    """
    if key_blocks(df, keys, order[0], rows_per_block) is None:
        w = Window.partitionBy(*keys).orderBy(*order)
        rows = df.withColumns({"rn": F.row_number().over(w).cast("long"), **{n: f(c).over(w.rowsBetween(-(size - 1), 0)) for n, (f, c) in aggs.items()}})
        return rows.where(F.col("rn") % slide == 0).select(*keys, "rn", *aggs)
    rows = numbered(df, keys, order, "__rn", rows_per_block)
    first, last = F.ceil(F.col("__rn") / slide), F.floor((F.col("__rn") + size - 1) / slide)
    rows = rows.where(first <= last).withColumn("rn", F.explode(F.transform(F.sequence(first, last), lambda k: k * slide)))
    fires = rows.groupBy(*keys, "rn").agg(F.max("__rn").alias("__top"), *[f(c).alias(n) for n, (f, c) in aggs.items()])
    return fires.where(F.col("__top") == F.col("rn")).select(*keys, "rn", *aggs)


def early_count_trigger(df: DataFrame, keys: list[str], order: list[str], size: int, early: int) -> DataFrame:
    """A count window of ``size`` rows that also fires at each ``early``-th row inside it: keys, window_no, fired_at, n."""
    rows = numbered(df, keys, order).withColumn("pos", (F.col("rn") - 1) % size + 1)
    fires = (F.col("pos") % early == 0) | (F.col("pos") == size)
    return rows.where(fires).select(*keys, F.floor((F.col("rn") - 1) / size).cast("long").alias("window_no"), F.col("pos").cast("long").alias("n"))


def periodic_trigger(df: DataFrame, keys: list[str], ts: str, size: str, every: str) -> DataFrame:
    """A tumbling window that fires each ``every`` with the count so far and at its end: keys, window_start, fired_at, n."""
    out = cumulate_agg(df, keys, ts, size, every, {}, "n")
    return out.select(*keys, "window_start", F.col("window_end").alias("fired_at"), "n")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _chain(times: Column, step: int) -> Column:
    """Places of the armed times in a sorted array: the first, and from each the first that isn't less than ``step`` later.

    The next place of each is a binary search. Pointers are then doubled: a list of the first 2^k places and the pointers 2^k ahead give
    the first 2^(k+1) places, so all of a key takes as many passes over its array as its size has binary digits.
    """
    size = F.size(times)
    jumps = F.concat(F.transform(times, lambda t: lower_bound(times, t + step)), F.array(size))
    grown = lambda s, _: F.struct(F.filter(F.concat(s["places"], F.transform(s["places"], lambda p: F.get(s["jumps"], p))), lambda p: p < F.size(s["jumps"]) - 1).alias("places"), F.transform(s["jumps"], lambda j: F.get(s["jumps"], j)).alias("jumps"))
    return F.aggregate(F.sequence(F.lit(1), F.char_length(F.bin(size))), F.struct(F.array(F.lit(0)).alias("places"), jumps.alias("jumps")), grown)["places"]


def _chained_far(times: DataFrame, keys: list[str], step: int, rows_per_key: int) -> DataFrame:
    """The ticks (keys, __t, __before) of keys with very many times (keys, __t, __c), each key by many tasks.

    The next armed time of every time is one look ahead in buckets of ``step``: in the bucket after its own, from its own place on, or else the first time of the next bucket that has any.
    Pointers and the set of armed times are then doubled by joins on key and time until no pointer is left: as many rounds as the number of ticks of
    a key has binary digits, each of them written, with fewer rows each time.
    """
    bucket = lambda t: F.floor(t / step)
    points = times.select(*keys, bucket(F.col("__t")).alias("__b"), F.col("__t").alias("__v"), F.lit(0).alias("__ask"), F.lit(None).cast("long").alias("__from"))
    asks = times.select(*keys, (bucket(F.col("__t")) + 1).alias("__b"), (F.col("__t") + step).alias("__v"), F.lit(1).alias("__ask"), F.col("__t").alias("__from"))
    later = Window.partitionBy(*keys, "__b").orderBy(F.desc("__v"), "__ask").rowsBetween(Window.unboundedPreceding, 0)
    found = points.unionByName(asks).withColumn("__next", F.min(F.when(F.col("__ask") == 0, F.col("__v"))).over(later)).where("__ask = 1")
    firsts = points.groupBy(*keys, "__b").agg(F.min("__v").alias("__first"))
    after = Window.partitionBy(*keys).orderBy("__b")
    gaps = firsts.unionByName(firsts.select(*keys, (F.col("__b") + 1).alias("__b"), F.lit(None).cast("long").alias("__first"))).groupBy(*keys, "__b").agg(F.min("__first").alias("__own"))
    gaps = gaps.withColumn("__then", F.min("__own").over(Window.partitionBy(*keys).orderBy(F.desc("__b")).rowsBetween(Window.unboundedPreceding, -1)))
    jumps = null_safe(found, gaps.drop("__own"), [*keys, "__b"], "left")
    jumps = jumps.select(*keys, F.col("__from").alias("__t"), F.coalesce("__next", "__then").alias("__to")).where("__to is not null")
    armed, jumps = kept(times.groupBy(*keys).agg(F.min("__t").alias("__t"))), kept(jumps)
    while not jumps.isEmpty():
        ahead = null_safe(armed, jumps, [*keys, "__t"]).select(*keys, F.col("__to").alias("__t"))
        armed = kept(armed.unionByName(ahead))
        onward = jumps.select(*keys, F.col("__t").alias("__to"), F.col("__to").alias("__far"))
        jumps = kept(null_safe(jumps, onward, [*keys, "__to"]).select(*keys, "__t", F.col("__far").alias("__to")))
    upto = running(times, keys, ["__t"], {"__upto": (F.sum, "__c")}, rows_per_key)
    upto = upto.select(*keys, "__t", (F.col("__upto") - F.col("__c")).alias("__before"))
    ticks = null_safe(armed, upto, [*keys, "__t"])
    total = times.groupBy(*keys).agg(F.sum("__c").alias("__total"))
    ticks = null_safe(ticks, total, keys)
    return ticks.withColumn("__then", F.coalesce(F.lead("__before").over(Window.partitionBy(*keys).orderBy("__t")), "__total"))


def timer_chain(df: DataFrame, keys: list[str], ts: str, seconds: float, rows_per_key: int = 50_000) -> DataFrame:
    """Ticks of a timer armed by the first row of a key, that fires ``seconds`` later and is armed again by the next row: keys, armed, fired, n (rows of the key before the fire), m (rows since armed).

    Rows are counted by key and time first. The times of a key with at most ``rows_per_key`` of them are one array, in which pointers to the next armed time
    are doubled; other keys are chained by joins (``_chained_far``), so that a key of any size is spread over tasks. Rows with a null time are left out.
    """
    kinds = dict(df.dtypes)
    step = int(seconds * 1_000_000)
    times = df.select(*keys, F.unix_micros(F.col(ts).cast("timestamp")).alias("__t")).where("__t is not null").groupBy(*keys, "__t").agg(F.count(F.lit(1)).alias("__c"))
    large = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > rows_per_key)
    some = not large.isEmpty()
    small = times
    if some:
        large = kept(large.select(*keys))
        small = null_safe(times, large.withColumn("__large", F.lit(True)), keys, "left").where("__large is null").drop("__large")
    w = Window.partitionBy(*keys).orderBy("__t")
    rows = small.withColumns({"__before": F.sum("__c").over(w) - F.col("__c")})
    packed = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("__t", "__before"))).alias("__rows"), F.sum("__c").alias("__total"))
    places = _let(F.col("__rows.__t"), lambda t: _chain(t, step))
    ticks = packed.withColumn("__ticks", _let(places, lambda p: F.transform(p, lambda i: F.get("__rows", i))))
    ends = F.slice("__ticks", 2, 2**30)
    each = F.explode(F.transform(F.arrays_zip("__ticks", ends.alias("__ends")), lambda z: F.struct(z["__ticks"]["__t"].alias("__t"), z["__ticks"]["__before"].alias("__before"), F.coalesce(z["__ends"]["__before"], F.col("__total")).alias("__then"))))
    out = ticks.select(*keys, each.alias("__x")).select(*keys, "__x.*")
    if some:
        far = _chained_far(kept(null_safe(times, large, keys)), keys, step, rows_per_key)
        out = out.unionByName(far.select(*keys, "__t", "__before", "__then"))
    moment = lambda micros: F.timestamp_micros(micros).cast(kinds[ts])
    return out.select(*keys, moment(F.col("__t")).alias("armed"), moment(F.col("__t") + step).alias("fired"), F.col("__then").alias("n"), (F.col("__then") - F.col("__before")).alias("m"))


def counted_with_ttl(df: DataFrame, keys: list[str], ts: str, tie: str, ttl: float, name: str = "n", rows_per_block: int | None = ROWS_PER_BLOCK) -> DataFrame:
    """Adds the rows of a key so far, counted anew where ``ttl`` seconds or more have passed since the row before, as a count that expires does. A large key is cut into blocks."""
    size = large_keys(df, keys, rows_per_block)
    rows = df.withColumn("__t", F.unix_micros(F.col(ts).cast("timestamp")))
    rows = neighbours(rows, keys, ["__t", tie], {"__last": F.col("__t")}, {}, size)
    rows = rows.withColumn("__new", F.coalesce((F.col("__t") - F.col("__last") >= int(ttl * 1_000_000)).cast("int"), F.lit(0)))
    rows = running(rows, keys, ["__t", tie], {"__life": (F.sum, "__new")}, size)
    return numbered(rows, [*keys, "__life"], ["__t", tie], name, size).drop("__t", "__last", "__new", "__life")


def last_rows_ranges(df: DataFrame, keys: list[str], ts: str, tie: str, seconds: float, n: int, until=None) -> DataFrame:
    """A global window that fires ``seconds`` after a key's first row, and then each ``seconds`` and 1 ms after the fire before, with or without new rows, and holds the last ``n`` rows: each row that a fire finds, once, with first_fired, last_fired and fires (their number).

    Rows are in order of ``ts`` and ``tie``; a fire finds those before it. Fires go on to the newest time of the table, or to ``until`` in microseconds. They are at fixed steps from
    the first row, so those that find a row, after it and not after the n-th row that follows, are a range by one look ahead: the result has a row for each input row at most, however long nothing new comes.
    """
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    end = until if until is not None else df.agg(F.max(at)).first()[0]
    step, wait = int(seconds * 1_000_000) + 1000, int(seconds * 1_000_000)
    w = Window.partitionBy(*keys).orderBy("__t", tie)
    rows = df.withColumn("__t", at).withColumns({"__first": F.min("__t").over(w.rowsBetween(Window.unboundedPreceding, 0)), "__then": F.lead("__t", n).over(w)})
    since = lambda t: F.floor((t - F.col("__first") - wait) / step)  # noqa: E731  the last fire at or before a time, from 0
    last = F.least(F.coalesce("__then", F.lit(end)), F.lit(end))
    rows = rows.withColumns({"__from": F.greatest(since(F.col("__t")) + 1, F.lit(0)), "__to": since(last)}).where("__from <= __to")
    fired = lambda k: F.timestamp_micros(F.col("__first") + wait + F.col(k) * step).cast(dict(df.dtypes)[ts])
    return rows.select(*df.columns, fired("__from").alias("first_fired"), fired("__to").alias("last_fired"), (F.col("__to") - F.col("__from") + 1).alias("fires"))


def last_rows_ticks(df: DataFrame, keys: list[str], ts: str, tie: str, seconds: float, n: int, until=None) -> DataFrame:
    """``last_rows_ranges`` with each row once for every fire that finds it, with fired: as many rows as time goes on."""
    held = last_rows_ranges(df, keys, ts, tie, seconds, n, until)
    step = int(seconds * 1_000_000) + 1000
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.col("fires") - 1))
    fired = F.timestamp_micros(F.unix_micros(F.col("first_fired").cast("timestamp")) + F.col("__k") * step).cast(dict(df.dtypes)[ts])
    return held.withColumn("__k", k).withColumn("fired", fired).drop("__k", "first_fired", "last_fired", "fires")
