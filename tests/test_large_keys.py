"""Operators that give one key to many tasks: same results as the plain forms, on random tables with ties, nulls and one key alone."""

import random
import time

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from rillflow.operators import aggregates as A
from rillflow.operators import patterns as P
from rillflow.operators import windows as W


def table(spark, rng, n, keys=(1, 1, 1, 2, None), gap=40):
    t, rows = 0, []
    for i in range(n):
        t += rng.choice([0, 0, 1, 2, 5, rng.randrange(1, gap)])
        rows.append((rng.choice(keys), t, i, rng.choice([None, 1, 2, 7])))
    return rows, spark.createDataFrame([(k, t, i, v) for k, t, i, v in rows], "k int, t long, i long, v long").withColumn("ts", F.timestamp_seconds("t")).repartition(4)


def greedy(rows, seconds):
    out, by = [], {}
    for k, t, _, _ in rows:
        by.setdefault(k, []).append(t)
    for k, times in by.items():
        armed = base = None
        for j, t in enumerate(sorted(times)):
            if armed is None or t >= armed + seconds:
                if armed is not None:
                    out.append((k, armed, j, j - base))
                armed, base = t, j
        out.append((k, armed, len(times), len(times) - base))
    return sorted(out, key=str)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("rows_per_key", [1, 30, 10**6])
@pytest.mark.parametrize("seconds", [1, 17, 300])
def test_timer_chain(spark, rows_per_key, seconds):
    rng = random.Random(seconds)
    rows, df = table(spark, rng, 400)
    found = W.timer_chain(df, ["k"], "ts", seconds, rows_per_key)
    assert "Pandas" not in plan_of(found) and "Arrow" not in plan_of(found)
    got = sorted(((r["k"], int(r["a"]), r["n"], r["m"]) for r in found.select("k", F.unix_seconds("armed").alias("a"), "n", "m").collect()), key=str)
    assert got == greedy(rows, seconds)
    assert W.timer_chain(df.limit(0), ["k"], "ts", seconds, rows_per_key).count() == 0


def test_timer_chain_of_one_key_is_many_tasks(spark):
    df = spark.range(60_000).select(F.lit(1).alias("k"), F.timestamp_micros(F.col("id") * 700_000 + F.col("id") % 7 * 90_000).alias("ts"))
    times = [(1, (i * 700_000 + i % 7 * 90_000), i, 0) for i in range(60_000)]
    found = W.timer_chain(df, ["k"], "ts", 10, 1_000).select(F.unix_micros("armed").alias("a"), "n", "m").collect()
    assert sorted((r["a"], r["n"], r["m"]) for r in found) == sorted(r[1:] for r in greedy(times, 10_000_000))
    jumps = spark.range(60_000).select(F.lit(1).alias("k"), F.floor(F.col("id") / 14).alias("b")).repartition(4, "k", "b")
    assert jumps.select(F.spark_partition_id()).distinct().count() == 4


@pytest.mark.parametrize("rows_per_block", [3, 50, 10**6])
def test_running(spark, rows_per_block):
    rng = random.Random(3)
    _, df = table(spark, rng, 500)
    w = Window.partitionBy("k").orderBy("ts", "i").rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("k", "i", F.sum("v").over(w).alias("s"), F.count("v").over(w).alias("n"), F.max("v").over(w).alias("hi"), F.min("v").over(w).alias("lo"))
    got = A.running(df, ["k"], ["ts", "i"], {"s": (F.sum, "v"), "n": (F.count, "v"), "hi": (F.max, "v"), "lo": (F.min, "v")}, rows_per_block)
    assert set(got.columns) == {*df.columns, "s", "n", "hi", "lo"} and dict(got.dtypes)["s"] == "bigint"
    assert sorted(map(tuple, got.select(want.columns).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_blocks_cut_one_key(spark):
    df = spark.range(40_000).select(F.lit(None).cast("int").alias("k"), F.pmod(F.col("id") * 7919, F.lit(40_000)).alias("i"))
    blocks = A.key_blocks(df, ["k"], "i", 1_000).groupBy("__block").agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("lo"), F.max("i").alias("hi")).orderBy("__block").collect()
    assert len(blocks) >= 30 and max(b["n"] for b in blocks) < 2_500
    assert all(a["hi"] < b["lo"] for a, b in zip(blocks, blocks[1:]))
    assert A.key_blocks(df, ["k"], "i", 40_000) is None


def test_count_windows(spark):
    rng = random.Random(5)
    _, df = table(spark, rng, 600)
    df = df.withColumn("v", F.coalesce("v", F.lit(0)))
    for size, slide in ((10, 5), (50, 20), (7, 7), (3, 10)):
        plain, split = (W.count_slide(df, ["k"], ["i"], size, slide, {"s": (F.sum, "v")}, n) for n in (10**6, 40))
        assert plain.count() > 0 and sorted(map(tuple, plain.collect()), key=str) == sorted(map(tuple, split.collect()), key=str)
    for f in (lambda n: W.count_tumble(df, ["k"], ["i"], 9, F.sum("v").alias("s"), rows_per_block=n), lambda n: A.every_n_sum(df, ["k"], ["i"], F.col("v"), 9, True, n)):
        assert sorted(map(tuple, f(10**6).collect()), key=str) == sorted(map(tuple, f(40).collect()), key=str)


def test_patterns_in_blocks(spark):
    """Row patterns and counts that expire are the same, whether or not a key is cut."""
    rng = random.Random(8)
    _, df = table(spark, rng, 600, keys=(1, 1, 1, None), gap=12)
    df = df.groupBy("k", "ts").agg(F.max("v").alias("v"), F.max("i").alias("i"))  # one row a time
    cases = {
        "v": lambda n: P.v_shape(df, ["k"], "ts", "v", n),
        "next": lambda n: P.consecutive(df, ["k"], ["ts"], "ts", F.col("v") > 1, 3, n),
        "rise": lambda n: P.rising_alerts(df, ["k"], "ts", "v", 2, n),
        "ttl": lambda n: W.counted_with_ttl(df, ["k"], "ts", "i", 6, "n", n),
        "beside": lambda n: A.neighbours(df, ["k"], ["ts"], {"b": F.col("v")}, {"a": F.col("i")}, n),
    }
    for name, f in cases.items():
        plain, split = (sorted(map(tuple, f(n).collect()), key=str) for n in (None, 25))
        assert plain and plain == split, name


def test_last_rows_are_ranges(spark):
    """A row that nothing displaces is one row of the result, however many fires find it."""
    df = spark.createDataFrame([(1, 0, "a"), (1, 7, "b"), (1, 3_000_000, "c")], "k int, t long, x string").withColumn("ts", F.timestamp_seconds("t"))
    held = W.last_rows_ranges(df, ["k"], "ts", "x", 5, 2)
    assert {r["x"]: r["fires"] for r in held.collect()} == {"a": (3_000_000_000 - 5_000) // 5_001 + 1, "b": (3_000_000_000 - 5_000) // 5_001}
    short = df.where("t < 8")
    ticks = W.last_rows_ticks(short, ["k"], "ts", "x", 5, 2, until=21_000_000)
    assert sorted((r["x"], r["fired"].timestamp() * 1000 // 1) for r in ticks.collect()) == [("a", 5000), ("a", 10001), ("a", 15002), ("a", 20003), ("b", 10001), ("b", 15002), ("b", 20003)]


def followed(rows, within):
    out = []
    for k, t, _, p in rows:
        if p is None:
            continue
        later = [(u, q) for j, u, _, q in rows if j == k and t < u < t + within]
        stop = min([u for u, q in later if q == p or q is None], default=None)
        # the run ends before the first row, in order of time and place (no place last), of the own place or of none
        run = []
        for u, q in sorted(later, key=lambda x: (x[0], x[1] is None, x[1] or 0)):
            if stop is not None and u == stop and (q == p or q is None):
                break
            run.append(u)
        if run:
            out.append((k, t, run[-1], len(run)))
    return sorted(out, key=str)


def test_followed_elsewhere(spark):
    rng = random.Random(6)
    for gap in (2, 40):
        rows, df = table(spark, rng, 250, keys=(1, 1, 2), gap=gap)
        found = P.followed_elsewhere(df, ["k"], "ts", "v", "30 seconds")
        got = sorted(((r[0], *r[1:]) for r in found.select("k", F.unix_seconds("start_ts"), F.unix_seconds("end_ts"), "n").collect()), key=str)
        assert got == followed(rows, 30)


def test_followed_elsewhere_is_linear(spark):
    """100,000 rows of one key in one frame, which sliding frames took minutes for."""
    df = spark.range(100_000).select(F.lit(1).alias("k"), F.timestamp_micros("id").alias("ts"), F.when(F.col("id") % 50_000 == 0, F.lit("x")).otherwise(F.col("id").cast("string")).alias("p"))
    start = time.time()
    out = P.followed_elsewhere(df, ["k"], "ts", "p", "1 hour")
    got = out.agg(F.count(F.lit(1)), F.max("n")).first()
    assert tuple(got) == (99_999, 99_998) and time.time() - start < 60
