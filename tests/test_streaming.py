"""Streams over files give the result of the batch form."""

import time
import uuid

import pytest
from pyspark.sql import functions as F

from rillflow import sources, streaming
from rillflow.operators import keyed

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"


def files(spark, sf, path, n=4):
    rows = spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    for i in range(n):
        rows.where((F.floor(F.col("event_id") / 60) % n) == i).coalesce(1).write.mode("append").parquet(path)
    return rows


def in_order(spark, sf, path, n=4):
    """One file per quarter of the rows, in time order by modification time."""
    rows = spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    size = rows.count() // n + 1
    for i in range(n):
        rows.where(F.floor(F.col("event_id") / size) == i).coalesce(1).write.mode("append").parquet(path)
    return rows


def back(spark, path):
    return spark.read.parquet(path)


def same(a, b, columns):
    return sorted(map(tuple, a.select(columns).collect()), key=str) == sorted(map(tuple, b.select(columns).collect()), key=str)


def test_window_agg(spark, sf, tmp_path):
    rows = in_order(spark, sf, f"{tmp_path}/in")
    stream = streaming.watermarked(sources.file_source(spark, f"{tmp_path}/in", SCHEMA, "parquet", 1), "ts", "1 hour")
    agg = lambda df: streaming.window_agg(df, ["event_type"], "ts", "1 day", F.count(F.lit(1)).alias("n"))
    streaming.run_available(agg(stream), f"{tmp_path}/cp", streaming.appended(f"{tmp_path}/out"))
    last = rows.agg(F.max("ts") - F.expr("interval 1 hour")).first()[0]
    want = agg(rows).where(F.col("window_end") <= F.lit(last))
    assert same(back(spark, f"{tmp_path}/out"), want, ["event_type", "window_start", "n"])


def test_interval_join(spark, sf, tmp_path):
    rows = in_order(spark, sf, f"{tmp_path}/in")
    stream = lambda: streaming.watermarked(sources.file_source(spark, f"{tmp_path}/in", SCHEMA, "parquet", 2), "ts", "1 hour")
    pick = lambda df, kind, i, c: df.where(F.col("event_type") == kind).select(F.col("event_id").alias(i), "user_id", F.col("ts").alias(c))
    join = lambda l, r: streaming.interval_join(pick(l, "purchase", "buy", "bt"), pick(r, "view", "view", "vt"), ["user_id"], "bt", "vt", "6 hours", "6 hours")
    streaming.run_available(join(stream(), stream()), f"{tmp_path}/cp", streaming.appended(f"{tmp_path}/out"))
    assert same(back(spark, f"{tmp_path}/out"), join(rows, rows), ["buy", "view"])


def test_pv_timer(spark, sf, tmp_path):
    rows = in_order(spark, sf, f"{tmp_path}/in")
    stream = streaming.watermarked(sources.file_source(spark, f"{tmp_path}/in", SCHEMA, "parquet", 1), "ts", "0 seconds")
    streaming.run_available(streaming.pv_timer(stream, "user_id", "ts", 6 * 3600, 12 * 3600), f"{tmp_path}/cp", streaming.appended(f"{tmp_path}/out"))
    got = sorted(map(tuple, back(spark, f"{tmp_path}/out").select("user_id", "armed", "pv").collect()))
    last = rows.agg(F.max("ts")).first()[0].timestamp()
    times = {}
    for r in rows.orderBy("ts").collect():
        times.setdefault(r["user_id"], []).append(r["ts"].timestamp())
    want = set()
    for user, ts in times.items():
        armed, pv, before = None, 0, None
        for t in [*ts, last + 1e9]:
            if armed is not None and t >= armed + 6 * 3600:
                if armed + 6 * 3600 <= last:
                    want.add((user, int(armed * 1000 + 1e-3), pv))
                armed = None
            armed = t if armed is None else armed
            pv, before = (1 if before is not None and t - before >= 12 * 3600 else pv + 1), t
    assert len(got) >= len(want) > 0 and want <= set(got)


def test_tally_by_processing_time(spark, sf, tmp_path):
    """Timers of the clock fire between batches, each with its key's whole map so far."""
    rows = in_order(spark, sf, f"{tmp_path}/in", 2)
    stream = streaming.tally(sources.file_source(spark, f"{tmp_path}/in", SCHEMA, "parquet", 1), "event_type", "user_id", 0.2)
    want = {(r["event_type"], str(r["user_id"])): r["n"] for r in rows.groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    got, fires = {}, []

    def sink(batch, batch_id):
        out = batch.collect()
        fires.extend({r["event_type"] for r in out})
        got.update({(r["event_type"], r["user_id"]): r["n"] for r in out})

    query = streaming.started(stream, f"{tmp_path}/cp", sink, "300 milliseconds")
    until = time.time() + 120
    while got != want and time.time() < until and query.isActive:
        time.sleep(0.3)
    query.stop()
    assert got == want and len(fires) >= len({k for k, _ in want})


def test_folded_state(spark, sf, tmp_path):
    """Reducing (a maximum) and aggregating (a mean) state, over several batches."""
    rows = in_order(spark, sf, f"{tmp_path}/in")
    stream = lambda: sources.file_source(spark, f"{tmp_path}/in", SCHEMA, "parquet", 1)
    cases = {"max": ((float("-inf"),), lambda a, s: (max(a[0], s.max()),), lambda a: a[0]), "mean": ((0.0, 0.0), lambda a, s: (a[0] + s.sum(), a[1] + len(s)), lambda a: a[0] / a[1])}
    for name, (zero, add, result) in cases.items():
        streaming.run_available(streaming.folded(stream(), "event_type", "value", zero, add, result), f"{tmp_path}/cp{name}", streaming.appended(f"{tmp_path}/{name}"), mode="update")
        out = back(spark, f"{tmp_path}/{name}").groupBy("event_type").agg(F.max_by("result", "batch_id").alias("x"))
        want = {r[0]: r[1] for r in rows.groupBy("event_type").agg((F.max if name == "max" else F.avg)("value")).collect()}
        got = {r[0]: r[1] for r in out.collect()}
        assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_count_window(spark, sf, tmp_path):
    rows = in_order(spark, sf, f"{tmp_path}/in")
    stream = sources.file_source(spark, f"{tmp_path}/in", SCHEMA, "parquet", 1)
    streaming.run_available(streaming.count_window(stream, "event_type", "value", 10), f"{tmp_path}/cp", streaming.appended(f"{tmp_path}/out"))
    counts = {r["event_type"]: r["n"] for r in back(spark, f"{tmp_path}/out").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert counts == {r["event_type"]: r["n"] // 10 for r in rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).collect()}


def test_sinks(spark, sf, tmp_path):
    rows = files(spark, sf, f"{tmp_path}/in")
    stream = sources.file_source(spark, f"{tmp_path}/in", SCHEMA, "parquet", 1)
    keep = lambda f: lambda b, i: f(b.select("user_id", "event_id", "event_type", (F.col("user_id") % 3).alias("part")), i)
    sink = streaming.fan_out(keep(streaming.upserts(f"{tmp_path}/t", ["user_id"], ["event_id"])), streaming.buffered(f"{tmp_path}/b", 100, streaming.appended(f"{tmp_path}/full")))
    streaming.run_available(stream, f"{tmp_path}/cp", sink)
    want = keyed.upsert_latest(rows.select("user_id", "event_id", "event_type"), ["user_id"], ["event_id"])
    assert same(keyed.upsert_latest(spark.read.parquet(f"{tmp_path}/t"), ["user_id"], ["event_id"]), want, ["user_id", "event_id", "event_type"])
    assert 0 < back(spark, f"{tmp_path}/full").count() <= rows.count()


def test_late_split(spark, sf, tmp_path):
    spark.sql("select 1L as event_id, timestamp'2024-01-01 10:00:00' as ts, 1L as user_id, 'a' as event_type, 0D as value").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    spark.sql("select * from values (2L, timestamp'2024-01-01 05:00:00', 1L, 'late', 0D), (3L, timestamp'2024-01-01 09:55:00', 1L, 'in', 0D) as t(event_id, ts, user_id, event_type, value)").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = sources.file_source(spark, f"{tmp_path}/in", SCHEMA, "parquet", 1)
    streaming.run_available(stream, f"{tmp_path}/cp", streaming.late_split(f"{tmp_path}/s", "ts", "1 hour", "1 minute", "10 minutes", streaming.appended(f"{tmp_path}/main"), streaming.appended(f"{tmp_path}/side")))
    assert {r["event_id"] for r in back(spark, f"{tmp_path}/main").collect()} == {1, 3}
    assert {r["event_id"] for r in back(spark, f"{tmp_path}/side").collect()} == {2}


def test_lookup_restart_and_rank(spark, sf, tmp_path):
    rows = files(spark, sf, f"{tmp_path}/in", 2)
    stream = sources.file_source(spark, f"{tmp_path}/in", SCHEMA, "parquet", 1)
    dim = lambda s: s.createDataFrame([("view", "seen")], "event_type string, label string")
    failed = []
    good = streaming.lookup(dim, ["event_type"], {"label": "other"}, streaming.appended(f"{tmp_path}/out"))

    def flaky(batch, batch_id):
        if batch_id == 1 and not failed:
            failed.append(1)
            raise RuntimeError("lost")
        good(batch, batch_id)

    streaming.run_available(stream, f"{tmp_path}/cp", flaky, attempts=2)
    out = back(spark, f"{tmp_path}/out")
    assert failed and out.count() == rows.count()
    assert out.where("label = 'seen'").count() == rows.where("event_type = 'view'").count()
    agg = streaming.window_agg(streaming.watermarked(stream, "ts", "1 hour"), ["user_id"], "ts", "1 day", F.count(F.lit(1)).alias("n"))
    streaming.run_available(agg, f"{tmp_path}/cp2", streaming.ranked(["window_start"], [F.desc("n"), F.col("user_id")], 3, streaming.appended(f"{tmp_path}/top")), mode="update")
    assert back(spark, f"{tmp_path}/top").where("rank > 3").count() == 0
    assert keyed.history(out, "batch_id").count() == 2


def test_dimension_is_read_again_when_old(spark):
    now, label = [0.0], ["one"]
    dim = streaming.TimedDimension(lambda s: s.createDataFrame([("view", label[0])], "event_type string, label string"), 60, clock=lambda: now[0])
    seen = []
    sink = streaming.lookup(dim, ["event_type"], {"label": "other"}, lambda b, i: seen.append(b.first()["label"]))
    batch = spark.createDataFrame([("view", 1)], "event_type string, n int")
    for at, text in ((0, "one"), (59, "two"), (60, "two"), (100, "three")):
        now[0], label[0] = at, text
        sink(batch, at)
    assert seen == ["one", "one", "two", "two"] and dim.reads == 2
    large = streaming.TimedDimension(lambda s: s.range(10), 60, rows=9, clock=lambda: 0.0)
    assert large(spark).count() == large(spark).count() == 10 and large.reads == 2 and large.held is None


def test_newest_rule(spark, tmp_path):
    rules = [[(1, "view")], [(1, "view"), (3, "error"), (2, "click")]]
    seen = []
    sink = streaming.ruled(lambda s: s.createDataFrame(rules[len(seen)], "version int, rule string"), "version", "event_type", "rule", lambda b, i: seen.append({r["n"] for r in b.collect()}))
    batch = spark.createDataFrame([("view", 1), ("error", 2), ("click", 3), (None, 4)], "event_type string, n int")
    sink(batch, 0)
    sink(batch, 1)
    assert seen == [{1}, {2}]


def test_several_writers_into_one_table(spark, sf, tmp_path):
    """Two streams at the same time, each with columns of its own; readers merge them by key."""
    rows = files(spark, sf, f"{tmp_path}/in", 2)
    picks = {"a": ["user_id", "event_id", "event_type"], "b": ["user_id", "event_id", "value"]}
    queries = []
    for name, columns in picks.items():
        stream = sources.file_source(spark, f"{tmp_path}/in", SCHEMA, "parquet", 1).select(*columns)
        queries.append(streaming.started(stream, f"{tmp_path}/cp{name}", streaming.upserts(f"{tmp_path}/t", ["user_id"], ["event_id"], name), "100 milliseconds"))
    try:
        for q in queries:
            q.processAllAvailable()
    finally:
        for q in queries:
            q.stop()
    table = spark.read.option("mergeSchema", "true").parquet(f"{tmp_path}/t")
    assert {r[0] for r in table.select("writer").distinct().collect()} == {"a", "b"}
    merged = keyed.partial_update(table, ["user_id"], ["event_type", "value"], "event_id")
    want = keyed.upsert_latest(rows.select("user_id", "event_id", "event_type", "value"), ["user_id"], ["event_id"])
    assert same(merged, want, ["user_id", "event_type", "value"])


def test_jdbc_sink_and_source(spark, sf, tmp_path):
    """Through a database in the session's own process: batches, ranges, and a write that fails twice."""
    url = f"jdbc:derby:memory:t{uuid.uuid4().hex};create=true"
    rows = files(spark, sf, f"{tmp_path}/in", 2)
    stream = sources.file_source(spark, f"{tmp_path}/in", SCHEMA, "parquet", 1).select("event_id", "user_id")
    streaming.run_available(stream, f"{tmp_path}/cp", streaming.to_jdbc(url, "events", 50))
    n = rows.count()
    whole = sources.read_jdbc(spark, url, "events")
    assert whole.count() == n and sources.read_jdbc(spark, url, "events", '"event_id"', 0, n, 4).count() == n
    ranges = sources.read_jdbc_ranges(spark, url, "events", '"event_id"', 0, n, 4)
    assert ranges.count() == n and ranges.rdd.getNumPartitions() == 4
    with pytest.raises(Exception):
        sources.write_jdbc(whole.select(F.lit("x").alias("other")), url, "events", retries=1, wait=0.01)
    failed = []

    class Flaky:
        def __init__(self, df):
            self.df = df

        @property
        def write(self):
            failed.append(1)
            if len(failed) < 3:
                raise RuntimeError("lost")
            return self.df.write

    sources.write_jdbc(Flaky(spark.range(5)), url, "numbers", retries=2, wait=0.01)
    assert len(failed) == 3 and sources.read_jdbc(spark, url, "numbers").count() == 5


def test_console_and_intervals(spark, sf, tmp_path):
    files(spark, sf, f"{tmp_path}/in", 2)
    seen = []
    query = streaming.started(sources.file_source(spark, f"{tmp_path}/in", SCHEMA, "parquet", 1), f"{tmp_path}/cp", lambda b, i: seen.append(b.count()), "50 milliseconds")
    query.processAllAvailable()
    query.stop()
    assert len([n for n in seen if n]) == 2
    query = streaming.to_console(sources.file_source(spark, f"{tmp_path}/in", SCHEMA, "parquet", 1), f"{tmp_path}/cp2", 1)
    query.processAllAvailable()
    assert query.lastProgress is not None
    query.stop()
