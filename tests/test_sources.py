"""Own sources, once-only writes to a database, files of a target size, declared tables."""

import random
import sqlite3
import time
import uuid

import pytest
from pyspark.sql import functions as F

from rillflow import sources, streaming
from rillflow.operators import joins, lateness
from rillflow.sources import once, polled, sized
from rillflow.sources.declared import Declared
from rillflow.streaming import marked

SCHEMA = "id bigint, x string"


@pytest.fixture
def database(tmp_path):
    path = f"{tmp_path}/base.db"
    with sqlite3.connect(path) as c:
        c.execute("create table numbers (id integer, x text)")
        c.executemany("insert into numbers values (?, ?)", [(i * 3, f"x{i}") for i in range(1_000)])
    return path


def test_table_in_ranges(spark, database):
    read = polled.read_table(spark, "sqlite3:connect", [database], "numbers", "id", SCHEMA, 7)
    assert read.rdd.getNumPartitions() == 7
    assert sorted(map(tuple, read.collect())) == sorted((i * 3, f"x{i}") for i in range(1_000))
    with sqlite3.connect(database) as c:
        c.execute("insert into numbers values (null, 'none')")
    assert read.count() == 1_001
    with sqlite3.connect(database) as c:
        c.execute("delete from numbers")
    assert read.count() == 0


def test_polled_table_restarts_from_its_offsets(spark, database, tmp_path):
    """A sink that fails in the middle, a restart, and rows that come later: none is lost, none comes twice, no batch is over the limit."""
    stream = lambda: polled.poll_table(spark, "sqlite3:connect", [database], "numbers", "id", SCHEMA, 90, 4)
    batches = {}

    def sink(batch, batch_id):
        batches[batch_id] = [r["id"] for r in batch.collect()]
        if batch_id == 3 and not failed:
            failed.append(1)
            raise RuntimeError("lost")

    def drain():
        query = streaming.started(stream(), f"{tmp_path}/cp", sink, "0 seconds")
        until = time.time() + 90
        while query.isActive and time.time() < until and (len(batches) < 12 if not more else sum(map(len, batches.values())) < 1_050):
            time.sleep(0.2)
        query.stop()
        return query.exception()

    failed, more = [], []
    assert drain() is not None and max(batches) == 3
    drain()
    with sqlite3.connect(database) as c:
        c.executemany("insert into numbers values (?, ?)", [(3_000 + i, "new") for i in range(50)])
    more.append(1)
    drain()
    assert all(len(ids) <= 90 for ids in batches.values())
    assert sorted(i for ids in batches.values() for i in ids) == sorted([*(i * 3 for i in range(1_000)), *range(3_000, 3_050)])


def test_numbered_stream(spark, tmp_path):
    ids = polled.numbered_stream(spark, 1_000, 300, 4, lambda d: d.withColumn("square", F.col("id") * F.col("id")))
    seen = {}
    query = streaming.started(ids, f"{tmp_path}/cp", lambda b, i: seen.update({i: [r["id"] for r in b.collect()]}), "0 seconds")
    until = time.time() + 60
    while sum(map(len, seen.values())) < 1_000 and time.time() < until:
        time.sleep(0.2)
    query.stop()
    assert sorted(len(v) for v in seen.values() if v) == [100, 300, 300, 300]
    assert sorted(i for v in seen.values() for i in v) == list(range(1_000))


def derby():
    return f"jdbc:derby:memory:t{uuid.uuid4().hex};create=true"


@pytest.mark.parametrize("moment", ["rows", "before", "inside", "after"])
def test_a_killed_write_leaves_each_row_once(spark, moment, monkeypatch):
    """Killed while tasks write, before the transaction, inside it, and after it but before anyone knows."""
    url, rows = derby(), spark.range(500).repartition(4)
    assert once.write_jdbc_once(rows, url, "numbers", "w", 0)
    commit, killed = once._commit, []
    if moment == "rows":
        once_only = F.udf(lambda i: 1 // (i - 777), "long")
        broken = spark.range(500, 1_000).repartition(4).select("id", once_only("id").alias("y")).select("id").where("y is null or y >= -1")
        with pytest.raises(Exception):
            once.write_jdbc_once(broken, url, "numbers", "w", 1)
    else:
        execute = once.execute

        def dying(c, sql, *values):
            done = execute(c, sql, *values)
            if moment == "inside" and not killed and sql.startswith("insert into numbers"):
                killed.append(1)
                raise RuntimeError("killed")
            return done

        def kill(*args):
            if moment == "before" and not killed:
                killed.append(1)
                raise RuntimeError("killed")
            out = commit(*args)
            if moment == "after" and not killed:
                killed.append(1)
                raise RuntimeError("killed")
            return out

        monkeypatch.setattr(once, "execute", dying)
        monkeypatch.setattr(once, "_commit", kill)
    again = once.write_jdbc_once(spark.range(500, 1_000).repartition(4), url, "numbers", "w", 1, retries=1, wait=0.01)
    assert again is (moment != "after") and (moment == "rows" or killed)
    got = [r["id"] for r in sources.read_jdbc(spark, url, "numbers").collect()]
    assert sorted(got) == list(range(1_000))
    assert not once.write_jdbc_once(spark.range(5), url, "numbers", "w", 1) and once.write_jdbc_once(spark.range(5), url, "numbers", "other", 1)
    assert sources.read_jdbc(spark, url, "numbers").count() == 1_005
    once.drop_jdbc(spark, url, "numbers")
    with pytest.raises(Exception):
        sources.read_jdbc(spark, url, "numbers").count()


def sizes(spark, path):
    return [(r["length"], r["path"]) for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path).select("length", "path").collect()]


def test_files_of_a_target_size(spark, tmp_path):
    """Partitions of which one holds most rows and one has rows ten times as long."""
    text = F.concat_ws(" ", *[F.xxhash64("id", F.lit(i)).cast("string") for i in range(4)])
    long = F.concat_ws(" ", *[F.xxhash64("id", F.lit(i)).cast("string") for i in range(40)])
    rows = spark.range(120_000).withColumn("p", F.when(F.col("id") % 20 == 0, "b").when(F.col("id") % 100 == 1, "c").otherwise("a"))
    rows = rows.withColumn("x", F.when(F.col("p") == "b", long).otherwise(text))
    target = 400_000
    sized.write_sized(rows, f"{tmp_path}/t", target, ["p"])
    found = sizes(spark, f"{tmp_path}/t")
    large = [n for n, path in found if "p=c" not in path]
    assert len(large) > 15 and sum(0.75 * target <= n <= 1.25 * target for n in large) >= 0.9 * len(large), sorted(large)
    assert sum("p=c" in path for _, path in found) == 1
    back = spark.read.parquet(f"{tmp_path}/t")
    assert back.count() == 120_000 and back.agg(F.sum("id")).first()[0] == rows.agg(F.sum("id")).first()[0]
    sized.write_sized(rows.drop("p"), f"{tmp_path}/json", 2_000_000, kind="json")
    assert all(1_500_000 <= n <= 2_500_000 for n, _ in sizes(spark, f"{tmp_path}/json"))
    sized.write_sized(rows.limit(0), f"{tmp_path}/none", target, ["p"])


def test_rolls_by_bytes_and_by_time(spark, tmp_path):
    now = [0.0]
    batch = lambda a, b: spark.range(a, b).withColumn("x", F.xxhash64("id").cast("string"))
    sink = sized.rolled(f"{tmp_path}/out", f"{tmp_path}/stage", 600_000, 100, clock=lambda: now[0])
    now[0] = time.time()
    sink(batch(0, 1_000), 0)
    assert not sizes(spark, f"{tmp_path}/out") if (tmp_path / "out").exists() else True
    sink(batch(1_000, 40_000), 1)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 40_000
    sink(batch(1_000, 40_000), 1)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 40_000
    sink(batch(40_000, 40_010), 2)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 40_000
    now[0] = time.time() + 101
    sink(batch(40_010, 40_020), 3)
    out = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(r["id"] for r in out.select("id").collect()) == list(range(40_020))
    assert {r["roll"] for r in out.select("roll").distinct().collect()} == {1, 3}


def test_declared_once_read_both_ways(spark, sf, tmp_path):
    """The interval join of a declaration, as a table and as a stream."""
    rows = spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"), "user_id", "event_type")
    for i in range(4):
        rows.where(F.floor(F.col("event_id") / (rows.count() // 4 + 1)) == i).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    said = Declared("event_id bigint, at string, user_id bigint, event_type string", {"ts": "to_timestamp(at)", "hour": "date_trunc('hour', ts)"}, ("ts", "1 hour"), "json")
    side = lambda df, kind, i, t: df.where(F.col("event_type") == kind).select(F.col("event_id").alias(i), "user_id", F.col("ts").alias(t))
    table, stream = said.table(spark, f"{tmp_path}/in"), lambda: said.stream(spark, f"{tmp_path}/in", 1)
    assert table.dtypes == stream().dtypes and dict(table.dtypes)["hour"] == "timestamp"
    want = joins.interval_join(side(table, "purchase", "buy", "bt"), side(table, "view", "view", "vt"), ["user_id"], "bt", "vt", 6 * 3600, 6 * 3600)
    found = streaming.interval_join(side(stream(), "purchase", "buy", "bt"), side(stream(), "view", "view", "vt"), ["user_id"], "bt", "vt", "6 hours", "6 hours")
    streaming.run_available(found, f"{tmp_path}/cp", streaming.appended(f"{tmp_path}/out"))
    pairs = lambda df: sorted(map(tuple, df.select("buy", "view").collect()))
    assert pairs(spark.read.parquet(f"{tmp_path}/out")) == pairs(want) != []
    assert said.late(table, "timestamp'2100-01-01'").where("late").count() == table.count()


@pytest.mark.parametrize("kind", ["punctuated", "trailing"])
def test_watermarks_that_move_with_rows(spark, tmp_path, kind):
    """Batches whose rows lie in any order give what the arrival order gives, each row at the same row of its key."""
    rng = random.Random(4)
    rows = [(i, rng.choice("abc"), i * 10 + rng.randrange(-150, 20), rng.random() < 0.1) for i in range(400)] + [(400, "a", None, True)]
    made = lambda part: spark.createDataFrame(part, "arrival long, k string, t long, stop boolean").withColumn("ts", F.timestamp_seconds("t"))
    for i in range(0, 401, 50):
        part = rows[i : i + 50]
        rng.shuffle(part)
        made(part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(0.05)
    table = made(rows)
    mark = marked.marked_by(F.col("stop"), "ts") if kind == "punctuated" else marked.trailing("ts", "40 seconds")
    want = lateness.released(table, ["k"], "ts", "arrival", mark)
    stream = sources.file_source(spark, f"{tmp_path}/in", "arrival long, k string, t long, stop boolean, ts timestamp", "parquet", 1)
    order = []

    def sink(batch, batch_id):
        order.extend(batch.collect())

    streaming.run_available(marked.released(stream, "k", "ts", "arrival", mark), f"{tmp_path}/cp", sink)
    got = {r["arrival"]: (r["late"], r["released_by"]) for r in order}
    assert len(got) == len(order)
    all_rows = {r["arrival"]: (r["late"], r["released_by"]) for r in want.collect()}
    assert {a: v for a, v in all_rows.items() if v[0] or v[1] is not None} == got and len(all_rows) == 400
    assert any(v[0] for v in got.values()) and any(v[1] is None and not v[0] for v in all_rows.values())
    for k in "abc":  # a key's rows come in order of their times, as far as one row lets them go
        own = [(r["released_by"], r["t"]) for r in order if r["k"] == k and not r["late"]]
        assert own == sorted(own)
    # the definition, row by row
    top = {}
    for a, k, t, stop in rows:
        if t is None:
            continue
        assert all_rows[a][0] == (t * 1000 <= top.get(k, -(10**15)))
        moved = t * 1000 - 1 if kind == "punctuated" and stop else t * 1000 - 40_001 if kind == "trailing" else None
        if moved is not None:
            top[k] = max(top.get(k, -(10**15)), moved)


def test_state_of_idle_keys_is_freed(spark, tmp_path):
    """What the state store reader shows: the key that comes back in time counts on, the others are gone."""
    made = lambda keys: spark.createDataFrame([(k,) for k in keys], "k string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    made("aab")
    told = []
    stream = streaming.expiring_count(sources.file_source(spark, f"{tmp_path}/in", "k string", "parquet", 1), "k", 15)
    query = streaming.started(stream, f"{tmp_path}/cp", lambda b, i: told.extend((r["k"], r["n"]) for r in b.collect()), "500 milliseconds", "update")

    def until(done, seconds=60):
        end = time.time() + seconds
        while not done() and time.time() < end and query.isActive:
            time.sleep(0.2)
        assert done(), told

    held = lambda: {r["key"][0] for r in streaming.state_rows(spark, f"{tmp_path}/cp", "count").select("key").collect()}
    until(lambda: ("a", 2) in told and ("b", 1) in told)
    until(lambda: (query.lastProgress or {"batchId": 0})["batchId"] > 0)
    assert held() == {"a", "b"}
    made("a")
    until(lambda: ("a", 3) in told)
    until(lambda: held() == set())
    made("ad")
    until(lambda: ("d", 1) in told and ("a", 1) in told)
    until(lambda: held() == {"a", "d"})
    query.stop()
