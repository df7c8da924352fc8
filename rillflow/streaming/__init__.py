"""Structured Streaming forms of the operators.

A watermark moves between micro-batches, so a row is late only against what earlier batches held; ``operators.lateness`` has the
form by arrival order. Every sink function is for ``foreachBatch`` and may see a batch again after a failure.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators import keyed
from ..operators.joins import lookup_join
from ..sources import remove
from ..sources.once import write_jdbc_once


def watermarked(df: DataFrame, ts: str, delay: str = "0 seconds") -> DataFrame:
    """A stream with event time: ``ts`` becomes a timestamp with zone, as watermarks need."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def window_agg(df: DataFrame, keys: list[str], ts: str, size: str, *aggs: Column, slide: str | None = None) -> DataFrame:
    """Aggregates per key and tumbling or hopping window, of a stream (one state row per key and window) or a table."""
    out = df.groupBy(*keys, F.window(ts, size, slide or size).alias("w")).agg(*aggs)
    return out.select(*keys, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[c for c in out.columns if c not in (*keys, "w")])


def session_agg(df: DataFrame, keys: list[str], ts: str, gap: str, *aggs: Column) -> DataFrame:
    """Aggregates per key and session."""
    out = df.groupBy(*keys, F.session_window(ts, gap).alias("w")).agg(*aggs)
    return out.select(*keys, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[c for c in out.columns if c not in (*keys, "w")])


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], lt: str, rt: str, back: str, ahead: str) -> DataFrame:
    """Join of two watermarked streams on keys and lt - back <= rt <= lt + ahead; Spark drops state that can't match any more."""
    r = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    on = F.expr(f"{rt} >= {lt} - interval {back} and {rt} <= {lt} + interval {ahead}")
    for k in keys:
        on = on & (F.col(k) == F.col(f"__{k}"))
    return left.join(r, on).drop(*[f"__{k}" for k in keys])


def first_per_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """First row of each key of a watermarked stream; a key is forgotten when the watermark passes its row."""
    return df.dropDuplicatesWithinWatermark(keys)


class PvTimer(StatefulProcessor):
    """Rows of a key: the first row arms a timer that fires ``seconds`` of event time later and tells the count so far; the next row arms it again. The count goes on, but starts anew once ``ttl`` seconds lie between two rows."""

    def __init__(self, key: str, ts: str, seconds: float, ttl: float):
        self.key, self.ts, self.millis, self.ttl = key, ts, int(seconds * 1000), int(ttl * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.count = handle.getValueState("pv", "pv long, last long")
        self.timer = handle.getValueState("timer", "armed long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  names that Spark passes
        times = sorted(t.value // 1_000_000 for pdf in rows for t in pdf[self.ts])
        armed = self.timer.get()[0] if self.timer.exists() else None
        pv, last = self.count.get() if self.count.exists() else (0, None)
        out = []
        for t in times:
            if armed is not None and t >= armed + self.millis:
                self.handle.deleteTimer(armed + self.millis)
                out.append((key[0], armed, pv))
                armed = None
            if armed is None:
                armed = t
                self.handle.registerTimer(armed + self.millis)
            pv, last = (1 if last is not None and t - last >= self.ttl else pv + 1), t
        self.timer.update((armed,))
        self.count.update((pv, last))
        yield pd.DataFrame(out, columns=[self.key, "armed", "pv"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        armed, pv = self.timer.get()[0], self.count.get()[0]
        self.timer.clear()
        yield pd.DataFrame([(key[0], armed, pv)], columns=[self.key, "armed", "pv"])

    def close(self) -> None:
        pass


def pv_timer(df: DataFrame, key: str, ts: str, seconds: float, ttl: float) -> DataFrame:
    """``PvTimer`` over a watermarked stream: key, armed (ms), pv."""
    schema = f"`{key}` {dict(df.dtypes)[key]}, armed long, pv long"
    return df.groupBy(key).transformWithStateInPandas(PvTimer(key, ts, seconds, ttl), outputStructType=schema, outputMode="Append", timeMode="EventTime")


class ExpiringCount(StatefulProcessor):
    """Rows of a key so far, told after each batch. The count is forgotten once ``ttl`` seconds of processing time lie behind its last row, and its row leaves the state store with a later batch."""

    def __init__(self, key: str, ttl: float):
        self.key, self.millis = key, int(ttl * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "n long", ttlDurationMs=self.millis)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n = (self.count.get()[0] if self.count.exists() else 0) + sum(len(pdf) for pdf in rows)
        self.count.update((n,))
        yield pd.DataFrame([(key[0], n)], columns=[self.key, "n"])

    def close(self) -> None:
        pass


def expiring_count(df: DataFrame, key: str, ttl: float) -> DataFrame:
    """``ExpiringCount`` over a stream: key, n. State of idle keys is freed by the state store's own expiry."""
    return df.groupBy(key).transformWithStateInPandas(ExpiringCount(key, ttl), outputStructType=f"`{key}` {dict(df.dtypes)[key]}, n long", outputMode="Update", timeMode="ProcessingTime")


def state_rows(spark: SparkSession, checkpoint: str, name: str) -> DataFrame:
    """What a processor's state variable ``name`` holds after the last batch, read from the stream's checkpoint."""
    return spark.read.format("statestore").option("stateVarName", name).load(checkpoint)


class Tally(StatefulProcessor):
    """A map from field values to counts for each key, told as a whole ``seconds`` of processing time after the first row that comes while no timer is armed. The map is not cleared."""

    def __init__(self, key: str, field: str, seconds: float):
        self.key, self.field, self.millis = key, field, int(seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getMapState("counts", "field string", "n long")
        self.timer = handle.getValueState("timer", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for pdf in rows:
            for value, n in pdf[self.field].value_counts().items():
                before = self.counts.getValue((value,))[0] if self.counts.containsKey((value,)) else 0
                self.counts.updateValue((value,), (before + int(n),))
        if not self.timer.exists():
            at = timerValues.getCurrentProcessingTimeInMs() + self.millis
            self.handle.registerTimer(at)
            self.timer.update((at,))
        yield pd.DataFrame([], columns=[self.key, self.field, "n"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.timer.clear()
        yield pd.DataFrame([(key[0], k[0], v[0]) for k, v in self.counts.iterator()], columns=[self.key, self.field, "n"])

    def close(self) -> None:
        pass


def tally(df: DataFrame, key: str, field: str, seconds: float) -> DataFrame:
    """``Tally`` over a stream: key, field, n."""
    kinds = dict(df.dtypes)
    return df.groupBy(key).transformWithStateInPandas(Tally(key, field, seconds), outputStructType=f"`{key}` {kinds[key]}, `{field}` string, n long", outputMode="Append", timeMode="ProcessingTime")


class Folded(StatefulProcessor):
    """An accumulator for each key, which ``add`` makes from the last one and a batch's values of the key (a pandas series), and ``result`` turns into the number told after each batch: reducing and aggregating state."""

    def __init__(self, key: str, value: str, zero: tuple, add: Callable, result: Callable):
        self.key, self.value, self.zero, self.add, self.result = key, value, zero, add, result

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("accumulator", ", ".join(f"a{i} double" for i in range(len(self.zero))))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = tuple(self.state.get()) if self.state.exists() else self.zero
        for pdf in rows:
            held = tuple(float(x) for x in self.add(held, pdf[self.value]))
        self.state.update(held)
        yield pd.DataFrame([(key[0], float(self.result(held)))], columns=[self.key, "result"])

    def close(self) -> None:
        pass


def folded(df: DataFrame, key: str, value: str, zero: tuple, add: Callable, result: Callable) -> DataFrame:
    """``Folded`` over a stream: key, result."""
    return df.groupBy(key).transformWithStateInPandas(Folded(key, value, zero, add, result), outputStructType=f"`{key}` {dict(df.dtypes)[key]}, result double", outputMode="Update", timeMode="None")


class CountWindow(StatefulProcessor):
    """Sums over each ``n`` rows of a key in order of arrival."""

    def __init__(self, key: str, value: str, n: int):
        self.key, self.value, self.n = key, value, n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", "value double")
        self.count = handle.getValueState("count", "windows long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = [x[0] for x in self.held.get()] if self.held.exists() else []
        no = self.count.get()[0] if self.count.exists() else 0
        held += [float(v) for pdf in rows for v in pdf[self.value]]
        out = []
        while len(held) >= self.n:
            out.append((key[0], no, sum(held[: self.n])))
            held, no = held[self.n :], no + 1
        self.held.put([(x,) for x in held]) if held else self.held.clear()
        self.count.update((no,))
        yield pd.DataFrame(out, columns=[self.key, "window_no", "total"])

    def close(self) -> None:
        pass


def count_window(df: DataFrame, key: str, value: str, n: int) -> DataFrame:
    """``CountWindow`` over a stream: key, window_no, total; a key's state holds fewer than ``n`` values."""
    schema = f"`{key}` {dict(df.dtypes)[key]}, window_no long, total double"
    return df.groupBy(key).transformWithStateInPandas(CountWindow(key, value, n), outputStructType=schema, outputMode="Append", timeMode="None")


def fan_out(*sinks: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """One batch to several sinks; it is computed once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for sink in sinks:
                sink(batch, batch_id)
        finally:
            batch.unpersist()

    return write


def upserts(path: str, keys: list[str], version: list[str], writer: str | None = None) -> Callable[[DataFrame, int], None]:
    """Changes of a keyed table: each batch, with one row a key, is added under ``path``; ``keyed.upsert_latest`` of what is there is the table. The same batch twice changes nothing."""
    write = appended(path, writer)
    return lambda batch, batch_id: write(keyed.upsert_latest(batch, keys, version), batch_id)


def ranked(keys: list[str], order: list[Column], n: int, write: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """Top ``n`` per key of the windows that a batch updates (streams have no row_number)."""
    return lambda batch, batch_id: write(batch.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n), batch_id)


def appended(path: str, writer: str | None = None) -> Callable[[DataFrame, int], None]:
    """Each batch in its own folder ``batch_id=k``, replaced if it comes again. Several streams write into one table if each names itself as ``writer``, a folder above."""
    base = f"{path}/writer={writer}" if writer else path
    return lambda batch, batch_id: batch.write.mode("overwrite").parquet(f"{base}/batch_id={batch_id}")


def to_jdbc(url: str, table: str, batch: int = 500, retries: int = 3, wait: float = 1.0, writer: str = "stream", **options: str) -> Callable[[DataFrame, int], None]:
    """Batches to a JDBC table, each row once (``sources.once``): a batch that comes again is known by its number. Streams into one table name themselves as ``writer``; ``started`` with an interval flushes at that interval."""

    def write(rows: DataFrame, batch_id: int) -> None:
        write_jdbc_once(rows, url, table, writer, batch_id, batch, retries, wait, **options)

    return write


def buffered(path: str, threshold: int, write: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """Rows are held in a table at ``path`` and written once ``threshold`` are there; the buffer survives a restart. Batches that were written are removed with the next batch."""

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.withColumn("__batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/held/batch_id={batch_id}")
        done = _mark(spark, f"{path}/done")
        for old in range(done, -1, -1):
            if not remove(spark, f"{path}/held/batch_id={old}"):
                break
        rows = spark.read.parquet(f"{path}/held").where(F.col("__batch") > done)
        if rows.count() >= threshold:
            write(rows.drop("__batch", "batch_id"), batch_id)
            _set_mark(spark, f"{path}/done", batch_id, batch_id)

    return run


def late_split(path: str, ts: str, size: str, disorder: str, lateness: str, main: Callable[[DataFrame, int], None], side: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """Rows whose window closed more than ``lateness`` before the watermark of earlier batches go to ``side``, others to ``main``. The greatest time is kept under ``path``, per batch, so that a repeated batch is judged alike."""

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        micros = F.unix_micros(F.col(ts).cast("timestamp"))
        top = _mark(spark, f"{path}/top", batch_id)
        limit = F.expr(f"window_end + interval {disorder} + interval {lateness}")
        rows = batch.withColumn("window_end", F.window(ts, size)["end"]).withColumn("__late", F.lit(top) >= F.unix_micros(limit.cast("timestamp")))
        main(rows.where("not __late").drop("__late"), batch_id)
        side(rows.where("__late").drop("__late"), batch_id)
        high = batch.agg(F.max(micros)).first()[0]
        _set_mark(spark, f"{path}/top", batch_id, max(top, -1 if high is None else high))

    return run


class TimedDimension:
    """A dimension for look-ups that is read again when what was read is ``ttl`` seconds old. It is kept in memory up to ``rows`` rows; a larger one is read for each batch, and Spark picks the join."""

    def __init__(self, read: Callable[[SparkSession], DataFrame], ttl: float = 60, rows: int = 100_000, clock: Callable[[], float] = time.monotonic):
        self.read, self.ttl, self.rows, self.clock = read, ttl, rows, clock
        self.held, self.since, self.reads = None, 0.0, 0

    def __call__(self, spark: SparkSession) -> DataFrame:
        if self.held is None or self.clock() - self.since >= self.ttl:
            if self.held is not None:
                self.held.unpersist()
            found = self.read(spark)
            self.reads += 1
            small = found.limit(self.rows + 1).count() <= self.rows
            self.held, self.since = (found.persist() if small else None), self.clock()
            return found
        return self.held


def lookup(dimension: Callable[[SparkSession], DataFrame], keys: list[str], defaults: dict[str, object], write: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """Each batch joined to a dimension, with ``defaults`` where a row is missing. ``dimension`` is read anew for each batch, or by a ``TimedDimension``."""
    return lambda batch, batch_id: write(lookup_join(batch, dimension(batch.sparkSession), keys, defaults), batch_id)


def ruled(rules: Callable[[SparkSession], DataFrame], version: str, field: str, rule: str, write: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """Rows of a batch whose ``field`` is the newest rule: the one row of ``rules`` with the greatest ``version`` is what a broadcast state would hold."""

    def run(batch: DataFrame, batch_id: int) -> None:
        newest = rules(batch.sparkSession).agg(F.max_by(rule, version)).first()[0]
        write(batch.where(F.col(field) == F.lit(newest)), batch_id)

    return run


def _mark(spark: SparkSession, path: str, before: int | None = None) -> int:
    """The last value kept under ``path`` (by a batch before ``before``), -1 if there is none."""
    try:
        kept = spark.read.schema("value long, of_batch long").parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return -1
    kept = kept if before is None else kept.where(F.col("of_batch") < before)
    row = kept.orderBy(F.desc("of_batch")).first()
    return -1 if row is None else row["value"]


def _set_mark(spark: SparkSession, path: str, batch_id: int, value: int) -> None:
    spark.range(1).select(F.lit(value).cast("long").alias("value"), F.lit(batch_id).cast("long").alias("of_batch")).coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    for old in range(batch_id - 2, -1, -1):  # a batch comes again at most once the one before is done
        if not remove(spark, f"{path}/batch={old}"):
            break


def run_available(df: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], mode: str = "append", timeout: int = 300, attempts: int = 1) -> None:
    """Run a stream over all that is there now, and stop it after ``timeout`` seconds at the latest; after a failure it resumes from its checkpoint, ``attempts`` times in all."""
    for attempt in range(attempts):
        try:
            return _run_once(df, checkpoint, sink, mode, timeout)
        except StreamingQueryException:
            if attempt + 1 == attempts:
                raise


def _run_once(df: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], mode: str, timeout: int) -> None:
    query: StreamingQuery = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
    try:
        if not query.awaitTermination(timeout):
            raise TimeoutError(f"the stream did not end in {timeout} s")
    finally:
        query.stop()


def started(df: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], interval: str = "5 seconds", mode: str = "append") -> StreamingQuery:
    """A stream that runs on in mini-batches, one each ``interval``; how many rows one takes is a limit of its source."""
    return df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(processingTime=interval).foreachBatch(sink).start()


def to_console(df: DataFrame, checkpoint: str, rows: int = 20, mode: str = "append") -> StreamingQuery:
    """A stream's batches on the driver's standard output, ``rows`` of each (for demonstrations)."""
    return df.writeStream.outputMode(mode).format("console").option("numRows", rows).option("truncate", "false").option("checkpointLocation", checkpoint).start()
