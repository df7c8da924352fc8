"""Files of a target size, and a sink that rolls by bytes and by time."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.aggregates import null_safe
from ..session import shared_folder
from . import remove


def _dealt(staged: DataFrame, partitions: list[str], target: int, kind: str) -> tuple[DataFrame, int]:
    """Rows of a staged table with __task, the file that each goes to, and the number of files.

    Bytes and rows of each partition are measured on the staged files; a partition gets as many files as its bytes hold the target, and its rows
    are dealt to them by a hash of their place in the staged files, so that files of a partition are equally large.
    """
    rows = staged.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_size").alias("__size"))
    by = partitions or ["__all"]
    rows = rows if partitions else rows.withColumn("__all", F.lit(0))
    files = rows.groupBy(*by, "__file").agg(F.max("__size").alias("__size"))
    count = F.greatest(F.round(F.sum("__size") / target), F.lit(1)).cast("int")
    plan = [r.asDict() for r in files.groupBy(*by).agg(count.alias("__n")).collect()]  # a row for each partition
    first, table = 0, []
    for r in plan:
        table.append((*[r[c] for c in by], first, r["__n"]))
        first += r["__n"]
    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "__first int, __n int"])
    dealt = null_safe(rows, staged.sparkSession.createDataFrame(table, schema), by)
    place = F.pmod(F.xxhash64("__file", F.monotonically_increasing_id()), F.col("__n"))
    return dealt.withColumn("__task", (F.col("__first") + place).cast("int")).drop("__file", "__size", "__first", "__n", "__all"), first


def write_sized(df: DataFrame, path: str, target: int, partitions: list[str] = (), kind: str = "parquet", mode: str = "append", **options: str) -> None:
    """Write ``df`` in files of about ``target`` bytes, whatever a row takes and however partitions differ in size.

    Rows are staged once in the shared folder, as they lie, to measure what they take in this format in each partition; then
    they are dealt to files, one task a file. A partition smaller than the target is one file. What a staged file takes is close to what the same rows take later, as long as it holds some thousand rows.
    """
    partitions = list(partitions)
    stage = shared_folder(df.sparkSession)
    staged = df.hint("rebalance", *partitions) if partitions else df
    write = staged.write.format(kind).options(**options)
    (write.partitionBy(*partitions) if partitions else write).save(stage)
    reader = df.sparkSession.read.schema(df.schema) if df.columns else df.sparkSession.read
    rows, n = _dealt(reader.format(kind).options(**options).load(stage), partitions, target, kind)
    if n:
        out = rows.repartitionById(n, F.col("__task")).drop("__task").write.format(kind).mode(mode).options(**options)
        (out.partitionBy(*partitions) if partitions else out).save(path)
    remove(df.sparkSession, stage)


def staged_bytes(spark: SparkSession, folder: str) -> int:
    """Bytes of the files in a folder, of any file system that Spark knows; 0 if it isn't there."""
    target = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.getContentSummary(target).getLength() if fs.exists(target) else 0


def rolled(path: str, stage: str, target: int, age: float, partitions: list[str] = (), kind: str = "parquet", clock: Callable[[], float] = time.time) -> Callable[[DataFrame, int], None]:
    """A sink for ``foreachBatch`` that gathers batches under ``stage`` and writes them to ``path/roll=k`` in files of about ``target`` bytes, once that many bytes are there or ``age`` seconds have passed since the first of them came.

    ``k`` is the number of the batch that makes it roll; a batch that comes again replaces what it wrote, and staged batches are removed with the
    next one that comes. The last files are written by the batch that comes ``age`` seconds later (streams call their sink for batches with data, or each interval with ``started``).
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{stage}/held/batch_id={batch_id}")
        held = [r for r in _held(spark, stage)]
        done = max((int(k) for k, _ in _folders(spark, path, "roll=") if int(k) < batch_id), default=-1)
        for k, _ in held:
            if k <= done:
                remove(spark, f"{stage}/held/batch_id={k}")
        waiting = [(k, since) for k, since in held if k > done]
        size = sum(staged_bytes(spark, f"{stage}/held/batch_id={k}") for k, _ in waiting)
        if size >= target or clock() - min(since for _, since in waiting) >= age:
            rows = spark.read.schema(batch.schema).parquet(*[f"{stage}/held/batch_id={k}" for k, _ in waiting])
            write_sized(rows, f"{path}/roll={batch_id}", target, partitions, kind, "overwrite")

    return run


def _folders(spark: SparkSession, path: str, prefix: str) -> list[tuple[str, float]]:
    """(name after the prefix, seconds when it was made) of the folders in ``path``."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(target):
        return []
    return [(s.getPath().getName()[len(prefix) :], s.getModificationTime() / 1000) for s in fs.listStatus(target) if s.getPath().getName().startswith(prefix)]


def _held(spark: SparkSession, stage: str) -> list[tuple[int, float]]:
    return sorted((int(k), since) for k, since in _folders(spark, f"{stage}/held", "batch_id="))
