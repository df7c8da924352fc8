"""Readers and writers."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, schema: str, comment: str = "#") -> DataFrame:
    """CSV with a declared schema; malformed and comment lines are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").option("comment", comment).option("columnPruning", "false").csv(path)


def read_fields(spark: SparkSession, path: str, schema: list[tuple[str, str]], sep: str = ",") -> DataFrame:
    """Text lines split to typed fields; lines with another number of fields are left out."""
    parts = spark.read.text(path).select(F.split("value", sep, -1).alias("p")).where(F.size("p") == len(schema))
    return parts.select(*[F.expr(f"try_cast(p[{i}] as {t})").alias(n) for i, (n, t) in enumerate(schema)])


def parse_json(df: DataFrame, column: str, schema: str, required: str) -> DataFrame:
    """JSON text to columns; rows that don't parse or lack ``required`` are left out."""
    return df.withColumn("__j", F.from_json(column, schema, {"mode": "PERMISSIVE"})).where(F.col(f"__j.{required}").isNotNull()).select(*df.columns, "__j.*")


def key_value(df: DataFrame, keys: list[str], value_has_keys: bool = True) -> DataFrame:
    """Rows as JSON texts (key, value), as an upsert topic takes them."""
    fields = df.columns if value_has_keys else [c for c in df.columns if c not in keys]
    return df.select(F.to_json(F.struct(*keys)).alias("key"), F.to_json(F.struct(*fields)).alias("value"))


def range_predicates(column: str, lower: int, upper: int, n: int) -> list[str]:
    """Predicates that cut a column into ``n`` ranges; the first also takes nulls and all below, the last all above."""
    step = max(1, (upper - lower) // n)
    cuts = [lower + step * i for i in range(1, n)]
    if not cuts:
        return ["true"]
    inner = [f"{column} >= {a} and {column} < {b}" for a, b in zip(cuts, cuts[1:])]
    return [f"{column} < {cuts[0]} or {column} is null", *inner, f"{column} >= {cuts[-1]}"]


def read_jdbc(spark: SparkSession, url: str, table: str, column: str | None = None, lower: int = 0, upper: int = 0, n: int = 1, **options: str) -> DataFrame:
    """A JDBC table, read in ``n`` ranges of a numeric column where one is given."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if column:
        reader = reader.options(partitionColumn=column, lowerBound=str(lower), upperBound=str(upper), numPartitions=str(n))
    return reader.load()


def write_jdbc(df: DataFrame, url: str, table: str, batch: int = 500, mode: str = "append", retries: int = 0, wait: float = 1.0, **options: str) -> None:
    """Write to a JDBC table in batches of ``batch`` rows. A failed write is tried again up to ``retries`` times, after ``wait`` seconds and then twice as long each time; partitions that were committed before a failure are written again."""
    for attempt in range(retries + 1):
        try:
            df.write.format("jdbc").mode(mode).options(url=url, dbtable=table, batchsize=str(batch), **options).save()
            return
        except Exception:
            if attempt == retries:
                raise
            time.sleep(wait * 2**attempt)


def read_jdbc_ranges(spark: SparkSession, url: str, table: str, column: str, lower: int, upper: int, n: int, **options: str) -> DataFrame:
    """A JDBC table in ``n`` partitions, one for each of ``range_predicates``."""
    return spark.read.jdbc(url, table, predicates=range_predicates(column, lower, upper, n), properties=options or None)


def create_table(spark: SparkSession, name: str, schema: str, partitions: list[str] = (), kind: str = "parquet", path: str | None = None) -> None:
    """A catalog table, unless it exists; with ``path`` its files lie there and stay when it is dropped."""
    by = f" partitioned by ({', '.join(partitions)})" if partitions else ""
    at = f" location '{path}'" if path else ""
    spark.sql(f"create table if not exists {name} ({schema}) using {kind}{by}{at}")


def add_partition(spark: SparkSession, name: str, **values: str) -> None:
    """A partition of a catalog table, unless it exists."""
    given = ", ".join(f"{k} = '{v}'" for k, v in values.items())
    spark.sql(f"alter table {name} add if not exists partition ({given})")


def partitions_of(spark: SparkSession, name: str) -> list[str]:
    """The partitions of a catalog table, as column=value paths."""
    return [r[0] for r in spark.sql(f"show partitions {name}").collect()]


def describe(spark: SparkSession, name: str) -> DataFrame:
    """Columns, partitions and properties of a catalog table."""
    return spark.sql(f"describe table extended {name}")


def drop_table(spark: SparkSession, name: str) -> None:
    """Drop a catalog table, if it exists."""
    spark.sql(f"drop table if exists {name}")


def shard_of(n: int, *columns: str) -> Column:
    """Shard of a row by MD5 of its key columns, which other systems can compute as well."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", *columns)), 1, 8), 16, 10).cast("long"), F.lit(n)).cast("int")


def write_sharded(df: DataFrame, path: str, n: int, *columns: str) -> None:
    """Rows to ``path/shard=k``; a shard that is larger than others is split among tasks, each of which writes a file."""
    df.withColumn("shard", shard_of(n, *columns)).hint("rebalance", "shard").write.partitionBy("shard").parquet(path)


def write_dynamic(df: DataFrame, path: str, partitions: list[str], max_records: int = 0) -> None:
    """Write partitions derived from the rows; only those that occur are replaced. Rows are gathered by partition, and adaptive execution splits partitions that are large and joins small ones."""
    df.hint("rebalance", *partitions).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", max_records).partitionBy(*partitions).parquet(path)


def write_static(df: DataFrame, path: str, partition: dict[str, str]) -> None:
    """Write all rows into one named partition, replacing it."""
    df.withColumns({k: F.lit(v) for k, v in partition.items()}).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition).parquet(path)


def partition_time(dt: Column, hm: Column | None = None) -> Column:
    """Time of a partition from its values by the pattern '$dt $hm:00'; a missing or unreadable hm means midnight."""
    day = F.try_to_timestamp(dt, F.lit("yyyy-MM-dd"))
    whole = day if hm is None else F.coalesce(F.try_to_timestamp(F.concat(dt, F.lit(" "), hm, F.lit(":00")), F.lit("yyyy-MM-dd HH:mm:ss")), day)
    return whole.cast("timestamp_ntz")


def committable(parts: DataFrame, start: str, length: str, delay: str, watermark: Column) -> DataFrame:
    """Partitions that the watermark has passed by ``delay``."""
    return parts.where(watermark > F.expr(f"{start} + interval {length} + interval {delay}"))


def commit(spark: SparkSession, path: str, partitions: list[str], policy: Callable[[str], None] | None = None) -> None:
    """Mark partition folders as complete: an empty _SUCCESS file, written through Hadoop's file system, then ``policy(folder)``."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for p in partitions:
        target = jvm.org.apache.hadoop.fs.Path(f"{path}/{p}/_SUCCESS")
        target.getFileSystem(conf).create(target, True).close()
        if policy:
            policy(f"{path}/{p}")


def latest_partition(df: DataFrame, column: str) -> DataFrame:
    """Rows of the greatest partition, found by a scalar subquery that Spark turns into partition pruning."""
    return df.where(F.col(column) == df.select(F.max(column)).scalar())


def remove(spark: SparkSession, path: str) -> bool:
    """Delete a file or folder of any file system that Spark knows; False if it isn't there."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def compact(spark: SparkSession, path: str, out: str, files: int) -> None:
    """Rewrite a table's many small files as ``files`` files at ``out``, without a shuffle."""
    spark.read.parquet(path).coalesce(files).write.mode("overwrite").parquet(out)


def kafka_source(spark: SparkSession, servers: str, topic: str, start: str = "latest", timestamp: int | None = None, rate: int | None = None) -> DataFrame:
    """A Kafka topic as a stream, from earliest, latest or a time in ms (needs Spark's Kafka package)."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    reader = reader.option("startingTimestamp", timestamp) if timestamp is not None else reader.option("startingOffsets", start)
    return (reader.option("maxOffsetsPerTrigger", rate) if rate else reader).load()


def file_source(spark: SparkSession, path: str, schema: str, kind: str = "json", files_per_batch: int | None = None) -> DataFrame:
    """Files of a folder as a stream: those there first, then new ones."""
    reader = spark.readStream.format(kind).schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).load(path)


def socket_source(spark: SparkSession, host: str, port: int) -> DataFrame:
    """Lines of a socket as a stream (for demonstrations)."""
    return spark.readStream.format("socket").option("host", host).option("port", port).load()


def generated(spark: SparkSession, rows: int, seed: int = 0) -> DataFrame:
    """Bounded generated rows: id in sequence and a random value."""
    return spark.range(rows).withColumn("value", F.rand(seed))


def write_files(df: DataFrame, path: str, kind: str = "parquet", buckets: list[str] | None = None, max_records: int = 0, mode: str = "append", **options: str) -> None:
    """Bulk sink: parquet, orc, text, json or avro (needs Spark's Avro package), in files of at most ``max_records`` rows, one set of folders per value of the ``buckets`` columns."""
    writer = (df.hint("rebalance", *buckets) if buckets else df).write.format(kind).mode(mode).options(**options).option("maxRecordsPerFile", max_records)
    (writer.partitionBy(*buckets) if buckets else writer).save(path)


def time_bucket(ts: str, pattern: str = "yyyy-MM-dd--HH") -> Column:
    """Folder name of a row's time bucket."""
    return F.date_format(ts, pattern)


def kafka_sink(df: DataFrame, servers: str, topic: str, checkpoint: str, keys: list[str] | None = None):
    """Write a stream to a topic as JSON, appended or (with ``keys``) keyed for upserts (needs Spark's Kafka package)."""
    rows = key_value(df, keys) if keys else df.select(F.to_json(F.struct(*df.columns)).alias("value"))
    return rows.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("checkpointLocation", checkpoint)
