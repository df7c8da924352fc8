"""Own sources over Spark's Python Data Source API: tables of a database with a Python driver, and numbered rows, each with partitions, offsets and a row limit a batch.

As a stream, what the driver plans and Spark's offset log keeps are ranges of a key; tasks read the ranges, each over a connection of its own, so that no row passes through the driver.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

RANGE = "low bigint, high bigint"


def connected(options: dict):
    """A DB-API connection: ``connect`` names the function as module:function, ``arguments`` are its arguments as JSON."""
    module, name = options["connect"].split(":")
    return getattr(importlib.import_module(module), name)(*json.loads(options.get("arguments", "[]")))


def fetched(options: dict, columns: list[str], low: int | None, high: int | None, size: int = 10_000) -> Iterator[list[tuple]]:
    """Rows of the table with low < key <= high, in order of the key, some at a time. No ``low`` also takes rows without a key."""
    key = options["key"]
    parts = ([f"{key} > {int(low)}"] if low is not None else []) + ([f"{key} <= {int(high)}" if low is not None else f"({key} <= {int(high)} or {key} is null)"] if high is not None else [])
    connection = connected(options)
    try:
        cursor = connection.cursor()
        cursor.execute(f"select {', '.join(columns)} from {options['table']}{' where ' + ' and '.join(parts) if parts else ''} order by {key}")
        while rows := cursor.fetchmany(size):
            yield [tuple(r) for r in rows]
    finally:
        connection.close()


def _one(options: dict, sql: str):
    connection = connected(options)
    try:
        cursor = connection.cursor()
        cursor.execute(sql)
        return cursor.fetchone()
    finally:
        connection.close()


class Range(InputPartition):
    def __init__(self, low: int | None, high: int | None):
        self.low, self.high = low, high


class TableReader(DataSourceReader):
    """The whole table in ``partitions`` ranges of its key, the first with all below and nulls, the last with all above."""

    def __init__(self, options: dict, columns: list[str]):
        self.options, self.columns = options, columns

    def partitions(self) -> list[InputPartition]:
        low, high = _one(self.options, f"select min({self.options['key']}), max({self.options['key']}) from {self.options['table']}")
        n = int(self.options.get("partitions", "1"))
        if low is None or n < 2:
            return [Range(None, None)]
        cuts = sorted({low + (high - low) * i // n for i in range(1, n)})
        return [Range(a, b) for a, b in zip([None, *cuts], [*cuts, None])]

    def read(self, partition: Range) -> Iterator[tuple]:
        for rows in fetched(self.options, self.columns, partition.low, partition.high):
            yield from rows


class KeyRanges(SimpleDataSourceStreamReader):
    """Ranges (low, high] of the key that follow an offset: ``rowsPerBatch`` rows in all at most, in ``partitions`` ranges of as many rows each."""

    def __init__(self, options: dict):
        self.options = options
        self.most, self.n = int(options.get("rowsPerBatch", "100000")), int(options.get("partitions", "1"))

    def initialOffset(self) -> dict:  # noqa: N802  names that Spark calls
        return {"key": int(self.options.get("from", "-1"))}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        ends, at, each = [], start["key"], max(1, -(-self.most // self.n))
        for i in range(self.n):
            end = self.after(at, min(each, self.most - i * each))
            if end is None:
                break
            ends.append((at, end))
            at = end
        return iter(ends), {"key": at}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        ranges, last = self.read(start)
        return iter([(a, min(b, end["key"])) for a, b in ranges if a < end["key"]] + ([(last["key"], end["key"])] if last["key"] < end["key"] else []))

    def after(self, key: int, rows: int) -> int | None:
        """The key of the last of the ``rows`` rows after ``key``, None if there is none."""
        if rows < 1:
            return None
        name, table = self.options["key"], self.options["table"]
        return _one(self.options, f"select max({name}) from (select {name} from {table} where {name} > {int(key)} order by {name} limit {int(rows)}) as t")[0]


class NumberRanges(KeyRanges):
    """Ranges of the numbers from 0 to ``rows`` less 1."""

    def after(self, key: int, rows: int) -> int | None:
        last = min(key + rows, int(self.options["rows"]) - 1)
        return last if rows > 0 and last > key else None


class TableSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rillflow_table"

    def schema(self) -> str:
        raise ValueError("give the table's schema")

    def reader(self, schema) -> DataSourceReader:
        return TableReader(dict(self.options), schema.names)


class RangeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rillflow_ranges"

    def schema(self) -> str:
        return RANGE

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:  # noqa: N802
        options = dict(self.options)
        options |= {"rowsPerBatch": options["rowsperbatch"]} if "rowsperbatch" in options else {}
        return (KeyRanges if "table" in options else NumberRanges)(options)


def _ranges(spark: SparkSession, options: dict, partitions: int) -> DataFrame:
    spark.dataSource.register(RangeSource)
    stream = spark.readStream.format("rillflow_ranges").options(**options, partitions=str(partitions)).load()
    return stream.repartition(partitions, "low")


def _table_options(connect: str, arguments: list, table: str, key: str) -> dict:
    return {"connect": connect, "arguments": json.dumps(arguments), "table": table, "key": key}


def read_table(spark: SparkSession, connect: str, arguments: list, table: str, key: str, schema: str, partitions: int = 1) -> DataFrame:
    """A table of a database, read by tasks in ``partitions`` ranges of the numeric column ``key`` through the DB-API function ``connect`` (module:function) with ``arguments``."""
    spark.dataSource.register(TableSource)
    return spark.read.format("rillflow_table").schema(schema).options(**_table_options(connect, arguments, table, key), partitions=str(partitions)).load()


def poll_table(spark: SparkSession, connect: str, arguments: list, table: str, key: str, schema: str, rows_per_batch: int, partitions: int = 1, start: int = -1) -> DataFrame:
    """Rows that are added to a table, as a stream: those with a ``key`` above ``start`` first, ``rows_per_batch`` a batch at most, then new ones.

    Keys must be whole numbers that tell rows apart, and a row must be seen before those with greater keys. The offset is the last key read; a
    stream that restarts from its checkpoint loses and repeats none. The driver asks for ``partitions`` keys a batch.
    """
    options = _table_options(connect, arguments, table, key)
    found = _ranges(spark, options | {"rowsPerBatch": str(rows_per_batch), "from": str(start)}, partitions)
    names = spark.createDataFrame([], schema).columns

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for low, high in zip(frame["low"], frame["high"]):
                for rows in fetched(options, names, low, high):
                    yield pd.DataFrame(rows, columns=names)

    return found.mapInPandas(read, schema)


def numbered_stream(spark: SparkSession, rows: int, rows_per_batch: int, partitions: int = 1, make: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The numbers from 0 to ``rows`` less 1 as a stream (id), ``rows_per_batch`` a batch; ``make`` derives columns. The same numbers come in the same batches after a restart."""
    from pyspark.sql import functions as F

    ids = _ranges(spark, {"rows": str(rows), "rowsPerBatch": str(rows_per_batch)}, partitions).select(F.explode(F.sequence(F.col("low") + 1, "high")).alias("id"))
    return make(ids) if make else ids
