"""The registry of queries, and the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query (spark, sf_dir) and its DuckDB SQL."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events with ``value`` as an exact decimal."""
    return t(spark, sf_dir, "events").withColumn("value", F.col("value").cast("decimal(18,2)"))


def of_type(df: DataFrame, kind: str) -> DataFrame:
    return df.where(F.col("event_type") == kind)


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share."""
    return shared_folder(spark)


#: SQL for the events with ``value`` as an exact decimal, and for an epoch-aligned window start.
EV = "(select event_id, ts, user_id, event_type, cast(value as decimal(18,2)) as value, props from events)"


def bucket(size: str, ts: str = "ts") -> str:
    return f"time_bucket(interval '{size}', {ts}, timestamp '1970-01-01')"


def total(column: str = "value") -> Column:
    """Exact sum of decimals as a double."""
    return F.sum(column).cast("double")
