"""A session with the settings that the operators expect."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def builder(name: str = "rillflow", shared: str | None = None) -> SparkSession.Builder:
    """UTC, adaptive execution with skew handling, and RocksDB state for streams. ``shared`` is a folder that all executors see (spark.checkpoint.dir); it is left alone if not given."""
    b = (
        SparkSession.builder.appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    )
    return b.config("spark.checkpoint.dir", shared) if shared else b


def shared_folder(spark: SparkSession) -> str:
    """A new folder's path under the folder that driver and executors share: ``spark.checkpoint.dir``, or else the one given by ``SparkContext.setCheckpointDir``.

    Where neither is set, a local session gets a temporary one, and any other master is an error, as executors would write to their own disks.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="rillflow-")
        context.setCheckpointDir(base)
    return f"{base.rstrip('/')}/rillflow/{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: later steps read it again instead of computing it again, and survive lost executors."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
