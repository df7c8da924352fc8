"""A table that is declared once and read as a table or as a stream: columns, computed columns and watermark."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Declared:
    """``schema`` is what the files hold, ``computed`` further columns as SQL over it (in order, so that later ones may use earlier ones), ``watermark`` the time column and the disorder it allows.

    The time column may be computed. As a stream it is a timestamp with a watermark; as a table it has the same type, and no rows are left out.
    """

    schema: str
    computed: dict[str, str] = field(default_factory=dict)
    watermark: tuple[str, str] | None = None
    kind: str = "parquet"
    options: dict[str, str] = field(default_factory=dict)

    def of(self, rows: DataFrame) -> DataFrame:
        """The declared columns of rows read with ``schema``; a watermark is set on streams."""
        for name, sql in self.computed.items():
            rows = rows.withColumn(name, F.expr(sql))
        if self.watermark:
            ts, delay = self.watermark
            rows = rows.withColumn(ts, F.col(ts).cast("timestamp"))
            rows = rows.withWatermark(ts, delay) if rows.isStreaming else rows
        return rows

    def table(self, spark: SparkSession, path: str) -> DataFrame:
        """The files of ``path`` as they are now."""
        return self.of(spark.read.format(self.kind).schema(self.schema).options(**self.options).load(path))

    def stream(self, spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
        """The files of ``path`` and those that come later."""
        limit = {"maxFilesPerTrigger": str(files_per_batch)} if files_per_batch else {}
        return self.of(spark.readStream.format(self.kind).schema(self.schema).options(**self.options, **limit).load(path))

    def late(self, rows: DataFrame, newest: str) -> DataFrame:
        """Adds late to a table's rows: those that a stream's watermark would have passed when it had seen the time ``newest`` (SQL)."""
        ts, delay = self.watermark
        return rows.withColumn("late", F.expr(f"{ts} < {newest} - interval {delay}"))
