"""Projections, routing and repartitioning."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def replicate(df: DataFrame, times: Column) -> DataFrame:
    """Each row ``times`` times; none where that is 0 or null."""
    return df.withColumn("__i", F.explode(F.array_repeat(F.lit(0), times))).drop("__i")


def split(df: DataFrame, routes: dict[str, Column], main: str = "main") -> dict[str, DataFrame]:
    """Route each row to the first of ``routes`` that it satisfies, else to ``main``: name -> DataFrame, each without the route column."""
    routed = routed_by(df, routes, main)
    return {name: routed.where(F.col("route") == name).drop("route") for name in [*routes, main]}


def routed_by(df: DataFrame, routes: dict[str, Column], main: str = "main") -> DataFrame:
    """Adds the name of the output that each row goes to, for a writer that partitions by it."""
    route = F.lit(main)
    for name, condition in reversed(routes.items()):
        route = F.when(condition, F.lit(name)).otherwise(route)
    return df.withColumn("route", route)


def flatten(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Flat view of a nested record: new name -> path."""
    return df.select(*[F.col(path).alias(name) for name, path in names.items()])


def per_partition(df: DataFrame, setup: Callable[[], object], each: Callable[[object, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Apply ``each(resource, batch)`` with one ``setup()`` for each partition, closed at its end where it has ``close``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        resource = setup()
        try:
            for batch in batches:
                yield each(resource, batch)
        finally:
            if hasattr(resource, "close"):
                resource.close()

    return df.mapInPandas(run, schema)


def shuffled(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """Rows to ``n`` partitions at random."""
    return df.repartition(n, F.rand(seed))


def rebalanced(df: DataFrame, n: int) -> DataFrame:
    """Rows to ``n`` partitions in turn."""
    return df.repartition(n)


def rescaled(df: DataFrame, n: int) -> DataFrame:
    """Fewer partitions without a shuffle."""
    return df.coalesce(n)


def observed(df: DataFrame, name: str) -> tuple[DataFrame, object]:
    """``df`` and an observation of its row count, filled by the next action."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen
