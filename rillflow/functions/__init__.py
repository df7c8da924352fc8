"""Scalar, table and aggregate functions that Spark lacks or names otherwise."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def substring_range(s: Column, begin: int, end: int) -> Column:
    """Characters ``begin`` (from 0) to ``end`` (excluded)."""
    return F.substring(s, begin + 1, end - begin)


def total_length(*columns: Column) -> Column:
    """Characters in all columns; a null counts 0."""
    out = F.lit(0)
    for c in columns:
        out = out + F.coalesce(F.length(c), F.lit(0))
    return out


def instr_nth(s: str, sub: str, start: int, nth: int) -> Column:
    """Place (from 1) of the ``nth`` occurrence of ``sub`` in column ``s`` at or after place ``start``; 0 if there is none."""
    places = F.expr(f"filter(sequence({start}, greatest({start}, length({s}))), i -> substring({s}, i, {len(sub)}) = '{sub}')")
    return F.coalesce(F.get(places, F.lit(nth - 1)), F.lit(0))


def hash_code(*columns: Column) -> Column:
    """A 64-bit hash; not the hash code of any other engine."""
    return F.xxhash64(*columns)


def parse_time(*parts_and_formats: tuple[Column, str]) -> Column:
    """The first of several (text, format) pairs that parses, as a timestamp without zone."""
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)).cast("timestamp_ntz") for c, f in parts_and_formats])


def register(spark: SparkSession) -> None:
    """Register the functions for SQL: substring_range, count_all (aggregate), split_rows (table function)."""

    @F.udf("string", useArrow=True)
    def substring_udf(s: str, begin: int, end: int) -> str:
        return None if s is None else s[begin:end]

    @F.pandas_udf("long")
    def count_all(x: pd.Series) -> int:
        return len(x)

    @F.udtf(returnType="info string")
    class SplitRows:
        def eval(self, s: str, sep: str) -> Iterator[tuple[str]]:
            for part in (s or "").split(sep) if s is not None else []:
                yield (part,)

    spark.udf.register("substring_range", substring_udf)
    spark.udf.register("count_all", count_all)
    spark.udtf.register("split_rows", SplitRows)
