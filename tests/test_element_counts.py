"""Counts of array elements by key: inside rows, and added up where rows share a key."""

import pytest
from pyspark.sql import functions as F

from rillflow.operators import aggregates as A
from rillflow.plans import QUERIES


def counts(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_words_are_not_shuffled(spark, sf):
    plan = QUERIES["unnest_array"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" in plan
    assert "Exchange" not in plan


@pytest.fixture(scope="module")
def tagged(spark):
    data = [(1, ["b", "a", "b", None]), (2, []), (3, None), (None, ["x"]), (None, ["x", "y"]), (1, ["b", "B "]), (4, [None, "", None, "é"])]
    return spark.createDataFrame(data, "k int, tags array<string>")


@pytest.mark.parametrize("shared_keys", [0, 1, 2, 1000])
def test_rows_that_share_a_key(tagged, shared_keys):
    want = [(1, None, 1), (1, "B ", 1), (1, "a", 1), (1, "b", 3), (4, None, 2), (4, "", 1), (4, "é", 1), (None, "x", 2), (None, "y", 1)]
    found = A.element_counts(tagged, ["k"], F.col("tags"), "tag", shared_keys)
    assert counts(found) == sorted(want, key=str)
    assert found.columns == ["k", "tag", "n"]


def test_as_exploded(spark, sf):
    words = spark.read.parquet(f"{sf}/documents.parquet").select((F.col("doc_id") % 150).alias("g"), "lang", F.split("text", " ").alias("words"))
    want = words.select("g", "lang", F.explode("words").alias("w")).groupBy("g", "lang", "w").agg(F.count(F.lit(1)).alias("n"))
    found = A.element_counts(words, ["g", "lang"], F.col("words"), "w")
    assert found.exceptAll(want).isEmpty()
    assert want.exceptAll(found).isEmpty()
