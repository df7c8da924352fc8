"""Corpus pipeline over ``documents``: language ID, near-duplicate removal, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
stage's docs. All but the last return the columns of docs, whatever their names. Rows equal in all columns stand for each other; null ids and texts and repeated rows
are ordinary, texts of any length are read whole, and with empty documents each stage gives none, with an empty benchmark decontamination drops none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.llm import decontaminate, langid, mixing, neardup, sharding
from rillflow.llm.common import made, release, table, unused, written

N_SHARDS = 16
LEAST_CONFIDENCE = 0.5


def _plain(docs: DataFrame) -> list[str]:
    return [F.col(f"`{c}`") for c in docs.columns]


def _with_row(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a hash of the whole row, and that column's name."""
    (name,) = unused(docs.columns, "row_hash")
    whole = [F.to_json(F.struct(F.col(f"`{c}`"))) if "map<" in t or "variant" in t else F.col(f"`{c}`") for c, t in docs.dtypes]
    return docs.withColumn(name, F.xxhash64(*whole)), name


def _decided(docs: DataFrame, decided: DataFrame, how: str, *also: str) -> DataFrame:
    """Join docs to decisions (doc_id, text_hash, also ...) by doc_id, a hash of the text, and further columns of docs."""
    taken = [*docs.columns, *decided.columns]
    i, h, text, *more = unused(taken, "d_id", "d_hash", "d_text", *[f"d_{c}" for c in also])
    decided = decided.withColumnsRenamed({"doc_id": i, "text_hash": h, **dict(zip(also, more))})
    both = docs.withColumn(text, F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col(i)) & (F.col(text) == F.col(h))
    for c, o in zip(also, more):
        same = same & (F.col(c) == F.col(o))
    return both.join(decided, same, how)


def _times(docs: DataFrame, row: str, decided: DataFrame) -> DataFrame:
    """Each row as often as ``decided`` says (doc_id, text_hash, row, n, times): n equal rows stand for each other, and make ``times`` in all."""
    n, times, again = unused(docs.columns, "n", "times", "again")
    decided = decided.withColumnsRenamed({"n": n, "times": times}).where(F.col(times) > 0)
    every = F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))
    plain = [F.col(f"`{c}`") for c in docs.columns if c != row]
    single = _decided(docs, written(decided.where(F.col(n) == 1)), "inner", row).select(*plain, row, times)
    several = _decided(docs, written(decided.where(F.col(n) > 1)), "inner", row).select(*plain, row, times).dropDuplicates(["doc_id", row])
    return single.unionByName(several).withColumn(again, every).select(*plain)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without letters, of a language that stays unsure, or whose declared language the evidence contradicts."""
    rows, row = _with_row(docs)
    found = langid.identify_documents(rows, langid.fit(docs), carry=(row,))
    bad = (F.col("grams") == 0) | (F.col("confidence") < LEAST_CONFIDENCE) | ((F.col("declared") != "") & (F.col("declared") != F.col("lang")))
    rejected = written(found.where(bad).select("doc_id", "text_hash", row).distinct())
    return _decided(rows, rejected, "left_anti", row).select(_plain(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates."""
    rows, row = _with_row(docs)
    found = neardup.near_duplicates(rows, carry=(row,))
    return _times(rows, row, found.groupBy("doc_id", "text_hash", row).agg(F.count(F.lit(1)).alias("n"), F.count_if("stays").alias("times")))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    hits = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"))
    return _decided(docs, written(hits.select("doc_id", "text_hash").distinct()), "left_anti").select(_plain(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat each document as often as the mix takes it."""
    rows, row = _with_row(docs)
    return _times(rows, row, mixing.mix(rows, carry=(row,)).groupBy("doc_id", "text_hash", row).agg(F.count(F.lit(1)).alias("n"), F.sum("copies").alias("times")))


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shuffle all rows into shards of equal size."""
    return sharding.shuffle_to_shards(docs, N_SHARDS)


STAGES = [
    ("language ID", language),
    ("near-duplicate removal", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing to target weights", mix),
    ("sharding", shards),
]

#: SQL can't express the trained language model; tests/llm/test_pipeline.py runs brute-force versions of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``. What a stage wrote for itself is removed once its result is written."""
    docs = table(spark, sf_dir, "documents")
    start = made()
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
        release(spark, start, keep=1)
    return STAGES[-1][1](spark, docs, sf_dir)
