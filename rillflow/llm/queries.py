"""The registered queries of this package and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, langid, licenses, mixing, neardup, periodic, quality, sharding, substrings, tokens, trie, warc
from .common import table, words
from .oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]

N_SHARDS = 16


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = langid.fit(table(spark, sf_dir, "documents"))
    return langid.identify_pages(table(spark, sf_dir, "pages"), model)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shuffle_to_shards(table(spark, sf_dir, "documents"), N_SHARDS)
    text = F.coalesce("text", F.lit(""))
    return placed.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents")).drop("failed")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archive_roundtrip(table(spark, sf_dir, "pages"))
    refers = F.element_at(F.split(warc.header_field("head", "WARC-Refers-To"), ":"), 3)
    return records.select(
        "page_id",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        warc.base32(F.sha1("payload")).alias("payload_digest"),
        warc.header_field("head", "WARC-Type").alias("record_type"),
        F.when(refers != "null", refers.cast("long")).alias("refers_to"),
    )


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_hits(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.prefix_targets(rows.unionByName(probe)))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, convs = trie.rebuilt(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return trie.prefix_trie(turns, convs)


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substrings.without_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("h"))
    return periodic_digests(periodic.find_runs(repeating(docs)))


def repeating(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of docs (doc_id, text, h), where one text in ten, by ``h``, repeats a block of its words to its end."""
    w, n, g = F.col("w"), F.size("w"), F.floor(F.col("h") / 10)
    chosen = docs.where("h % 10 = 0").select("doc_id", "text", words(F.col("text")).alias("w"), g.alias("g")).where(n > 0)
    a = (F.col("g") % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + F.col("g") % 8))).cast("int")
    block = F.slice(w, a + 1, p)
    again = F.slice(F.flatten(F.array_repeat(block, F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
    made = chosen.select("doc_id", F.array_join(F.concat(F.slice(w, F.lit(1), a), again), " ").alias("text"))
    rest = docs.where(F.coalesce(F.col("h") % 10 != 0, F.lit(True)) | (F.size(words(F.col("text"))) == 0))
    return made.unionByName(rest.select("doc_id", "text"))


def periodic_digests(found: DataFrame) -> DataFrame:
    better = lambda x, r: F.when(r["length"] * x["period"] > x["length"] * r["period"], r).otherwise(x)
    best = F.aggregate("runs", F.get("runs", F.lit(0)), better)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    found = found.withColumn("best", best)
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_sharding": op2_sharding,
    "op3_decontamination": op3_decontamination,
    "op4_token_counts": op4_token_counts,
    "op5_quality_rules": op5_quality_rules,
    "op6_warc": op6_warc,
    "op7_license_scan": op7_license_scan,
    "op8_mixing": op8_mixing,
    "op9_near_dedup": op9_near_dedup,
    "op10_chat_formatting": op10_chat_formatting,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_periodic_runs": op13_periodic_runs,
}
