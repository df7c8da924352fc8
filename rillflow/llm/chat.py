"""Chat formatting by prefix-target expansion, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks of the template: a turn is OPEN role MIDDLE text CLOSE.
OPEN, MIDDLE, CLOSE = "<s>", "<m>", "</s>"


def escape(text: Column) -> Column:
    """Text in which no mark can occur: every backslash is doubled and every ``<`` gets one after it."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("<\\"))


def unescape(text: Column) -> Column:
    """The inverse of ``escape``."""
    return F.regexp_replace(text, r"(<)\\|\\(\\)", "$1$2")


def prefix_targets(rows: DataFrame, trained: str = "assistant") -> DataFrame:
    """One training example for each turn of role ``trained``: all turns before it as context, and it as the only text under the loss mask.

    rows: conv_id, turn, role, text; more columns are ignored. Returns conv_id, n_turns (of the example), complete
    (it holds the whole conversation), text, loss_start and loss_chars (code points of ``text``; 0 of them where nothing is
    trained). Turns after the last trained one, or of a conversation without any, make one last example without loss, so
    that no turn is lost. Null role or text count as empty, a null conv_id is a conversation of its own, turns that tie are in order of
    their formatted text and repeated rows are repeated turns. A conversation is one row of the output, hence it must fit in
    memory; it is shuffled once, its examples are not.
    """
    role, text = (escape(F.coalesce(c, F.lit(""))) for c in ("role", "text"))
    turns = rows.select(
        "conv_id",
        F.struct(
            "turn",
            F.concat(F.lit(OPEN), role, F.lit(MIDDLE), text, F.lit(CLOSE)).alias("piece"),
            F.coalesce(F.col("role") == trained, F.lit(False)).alias("train"),
            F.char_length(text).cast("long").alias("chars"),
        ).alias("t"),
    )
    each = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    each = each.select("conv_id", F.col("t.piece").alias("pieces"), F.size("t").alias("n"), F.explode(F.filter(F.transform("t", lambda t, i: F.struct((i + 1).alias("upto"), t["train"].alias("train"), t["chars"].alias("chars"), (i + 1 == F.size("t")).alias("last"))), lambda x: x["train"] | x["last"])).alias("x"))
    shown = each.select("conv_id", F.col("x.upto").cast("long").alias("n_turns"), (F.col("x.upto") == F.col("n")).alias("complete"), F.array_join(F.slice("pieces", F.lit(1), F.col("x.upto")), "").alias("text"), F.when(F.col("x.train"), F.col("x.chars")).otherwise(F.lit(0)).alias("loss_chars"), F.col("x.train").alias("train"))
    start = F.when(F.col("train"), F.char_length("text") - len(CLOSE) - F.col("loss_chars")).otherwise(F.lit(0))
    return shown.select("conv_id", "n_turns", "complete", "text", start.cast("long").alias("loss_start"), "loss_chars", "train")


def parsed_turns(text: Column) -> Column:
    """The turns of a formatted text as an array of (role, text), unescaped."""
    parts = F.split(text, CLOSE, -1)
    return F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: F.struct(unescape(F.split_part(F.substr(p, F.lit(len(OPEN) + 1)), F.lit(MIDDLE), F.lit(1))).alias("role"), unescape(F.split_part(p, F.lit(MIDDLE), F.lit(2))).alias("text")))


def digests(examples: DataFrame) -> DataFrame:
    """What reading the examples back gives, a row for each conversation (no shuffle after ``prefix_targets``)."""
    turns = F.array_join(F.transform(parsed_turns(F.col("text")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = unescape(F.expr("substring(text, int(loss_start) + 1, int(loss_chars))"))
    back = examples.select("conv_id", "n_turns", F.when(F.col("complete"), F.sha2(turns, 256)).alias("sha"), F.when(F.col("train"), F.struct("n_turns", loss.alias("loss"))).alias("loss"), F.char_length("text").cast("long").alias("chars"))
    all_loss = F.array_join(F.col("loss.loss"), "")
    grouped = back.groupBy("conv_id").agg(F.max("n_turns").alias("n_turns"), F.max("sha").alias("turns_sha256"), F.sort_array(F.collect_list("loss")).alias("loss"), F.sum("chars").alias("formatted_chars"))
    return grouped.select("conv_id", "n_turns", "turns_sha256", F.char_length(all_loss).cast("long").alias("loss_chars"), F.sha2(all_loss, 256).alias("loss_sha256"), "formatted_chars")
