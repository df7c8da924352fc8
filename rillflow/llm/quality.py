"""Quality rules with thresholds from mergeable quantile sketches, with DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, words, written

#: The rates that get bounds, per thousand: what is counted, of how many, and whether there is a lower bound.
RATES = {
    "word_chars_k": ("word_chars", "n_words", True),
    "symbols_k": ("n_symbols", "n_words", False),
    "dup_lines_k": ("n_dup_lines", "n_lines", False),
    "repeats_k": ("n_repeat_words", "n_words", False),
}
LEVELS = (0.1, 0.5, 0.9)  #: quantiles that bounds are made of
WIDTH = 4  #: a bound lies so many times as far beyond the outer quantile as that lies from the median
PRIOR = 100.0  #: documents that a wider level of sketches weighs as
SIGMAS = 3  #: standard deviations of a count (its square root) that a document must exceed a bound by


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines and n_repeat_words of every whole text; a null text has none of them."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    out = docs.withColumns({
        "word_chars": F.char_length(F.translate(t, BLANKS, "")).cast("long"),
        "n_symbols": (F.char_length(t) - F.char_length(F.translate(t, "#*$%&|<>", ""))).cast("long"),
        "__lines": lines,
        "__hash": F.transform(words(F.col(text)), lambda x: F.xxhash64(x)),
    })
    out = out.withColumns({"n_words": F.size("__hash").cast("long"), "n_lines": F.size("__lines").cast("long"), "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long")})
    three = F.transform(F.slice("__hash", F.lit(1), F.greatest(F.size("__hash") - 2, F.lit(0))), lambda h, i: F.xxhash64(h, F.get("__hash", i + 1), F.get("__hash", i + 2)))
    out = out.withColumn("__three", three)
    unique = F.size(F.array_distinct("__three")) == F.size("__three")
    out = out.withColumn("__sorted", F.when(~unique, F.sort_array(F.transform("__three", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    near = F.arrays_zip("__sorted", F.slice("__sorted", 2, 2**30).alias("__next"), F.concat(F.slice("__sorted", 1, 1), F.col("__sorted")).alias("__last"))
    twice = lambda r: (r["__sorted"]["h"] == r["__next"]["h"]) | ((r["__sorted"]["h"] == r["__last"]["h"]) & (r["__sorted"]["i"] != r["__last"]["i"]))
    out = out.withColumn("__at", F.sort_array(F.transform(F.filter(near, lambda r: F.coalesce(twice(r), F.lit(False))), lambda r: r["__sorted"]["i"])))
    covered = F.aggregate(F.arrays_zip("__at", F.slice("__at", 2, 2**30).alias("__to")), F.lit(0).cast("long"), lambda s, r: s + F.least(F.lit(3), F.coalesce(r["__to"] - r["__at"], F.lit(3))))
    return out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0))).drop("__lines", "__hash", "__three", "__sorted", "__at")


def bin_of(v: Column) -> Column:
    """The bin of a whole number in a sketch: its six leading bits, so that a bin is at most 1/32 of its value wide."""
    shift = F.greatest(F.char_length(F.bin(v)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, shift), shift)


def sketches(rates: DataFrame, by: list[str]) -> DataFrame:
    """A quantile sketch of each rate and group: rows (by, rate, bin, n). Two sketches merge by adding ``n``; memory of a group is its number of bins, some thousands at most."""
    long = rates.select(*by, F.explode(F.array(*[F.struct(F.lit(k).alias("rate"), F.col(k).alias("v")) for k in RATES])).alias("x"))
    return long.select(*by, "x.rate", bin_of(F.col("x.v")).alias("bin")).groupBy(*by, "rate", "bin").agg(F.count(F.lit(1)).alias("n"))


def merged(sketch: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of coarser groups from finer ones."""
    return sketch.groupBy(*by, "rate", "bin").agg(F.sum("n").alias("n"))


def bounds(sketch: DataFrame) -> DataFrame:
    """Bounds of each group from its sketch (lang, source, rate, bin, n): lang, source, rate, low, high.

    The quantiles come from the group's distribution merged with that of its language as if by PRIOR more documents, which is merged with that of all documents likewise; so a group with few documents
    passes into its language without a step. With quantiles a, b and c at LEVELS, low is a - WIDTH * (b - a) and high c + WIDTH * (c - b), or the mean of the merged
    distribution where that is more: where most documents have none of what is counted, all three are 0, and what counts as much is then the group's mean, which the
    documents that have very much of it raise, but not up to themselves.
    Each sketch is one array of its bins (some hundreds), and one pass over the bins finds the quantiles.
    """
    packed = lambda by: merged(sketch, by).groupBy(*by, "rate").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("held"), F.sum("n").alias("total"), F.sum(F.col("bin") * F.col("n")).alias("sum"))
    own, wide, whole = packed(["lang", "source"]), packed(["lang"]), packed([])
    wide = wide.select(F.col("lang").alias("l"), F.col("rate").alias("r"), F.col("held").alias("l_held"), F.col("total").alias("l_total"), F.col("sum").alias("l_sum"))
    whole = whole.select(F.col("rate").alias("a"), F.col("held").alias("a_held"), F.col("total").alias("a_total"), F.col("sum").alias("a_sum"), F.array_sort(F.map_keys("held")).alias("bins"))
    both = own.join(wide, own["lang"].eqNullSafe(wide["l"]) & (own["rate"] == wide["r"])).join(whole, own["rate"] == whole["a"])
    step = """aggregate(bins, named_struct('a', 0L, 'l', 0L, 'g', 0L, 'q', cast(array({none}) as array<bigint>)), (s, x) -> transform(array(
        named_struct('a', s.a + a_held[x], 'l', s.l + coalesce(try_element_at(l_held, x), 0L), 'g', s.g + coalesce(try_element_at(held, x), 0L), 'q', s.q)), t -> named_struct('a', t.a, 'l', t.l, 'g', t.g,
        'q', transform(t.q, (q, i) -> if(q is null and (t.g + {m} * ((t.l + {m} * (t.a / a_total)) / (l_total + {m}))) / (total + {m}) >= array({levels})[i], x, q))))[0]).q"""
    found = both.withColumn("q", F.expr(step.format(none=", ".join(["null"] * 3), m=f"{PRIOR}D", levels=", ".join(f"{x}D" for x in LEVELS))))
    q = [F.get("q", F.lit(i)) for i in range(3)]
    mean = F.expr(f"(sum + {PRIOR}D * ((l_sum + {PRIOR}D * (a_sum / a_total)) / (l_total + {PRIOR}D))) / (total + {PRIOR}D)")
    return found.select("lang", "source", "rate", (q[0] - WIDTH * (q[1] - q[0])).alias("low"), F.greatest((q[2] + WIDTH * (q[2] - q[1])).cast("double"), mean).alias("high"))


def beyond(excess: Column, count: Column) -> Column:
    """A count that is by ``excess`` thousandths off what a bound allows is off by more than SIGMAS standard deviations."""
    d = excess.cast("double")
    return (d > 0) & (d * d > F.lit(SIGMAS**2 * 1e6) * count)


def judged(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Verdicts on documents (doc_id, text, lang, source): id, the counts of ``measured``, base_failed, kept and failed (the rates out of bounds).

    A document is kept unless base_failed (fewer than 50 words, or over half of them in repeated windows) or a rate lies outside the ``bounds`` of its
    language and source by more than chance explains: a count beyond the bound by more than SIGMAS times its square root. All rates have the same rule; no cutoff is fixed.
    Documents with base_failed don't count in sketches. Null languages and sources are groups of their own; a null text has no words and fails; repeated rows have a verdict each; an empty table gives no rows; columns that clash are not read.
    The counts are written once to the shared folder (narrow); bounds, a row per language and source, are joined at their known size. A hot source is one group of some hundred bins, added up in each task before the shuffle.
    """
    rates = {k: F.expr(f"1000 * {count} div greatest({of}, 1)") for k, (count, of, _) in RATES.items()}
    counts = measured(docs.select(id_col, "text", "lang", "source")).drop("text")
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    counts = written(counts.withColumn("base_failed", base).withColumns(rates))
    fine = written(sketches(counts.where("not base_failed"), ["lang", "source"]))
    picked = bounds(fine).groupBy("lang", "source").agg(*[F.max(F.when(F.col("rate") == k, F.col(c))).alias(f"{k}_{c}") for k in RATES for c in ("low", "high")])
    picked = written(picked.withColumnsRenamed({"lang": "f_lang", "source": "f_source"}))
    both = counts.join(picked, counts["lang"].eqNullSafe(picked["f_lang"]) & counts["source"].eqNullSafe(picked["f_source"]), "left")
    out = {}
    for k, (count, of, lower) in RATES.items():
        c, n = F.col(count), F.col(of)
        out[k] = beyond(1000 * c - F.col(f"{k}_high") * n, c)
        if lower:
            out[k] = out[k] | beyond(F.col(f"{k}_low") * n - 1000 * c, c)
        out[k] = F.coalesce(out[k], F.lit(False))
    failed = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in out.items()]))
    return both.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~reduce(lambda a, b: a | b, out.values())).alias("kept"), failed.alias("failed"))
