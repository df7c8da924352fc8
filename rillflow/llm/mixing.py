"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, written

WEIGHTS = (5, 2, 1)  #: of the sources in order, repeating
SHARE = 1.5  #: of all words is what the mix takes
CAP = 2  #: times its own size a source or a document is taken at most
ROUNDS = 100  #: Newton steps at most; a handful is usual, and halving the bracket closes it in 60
HASH_RANGES = 1024  #: parts in which the documents of one size are ranked


def _ranked(df: DataFrame, *order: Column) -> DataFrame:
    """Adds rank, from 0, in a total order: sorted in ranges, whose sizes are added up. No task sees more than a range."""
    held = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    sizes = held.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("m"))
    sizes = written(sizes.select("part", F.coalesce(F.sum("m").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")))
    return held.join(sizes, part == F.col("part")).withColumn("rank", F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).drop("part", "before", "at")


def targets(totals: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """totals (source, words): adds target. Sources in code point order, null last, share ``share`` of all words by weight; what exceeds ``cap`` times a source goes to the others by weight until none is above.

    Each round is one sum over sources: those at or above their cap at the present words per weight are full, and the others share what is left. The words
    per weight only grow, so rounds end when no source becomes full. Sources may be as many as hosts are.
    """
    t = _ranked(totals, F.col("source").isNull(), F.col("source").cast("binary"))
    t = written(t.select("source", "words", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int")).alias("weight")))
    level, full = 0.0, -1
    while True:
        capped = cap * F.col("words") <= level * F.col("weight")
        r = t.agg(F.sum("words"), F.sum("weight"), F.sum(F.when(capped, cap * F.col("words"))), F.sum(F.when(capped, F.col("weight"))), F.count_if(capped)).first()
        if r[4] <= full or not r[1] or r[1] == r[3]:
            break
        level, full = (share * r[0] - (r[2] or 0)) / (r[1] - (r[3] or 0)), r[4]
    return t.select("source", "words", F.least(F.lit(level) * F.col("weight"), cap * F.col("words")).cast("double").alias("target"))


def _planned(cap: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def plan(cells: pd.DataFrame) -> pd.DataFrame:
        cells = cells.sort_values("size", ascending=False).reset_index(drop=True)
        carry, copies = 0.0, np.zeros(len(cells), np.int64)
        for k, (size, n, rate) in enumerate(zip(cells["size"], cells["n"], cells["rate"])):
            if size > 0:
                want = float(n) * rate * size + carry
                copies[k] = min(max(int(want / size + 0.5), 0), cap * int(n))
                carry = want - float(copies[k]) * size
        return cells.assign(copies=copies)[["source", "size", "n", "rate", "copies"]]

    return plan


def rates(cells: DataFrame, cap: int = CAP) -> DataFrame:
    """cells (source, size, n, target, words): adds lam and rate.

    Entropy balancing with bounded rates: of all document rates between 0 and ``cap``, those nearest to 1 in relative entropy
    under which each source's words reach its target are exponentially tilted, cap * e^x / (cap - 1 + e^x) with x = lam * size / mean size. The
    convex dual has one unknown a source; each Newton step is one grouped sum over all sources at once, kept inside a bracket, and
    the state of a step is written to the shared folder. A source is done when its words are within 1e-9 of its target, or when its bracket has closed on the
    nearest that its sizes allow; if any isn't after ROUNDS steps, that is an error.
    """
    base = cells.withColumn("scaled", F.col("size") * F.sum("n").over(Window.partitionBy("source")) / F.greatest(F.col("words"), F.lit(1)))
    base = written(base)
    tilt = F.exp(F.least(F.greatest(F.col("lam") * F.col("scaled"), F.lit(-60.0)), F.lit(60.0)))
    rate = cap * tilt / (cap - 1 + tilt)
    state = written(base.groupBy("source").agg(F.max("target").alias("target"), F.max("words").alias("words")).select("source", "target", "words", F.lit(0.0).alias("lam"), F.lit(-1e4).alias("lo"), F.lit(1e4).alias("hi"), (F.col("target") >= cap * F.col("words")).alias("done")))
    for step_no in range(ROUNDS + 1):
        if state.where("not done").isEmpty():
            break
        if step_no == ROUNDS:
            raise RuntimeError(f"rates of {state.where('not done').count()} sources did not converge in {ROUNDS} steps")
        b, s = base.select(F.col("source").alias("own"), "size", "n", "scaled"), state
        sums = b.join(s, b["own"].eqNullSafe(s["source"])).groupBy("source").agg(F.sum(F.col("n") * F.col("size") * rate).alias("got"), F.sum(F.col("n") * F.col("size") * F.col("scaled") * rate * (1 - rate / cap)).alias("slope"))
        sums = sums.select(F.col("source").alias("own"), "got", "slope")
        nxt = state.join(sums, state["source"].eqNullSafe(sums["own"]))
        high = F.col("got") > F.col("target")
        nxt = nxt.withColumns({"lo": F.when(high, F.col("lo")).otherwise(F.col("lam")), "hi": F.when(high, F.col("lam")).otherwise(F.col("hi"))})
        newton = F.col("lam") - (F.col("got") - F.col("target")) / F.when(F.col("slope") > 0, F.col("slope"))
        inside = (newton > F.col("lo")) & (newton < F.col("hi"))
        close = (F.abs(F.col("got") - F.col("target")) <= 1e-9 * F.greatest(F.col("target"), F.lit(1.0))) | (F.col("hi") - F.col("lo") <= 1e-13 * F.greatest(F.abs("lam"), F.lit(1.0)))
        step = F.when(F.col("done") | close, F.col("lam")).when(inside, newton).otherwise((F.col("lo") + F.col("hi")) / 2)
        state = written(nxt.select("source", "target", "words", step.alias("lam"), "lo", "hi", (F.col("done") | close).alias("done")))
    s = state.select(F.col("source").alias("own"), "lam")
    out = base.join(s, base["source"].eqNullSafe(s["own"])).drop("own")
    return out.withColumn("rate", F.when(F.col("target") >= cap * F.col("words"), F.lit(float(cap))).otherwise(rate))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: int = CAP, seed: int = 11, id_col: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """How often the mix takes each document: id, text_hash, size (words), source, source_size, target (its source's), copies, and the columns ``carry``.

    ``targets`` gives each source's words, ``rates`` the tilted rates, which are rounded into copies: over the sizes of a source from the largest, the copies of all documents of one
    size are rounded so that the words left over pass to the next size; they end below half the least size. Within a size all have the same rate, so a hash of seed, id and text decides who takes one copy more:
    documents are ranked by it in ranges, whose counts say how many of each range are chosen. A source's sizes
    (as many rows as it has different sizes) pass through one task for the rounding; documents never do.
    Reruns agree. Null texts have size 0 and are never taken; null ids and sources are ordinary values; equal rows are ranked among themselves at will; other columns are ignored; an empty table gives no rows.
    """
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    carried = [f"carried_{c}" for c in carry]
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), "source", size.alias("size"), *[F.col(c).alias(o) for c, o in zip(carry, carried)])
    order = F.xxhash64(F.lit(seed), "id", "text_hash")
    rows = written(rows.withColumns({"order": order, "part": F.pmod(order, F.lit(HASH_RANGES)).cast("int")}))
    fine = written(rows.groupBy("source", "size", "part").agg(F.count(F.lit(1)).alias("m")))
    cells = fine.groupBy("source", "size").agg(F.sum("m").alias("n"))
    goal = written(targets(cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("words")), weights, share, cap).withColumnRenamed("source", "own"))
    with_goal = cells.join(goal, cells["source"].eqNullSafe(goal["own"])).drop("own")
    plan = rates(with_goal, cap).select("source", "size", "n", "rate").groupBy("source").applyInPandas(_planned(cap), "source string, size long, n long, rate double, copies long")
    plan = plan.select(F.col("source").alias("own"), F.col("size").alias("own_size"), F.expr("copies div n").alias("each"), F.expr("copies % n").alias("extra"))
    before = Window.partitionBy("source", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    fine = fine.withColumn("before", F.coalesce(F.sum("m").over(before), F.lit(0)))
    parts = written(fine.join(plan, fine["source"].eqNullSafe(plan["own"]) & (fine["size"] == plan["own_size"])).select("own", "own_size", F.col("part").alias("own_part"), "each", (F.col("extra") - F.col("before")).alias("more")))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("source", "size", "part").orderBy("order", "id", "text_hash", *carried)))
    ranked = ranked.join(parts, ranked["source"].eqNullSafe(parts["own"]) & (ranked["size"] == parts["own_size"]) & (ranked["part"] == parts["own_part"]))
    taken = ranked.withColumn("copies", F.col("each") + (F.col("rank") <= F.col("more")).cast("long"))
    taken = taken.join(goal.select(F.col("own").alias("g"), "words", "target"), F.col("source").eqNullSafe(F.col("g")))
    return taken.select(F.col("id").alias(id_col), "text_hash", "size", "source", F.col("words").alias("source_size"), "target", F.when(F.col("size") > 0, F.col("copies")).otherwise(0).alias("copies"), *[F.col(o).alias(c) for c, o in zip(carry, carried)])
