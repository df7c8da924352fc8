"""Benchmark decontamination by SimHash fingerprints of item-sized windows, with DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, words, written

WORDS = 3  #: 64-bit words of a fingerprint
BLOCK_BITS = 16  #: of a block of the index; a fingerprint has 64 * WORDS / BLOCK_BITS of them
RADIUS = 47  #: of 192 bits; at similarity 0.75 a fingerprint strays further with probability 0.004, at 0.8 with 0.0003
WINDOWS = 50_000  #: that one task fingerprints, at most about
BROADCAST_ROWS = 1_000_000  #: item shingles up to this number are broadcast (16 MB), more are joined by a shuffle


def _run_hash(hashes: Column, start: Column, k: int) -> Column:
    """Hash of the ``k`` elements of an array of hashes from a place on."""
    return F.xxhash64(*[F.get(hashes, start + j) for j in range(k)])


def _places(array: str, k: int) -> Column:
    """The places where a run of ``k`` elements begins; null where there is none."""
    return F.when(F.size(array) >= k, F.sequence(F.lit(0), F.size(array) - k))


def _runs(array: str, k: int) -> Column:
    """Hashes of all runs of ``k`` elements."""
    return F.transform(_places(array, k), lambda p: _run_hash(F.col(array), p, k))


def fingerprint(shingles: str) -> Column:
    """SimHash of the bag of hashes in a column, as an array of WORDS longs: a bit is set if it is set in more than half of the hashes.

    Sums count several bits at once in lanes of 16 bits (of 32 bits in a bag of more than 32,767 hashes).
    """

    def word(seed: int, lanes: int) -> Column:
        width = 64 // lanes
        ones = sum(1 << (width * lane) for lane in range(lanes))
        own = F.transform(shingles, lambda x: F.xxhash64(x, F.lit(seed)))
        sums = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.aggregate(own, F.lit(0).cast("long"), lambda s, x: s + F.call_function("shiftrightunsigned", x, i).bitwiseAND(F.lit(ones))))
        bit = lambda x, i, lane: F.when(F.shiftrightunsigned(x, width * lane).bitwiseAND(F.lit((1 << width) - 1)) * 2 > F.size(shingles), F.call_function("shiftleft", F.lit(1).cast("long"), i + width * lane)).otherwise(F.lit(0).cast("long"))
        bits = F.transform(sums, lambda x, i: reduce(lambda a, b: a.bitwiseOR(b), [bit(x, i, lane) for lane in range(lanes)]))
        return F.aggregate(bits, F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))

    return F.array(*[F.when(F.size(shingles) <= 32767, word(seed, 4)).otherwise(word(seed, 2)) for seed in range(WORDS)])


def blocks(fp: str) -> Column:
    """The blocks of a fingerprint as an array of (block, value)."""
    each = 64 // BLOCK_BITS
    return F.array(*[F.struct(F.lit(b).alias("block"), F.shiftrightunsigned(F.get(fp, F.lit(b // each)), BLOCK_BITS * (b % each)).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int").alias("value")) for b in range(WORDS * each)])


def near_blocks(fp: str, radius: int) -> Column:
    """The blocks of a fingerprint and those a few bits off, such that every fingerprint within ``radius`` agrees with one of them.

    Of n blocks, the first radius % n + 1 take radius // n bits, and the others one bit less: if all blocks were further off, the whole would be by more than ``radius``.
    """
    n = 64 * WORDS // BLOCK_BITS

    def around(part: Column, most: int) -> Column:
        flips = F.lit([m for m in range(1 << BLOCK_BITS) if m.bit_count() <= most])
        return F.flatten(F.transform(part, lambda b: F.transform(flips, lambda m: F.struct(b["block"].alias("block"), b["value"].bitwiseXOR(m).alias("value")))))

    wide = radius % n + 1
    first, rest = F.slice(blocks(fp), 1, wide), F.slice(blocks(fp), wide + 1, n)
    return F.concat(around(first, radius // n), around(rest, radius // n - 1)) if radius >= n else around(first, 0)


def distance(a: str, b: str) -> Column:
    """Bits in which two fingerprints differ."""
    return reduce(lambda x, y: x + y, [F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(WORDS)])


def near_pairs(left: DataFrame, right: DataFrame, radius: int = RADIUS) -> DataFrame:
    """All pairs of fingerprints of one size within ``radius`` bits: left (n, fp) and right (n, i_fp), both distinct, give (n, fp, i_fp, distance).

    The multi-index: ``right`` (the items) is entered under each block and its neighbours, ``left`` is looked up by its blocks as they are.
    Neighbours are a fixed number for each item, 8,364 at 192 bits and radius 47, and a look-up meets one item of a size in eight by chance.
    """
    wanted = left.withColumn("b", F.explode(blocks("fp"))).select("n", "fp", "b.block", "b.value")
    entries = right.withColumn("b", F.explode(near_blocks("i_fp", radius))).select("n", "i_fp", "b.block", "b.value")
    return wanted.join(entries.hint("merge"), ["n", "block", "value"]).withColumn("distance", distance("fp", "i_fp")).where(F.col("distance") <= radius).select("n", "fp", "i_fp", "distance").distinct()


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard similarity of two bags of shingles, each weighted by how often it occurs: sum of lesser over sum of greater weights."""
    once = (F.size(F.array_distinct(a)) == F.size(a)) & (F.size(F.array_distinct(b)) == F.size(b))
    times = lambda bag, x: F.size(F.filter(bag, lambda y: y == x))
    both = F.when(once, F.size(F.array_intersect(a, b))).otherwise(F.aggregate(F.array_distinct(a), F.lit(0), lambda s, x: s + F.least(times(a, x), times(b, x))))
    return both / (F.size(a) + F.size(b) - both)


def starts(least: float) -> Column:
    """All starts of windows with enough hits, as disjoint ranges (low, high), from columns len (words of the text), k, n (words of the item) and at (sorted places of hits).

    A window of a shingles and an item of b need least * (a + b) / (1 + least) common ones. Windows whose first hit is the i-th begin after the hit before it, and late enough to
    reach the last hit they need; so each hit gives one range of starts.
    """
    a = F.least("n", "len") - F.col("k") + 1
    need = F.greatest(F.lit(1), F.ceil((a + F.col("n") - F.col("k") + 1) * (least / (1 + least)) - 1e-9)).cast("int")
    hits = F.arrays_zip(F.col("at").alias("first"), F.concat(F.array(F.lit(-1)), F.slice("at", F.lit(1), F.size("at") - 1)).alias("before"), F.slice("at", need, F.lit(2**30)).alias("last"))
    low = lambda h: F.greatest(h["before"] + 1, h["last"] - a + 1)
    high = lambda h: F.least(h["first"], F.greatest(F.col("len") - F.col("n"), F.lit(0)))
    some = F.filter(hits, lambda h: h["last"].isNotNull() & (low(h) <= high(h)))
    return F.transform(some, lambda h: F.struct(low(h).alias("low"), high(h).alias("high")))


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = 0.75, k: int = 5, radius: int = RADIUS, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents that hold a benchmark item: id, text_hash, item_id, start (word), n_words, distance (bits), similarity; one row, its best window within ``radius``, for each document and item.

    A window of a document is as many words long as the item (the whole text where that is shorter); the two match if the weighted Jaccard similarity of their
    k-word shingles (A-Z folded; an item of fewer than k words is one shingle) is ``least`` or more.

    1. All windows are looked at that hold as many shingles of items of their size, at any place and in any order, as a similarity of ``least`` takes;
       no other window can reach it. Item shingles are broadcast up to BROADCAST_ROWS, else joined by a shuffle.
    2. Each such window and each item gets a SimHash. ``near_pairs`` finds all items of a window's size within ``radius`` bits. A match at similarity 0.75 exactly lies
       outside with probability 0.004; a greater ``radius`` misses fewer and meets more.
    3. The similarity of each candidate is computed in full.

    Null or empty texts match nothing, and items without words are left out; rows equal in id and text are one; null ids and repeated items are
    ordinary; other columns are ignored; empty tables give no rows. A text is read whole, however long: it is held once while its places are
    looked up one by one; only the places of hits go on.
    """
    key = [F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash")]
    split = lambda c: words(fold(F.col(c)))
    hashed = lambda w: F.transform(w, lambda x: F.xxhash64(x))
    items = benchmark.select("item_id", hashed(split("text")).alias("hw")).withColumn("n", F.size("hw")).where("n > 0").withColumn("k", F.least("n", F.lit(k)))
    sized = sorted(r["k"] for r in items.select("k").distinct().collect()) or [k]  # at most k values
    every = lambda parts: reduce(DataFrame.unionByName, parts)
    items = every([items.where(F.col("k") == j).withColumn("sh", _runs("hw", j)) for j in sized]).drop("hw")
    items = written(items.withColumn("fp", fingerprint("sh")))
    sizes = written(items.select("k", "n", F.explode("sh").alias("h")).distinct())
    known = written(sizes.select("k", "h").distinct())
    held = F.broadcast if sizes.count() <= BROADCAST_ROWS else lambda df: df

    base = docs.select(*key, split(text).alias("w")).withColumn("len", F.size("w"))
    parts = []
    for j in sized:  # the outer explode keeps Spark from splitting the text a second time to test for empty ones
        runs = base.select("id", "text_hash", "len", "w", F.explode_outer(_places("w", j)).alias("p"))
        runs = runs.select("id", "text_hash", "len", "p", F.xxhash64(*[F.xxhash64(F.get("w", F.col("p") + i)) for i in range(j)]).alias("h"))
        parts.append(runs.join(held(known.where(F.col("k") == j).select("h")), "h", "left_semi").where("p is not null").withColumn("k", F.lit(j)))
    hits = every(parts).join(held(sizes), ["k", "h"]).groupBy("id", "text_hash", "len", "k", "n").agg(F.sort_array(F.collect_set("p")).alias("at"))
    spots = written(hits.select(F.col("id").alias("s_id"), F.col("text_hash").alias("s_hash"), "k", "n", starts(least).alias("ranges")).where(F.size("ranges") > 0))

    texts = docs.select(*key, F.col(text).alias("t"))
    here = lambda t, s: t["id"].eqNullSafe(s["s_id"]) & (t["text_hash"] == s["s_hash"])
    some = spots.select("s_id", "s_hash").distinct()
    found = texts.join(some, here(texts, some), "left_semi").dropDuplicates(["id", "text_hash"])
    found = written(found.select("id", "text_hash", hashed(split("t")).alias("hw")))
    cut = found.join(spots, here(found, spots)).select("id", "text_hash", "k", "n", "hw", F.explode("ranges").alias("r"))
    cut = cut.select("id", "text_hash", "k", "n", "hw", F.explode(F.sequence("r.low", "r.high")).alias("start"))
    cut = written(cut.select("id", "text_hash", "k", "n", "start", F.slice("hw", F.col("start") + 1, F.col("n")).alias("hw")))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), cut.count() // WINDOWS)
    cut = cut.repartition(parts, "id", "start")  # windows are small to store and dear to fingerprint, so their bytes must not decide on the number of tasks
    windows = every([cut.where(F.col("k") == j).withColumn("sh", _runs("hw", j)) for j in sized]).drop("hw")
    windows = written(windows.withColumn("fp", fingerprint("sh")))

    near = written(near_pairs(windows.select("n", "fp").distinct(), items.select("n", F.col("fp").alias("i_fp")).distinct(), radius))
    named = items.select("item_id", "n", F.col("fp").alias("i_fp"), F.col("sh").alias("i_sh"))
    pairs = windows.join(near, ["n", "fp"]).join(named, ["n", "i_fp"])
    scored = pairs.withColumn("similarity", similarity(F.col("sh"), F.col("i_sh"))).where(F.col("similarity") >= least)
    best = scored.groupBy("id", "text_hash", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("s"), "n", "distance")).alias("x"))
    return best.select(F.col("id").alias(id_col), "text_hash", "item_id", (-F.col("x.s")).cast("long").alias("start"), F.col("x.n").cast("long").alias("n_words"), F.col("x.distance").cast("long").alias("distance"), F.col("x.similarity").alias("similarity"))
