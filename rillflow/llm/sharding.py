"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix, with SQL functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import unused, written


def _draw(total: str, good: str, n: str, u: str) -> str:
    """SQL for a hypergeometric draw: of ``total`` rows ``good`` are wanted, ``n`` are taken; u uniform in [0, 1).

    Inverse distribution function over 12 standard deviations to each side, by the ratio of neighbouring probabilities.
    """
    sd = f"sqrt(greatest(1D, double({n}) * {good} / {total} * (1 - double({good}) / {total})))"
    lo = f"greatest(0L, {n} - ({total} - {good}), bigint(double({n}) * {good} / {total} - 12 * {sd} - 10))"
    hi = f"least({good}, {n}, bigint(double({n}) * {good} / {total} + 12 * {sd} + 10))"
    step = f"a.w * double({good} - k) * double({n} - k) / (double(k + 1) * double({total} - {good} - {n} + k + 1))"
    mass = f"aggregate(sequence({lo}, {hi}), struct(1D as w, 0D as s), (a, k) -> struct({step} as w, a.s + a.w as s)).s"
    found = f"aggregate(sequence({lo}, {hi}), struct(1D as w, {u} * {mass} as s, bigint({lo}) as k), (a, k) -> if(a.s < 0, a, struct({step} as w, a.s - a.w as s, k as k))).k"
    return f"case when {total} <= 0 or {good} <= 0 or {n} <= 0 then 0L when {good} >= {total} then {n} when {n} >= {total} then {good} else {found} end"


def communication_matrix(counts: DataFrame, sizes: list[int], levels: int, seed: int) -> DataFrame:
    """Exact numbers of rows that each block sends to each shard: (block, sent array<bigint>).

    counts: block (0 to 2**levels - 1; those without rows may be absent), n. The rows of a block are a uniform sample without replacement of all places, so
    the matrix is drawn as one: a binary tree halves the set of blocks, and at each node the places of the left half are
    drawn from the node's places, shard after shard (a multivariate hypergeometric law). Row sums are ``n``, column sums are ``sizes``.
    """
    spark = counts.sparkSession
    all_blocks = spark.range(1 << levels).select(F.col("id").alias("block")).join(counts, "block", "left").na.fill(0, ["n"])
    node = all_blocks.agg(F.transform(F.sort_array(F.collect_list(F.struct("block", "n"))), lambda x: x["n"]).alias("ns")).select(F.lit(0).cast("long").alias("block"), "ns", F.array(*[F.lit(s).cast("long") for s in sizes]).alias("places"))
    uniform = f"(shiftrightunsigned(xxhash64({seed}, level, block, r.i), 11) / 9007199254740992D)"
    draw = _draw("r.total", "p", "r.n", uniform)
    for level in range(levels):
        half = 1 << (levels - level - 1)
        node = node.select("block", "places", F.slice("ns", 1, half).alias("a"), F.slice("ns", half + 1, half).alias("b"), F.lit(level).alias("level"))
        node = node.withColumn("n", F.expr("aggregate(a, 0L, (s, x) -> s + x)")).withColumn("total", F.expr("aggregate(places, 0L, (s, x) -> s + x)"))
        left = f"""aggregate(places, named_struct('total', total, 'n', n, 'i', 0, 'x', 0L, 'out', cast(array() as array<bigint>)),
            (q, p) -> transform(array(struct(q.total as total, q.n as n, q.i as i, q.out as out)), r -> transform(array({draw}), x ->
                named_struct('total', r.total - p, 'n', r.n - x, 'i', r.i + 1, 'x', x, 'out', concat(r.out, array(x))))[0])[0]).out"""
        node = node.withColumn("left", F.expr(left))
        node = node.select(F.explode(F.array(F.struct((F.col("block") * 2).alias("block"), F.col("a").alias("ns"), F.col("left").alias("places")), F.struct((F.col("block") * 2 + 1).alias("block"), F.col("b").alias("ns"), F.zip_with("places", "left", lambda p, x: p - x).alias("places")))).alias("c")).select("c.*")
        if level % 4 == 3:
            node = written(node)
    return node.select("block", F.col("places").alias("sent"))


def shuffle_to_shards(docs: DataFrame, n_shards: int = 16, seed: int = 7, rows_per_range: int = 4096) -> DataFrame:
    """All rows of ``docs`` with shard (0 to n_shards - 1) and slot (0, 1, ... in each shard): a uniform shuffle whose shard sizes differ by one at most.

    1. Each partition is put in random order where it is and written to the shared folder, with a number for each row: the partition and the row's place in it.
    2. The rows of each partition are counted; ``communication_matrix`` draws how many of them go to each shard. As a partition is in random order, its first rows
       go to shard 0, the next to shard 1, and so on.
    3. One exchange of the rows by shard and range, then random order again. A range holds about ``rows_per_range`` rows of a shard, picked by a hash of the row's
       number; where each range begins comes from a narrow job, so that no task ever holds a whole shard.

    Nothing depends on what the rows hold: repeated keys, nulls and copies scatter like any other rows. Draws are made once, for the written table, so tasks that run again, or
    on fewer executors, give the same shards and slots; another run gives the same ones for the same ``seed`` and input partitions.
    Null keys and texts and very long texts are ordinary; an empty table gives no rows; columns named shard or slot are replaced, all others are kept as they are.
    The counts of all partitions, two numbers each, pass one task: some MB at 100 TB.
    """
    kept = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    number, order, block, rank, sent, part, begin = unused([*kept, "shard", "slot"], "number", "order", "block", "rank", "sent", "part", "begin")
    mixed = docs.select(*[F.col(f"`{c}`") for c in kept]).withColumn(order, F.rand(seed)).sortWithinPartitions(order).drop(order)
    held = written(mixed.withColumn(number, F.monotonically_increasing_id()))
    counts = written(held.groupBy(F.shiftright(number, 33).alias("held")).agg(F.count(F.lit(1)).alias("n")))
    counts = written(counts.select("held", "n", (F.row_number().over(Window.orderBy("held")) - 1).cast("long").alias("block")))
    n, partitions = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    sizes = [n // n_shards + (s < n % n_shards) for s in range(n_shards)]
    drawn = communication_matrix(counts.select("block", "n"), sizes, max(1, (max(1, partitions) - 1).bit_length()), seed)
    matrix = written(drawn.join(counts, "block").select(F.col("held").alias(block), F.col("sent").alias(sent)))
    ranges = max(1, -(-n // (n_shards * rows_per_range)))

    def placed(rows: DataFrame) -> DataFrame:
        rows = rows.withColumns({block: F.shiftright(number, 33), rank: F.col(number).bitwiseAND(F.lit((1 << 33) - 1)), order: F.xxhash64(F.lit(seed), number)}).join(matrix, block)
        reached = F.expr(f"aggregate(`{sent}`, named_struct('left', `{rank}`, 's', 0), (a, x) -> if(a.left < 0, a, if(a.left < x, named_struct('left', -1L, 's', a.s), named_struct('left', a.left - x, 's', a.s + 1)))).s")
        return rows.withColumns({"shard": reached.cast("int"), part: F.pmod(F.col(order), F.lit(ranges)).cast("int")}).drop(block, rank, sent)

    before = Window.partitionBy("shard").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = written(placed(held.select(number)).groupBy("shard", part).agg(F.count(F.lit(1)).alias("n")))
    starts = written(starts.select("shard", part, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(begin)))
    again = Window.partitionBy("shard", part).orderBy(order, number)
    rows = placed(held).withColumn("slot", F.row_number().over(again) - 1).join(starts, ["shard", part])
    return rows.select(*[F.col(f"`{c}`") for c in kept], "shard", (F.col("slot") + F.col(begin)).cast("long").alias("slot"))
