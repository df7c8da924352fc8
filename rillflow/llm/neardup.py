"""Near duplicates by bottom-k sketches, inverted lists and exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec
from .common import components, written

K = 32  #: retained values of a sketch
SHARED = 11  #: of K values, so many are shared by similar texts, but for one pair in a million (J = 0.75)
BLOCK_NODES = 1024  #: texts that one task compares with as many others
BLOCK_VALUES = 4_000_000  #: and their shingles in all, where it holds full sets
MAP_BITS = 1 << 26  #: of the map of wanted texts that is broadcast
DENSE = 8  #: candidate pairs a text from which a list is compared as a whole and not pair by pair


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, off in textvec.chunks(batch.column(batch.num_columns - 1)):
            sh, to = textvec.shingles(*textvec.word_hashes(data, off))
            n, a, b, low = [], [], [], []
            for d in range(j - i):
                own = np.unique(sh[to[d] : to[d + 1]])
                n.append(len(own))
                a.append(textvec.mix(own + np.uint64(11)).sum(dtype=np.uint64))
                b.append(textvec.mix(own ^ np.uint64(0xABCDEF)).sum(dtype=np.uint64))
                low.append(own[:K].view(np.int64))
            cols = [c.slice(i, j - i) for c in batch.columns[:-1]]
            sizes = np.cumsum([0, *map(len, low)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(low)))
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n, pa.int64()), pa.array(np.array(a, np.uint64).view(np.int64)), pa.array(np.array(b, np.uint64).view(np.int64)), lists], [*batch.schema.names[:-1], "n", "a", "b", "sketch"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, off in textvec.chunks(batch.column(0)):
            sh, to = textvec.shingles(*textvec.word_hashes(data, off))
            own = [np.unique(sh[to[d] : to[d + 1]]) for d in range(j - i)]
            a = np.array([textvec.mix(x + np.uint64(11)).sum(dtype=np.uint64) for x in own], np.uint64).view(np.int64)
            b = np.array([textvec.mix(x ^ np.uint64(0xABCDEF)).sum(dtype=np.uint64) for x in own], np.uint64).view(np.int64)
            lists = pa.LargeListArray.from_arrays(pa.array(np.cumsum([0, *map(len, own)])), pa.array(np.concatenate(own).view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), lists.cast(pa.list_(pa.int64()))], ["a", "b", "values"])


def _common(values: list[np.ndarray]) -> np.ndarray:
    """Matrix of how many values each two of some sorted arrays share."""
    m = len(values)
    flat, owner = np.concatenate(values), np.repeat(np.arange(m), [len(v) for v in values])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    ids = np.cumsum(new) - 1
    often = np.bincount(ids)[ids] > 1
    ids, owner = np.unique(ids[often], return_inverse=True)[1], owner[often]
    out = np.zeros((m, m), np.float32)
    at = 0
    while at < len(ids):  # columns in runs, for bounded memory
        to = int(np.searchsorted(ids, ids[at] + 1024))
        part = np.zeros((m, min(1024, int(ids[to - 1] - ids[at]) + 1)), np.float32)
        part[owner[at:to], ids[at:to] - ids[at]] = 1
        out += part @ part.T
        at = to
    return out


def _estimates(values: list[np.ndarray], n: np.ndarray, percent: int) -> np.ndarray:
    """Estimated similarity of each two texts that may be similar, else 0. Up to the lesser of two sketches' largest values, both hold all values of their sets: the union there is a sketch of the union."""
    c = _common(values)
    whole = n <= K
    last = np.array([np.inf if w else float(v[-1]) for v, w in zip(values, whole)])
    upto = np.array([np.searchsorted(v.astype(np.float64), last, "right") for v in values], np.float32)
    union = upto + upto.T - c
    exact = whole[:, None] & whole[None, :]
    least = np.where(exact, percent / 100, percent / 100 / 2)
    may = (c > 0) & (c >= least * union - 1e-3) & (100 * np.minimum(n[:, None], n[None, :]) >= percent * np.maximum(n[:, None], n[None, :]))
    return np.where(may, c / np.maximum(union, 1), 0)


def _forest(links: np.ndarray) -> np.ndarray:
    """For each row the least row that it reaches."""
    label = np.arange(len(links))
    while True:
        low = np.where(links, label[None, :], len(links)).min(1)
        new = np.minimum(label, low)
        np.minimum.at(new, label, new)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _closest(rows: list, key: tuple, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text the one before it that seems closest, and the estimate; of equally close ones the last."""
    before = np.triu(_estimates([r[4] for r in rows], np.array([r[1] for r in rows], np.float32), percent), 1)
    v = np.flatnonzero(before.max(0) > 0)
    u = (len(before) - 1 - before[::-1].argmax(0))[v]
    return u, v, before[u, v]


def _across(rows: list, key: tuple, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of different components that may be similar, with 0; if they are more than DENSE a text, a forest over them instead, with -1. Pairs inside a block are looked at only where the block meets itself."""
    estimates = _estimates([r[4] for r in rows], np.array([r[1] for r in rows], np.float32), percent)
    label, own = (np.array([r[c] for r in rows], np.int64) for c in (2, 3))
    wanted = (estimates > 0) & (label[:, None] != label[None, :])
    if key[1] != key[2]:
        wanted &= own[:, None] != own[None, :]
    if np.count_nonzero(wanted) > 2 * DENSE * np.count_nonzero(wanted.any(1)):
        u = _forest(wanted)
        v = np.flatnonzero(u != np.arange(len(u)))
        return u[v], v, np.full(len(v), -1.0)
    u, v = np.nonzero(np.triu(wanted, 1))
    return u, v, np.zeros(len(u))


def _joined(rows: list, key: tuple, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A forest over the pairs that are similar on full sets."""
    n = np.array([r[1] for r in rows], np.float32)
    c = _common([r[4] for r in rows])
    u = _forest((c > 0) & (100 * c >= percent * (n[:, None] + n[None, :] - c)))
    v = np.flatnonzero(u != np.arange(len(u)))
    return u[v], v, np.ones(len(v))


def _pairer(picked, percent: int):
    """A function over rows (value, i, j, node, n, label, own, values), sorted by the first three: the pairs (u, v, score) that ``picked`` takes from each key's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, {}

        def closed() -> Iterator[pa.RecordBatch]:
            if len(rows) > 1:
                sorted_rows = [rows[x] for x in sorted(rows)]
                nodes = np.array(sorted(rows), np.int64)
                u, v, score = picked(sorted_rows, key, percent)
                yield pa.RecordBatch.from_arrays([pa.array(nodes[u]), pa.array(nodes[v]), pa.array(score.astype(np.float64))], ["u", "v", "score"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in range(7)]
            lists = batch.column(7)
            off, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            for r, k in enumerate(zip(*columns[:3])):
                if k != key:
                    yield from closed()
                    key, rows = k, {}
                rows[columns[3][r]] = (*(c[r] for c in columns[3:]), flat[off[r] : off[r + 1]].copy())
        yield from closed()

    return run


def _pairs(rows: DataFrame, picked, percent: int) -> DataFrame:
    """rows (value, i, j, node, n, label, own, values): pairs (u, v, score) inside each (value, i, j), u before v."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("value", "i", "j", "node", "n", "label", "own", "values").repartition(parts, "value", "i", "j").sortWithinPartitions("value", "i", "j")
    return dealt.mapInArrow(_pairer(picked, percent), "u long, v long, score double")


def _facing(lists: DataFrame, labels: DataFrame, block: int) -> DataFrame:
    """The rows of those lists (value, node) that hold texts of several components, dealt out for comparison across components: value, i, j, node, label, own.

    In each list, texts of its largest component are cut into blocks of their own (numbers below 0), all others into blocks from 0 on. Every block of others meets every block; blocks of the largest
    component don't meet each other. So a list of which most is one component, however long, gives about as many rows as it has.
    """
    named = lists.join(labels, "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root")
    held = written(named.groupBy("value", "label").agg(F.count(F.lit(1)).alias("n")))
    most = held.groupBy("value").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
    most = written(most.select("value", F.col("top.label").alias("top"), F.ceil(F.col("top.n") / block).cast("int").alias("tops"), F.ceil((F.col("n") - F.col("top.n")) / block).cast("int").alias("others")))
    rows = named.join(most, "value").withColumn("large", F.col("label") == F.col("top"))
    spread = lambda n: F.pmod(F.xxhash64("value", "node"), n).cast("int")
    rows = rows.withColumn("own", F.when(F.col("large"), -1 - spread(F.col("tops"))).otherwise(spread(F.col("others"))))
    others, tops = F.sequence(F.lit(0), F.col("others") - 1), F.sequence(F.lit(-1), -F.col("tops"))
    meet = lambda i, j: F.struct(i.alias("i"), j.alias("j"))
    pairs = F.when(F.col("large"), F.transform(others, lambda o: meet(o, F.col("own")))).otherwise(F.concat(F.transform(others, lambda o: meet(F.least(o, F.col("own")), F.greatest(o, F.col("own")))), F.transform(tops, lambda t: meet(F.col("own"), t))))
    return rows.withColumn("p", F.explode(pairs)).select("value", "p.i", "p.j", "node", "label", "own")


def _having(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of ``texts`` whose ``place`` (a 64-bit hash) is in ``wanted``, and a few more: the wanted places are bits of a map of at most MAP_BITS (8 MB), which is broadcast, so that texts aren't shuffled. Beyond what that holds, an exact join by a shuffle."""
    n = wanted.count()
    if 8 * n > MAP_BITS:
        return texts.join(wanted.select("place"), "place", "left_semi")
    bits = F.pmod("place", F.lit(1 << max(15, min(MAP_BITS.bit_length() - 1, (16 * n).bit_length()))))
    held = wanted.select(bits.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("map"))
    found = texts.withColumn("bit", bits).withColumn("bucket", F.bitmap_bucket_number("bit")).join(F.broadcast(held), "bucket")
    position = F.bitmap_bit_position("bit")
    byte = F.conv(F.hex(F.substring("map", F.floor(position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return found.where(F.call_function("shiftright", byte, (position % 8).cast("int")).bitwiseAND(F.lit(1)) == 1)


def _sets_of(nodes: DataFrame, classes: DataFrame, rows_of: DataFrame) -> DataFrame:
    """The full shingle set of each of ``nodes`` (node): node, values. Their texts are hashed once more."""
    wanted = written(classes.join(nodes.distinct(), "node").select("node", "a", "b", F.col("first.place").alias("place")))
    sets = _having(rows_of, wanted).select("text").mapInArrow(_sets, "a long, b long, values array<long>").groupBy("a", "b").agg(F.first("values").alias("values"))
    return written(wanted.join(sets, ["a", "b"]).select("node", "values"))


def _verified(pairs: DataFrame, classes: DataFrame, rows_of: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (u, v) that are similar on their full sets."""
    sets = _sets_of(pairs.select(F.explode(F.array("u", "v")).alias("node")), classes, rows_of)
    side = lambda name: sets.select(F.col("node").alias(name), F.col("values").alias(f"{name}_set"))
    both = pairs.select("u", "v").join(side("u"), "u").join(side("v"), "v")
    common = F.size(F.array_intersect("u_set", "v_set")).cast("long")
    return written(both.where(100 * common >= percent * (F.size("u_set") + F.size("v_set") - common)).select("u", "v"))


def _verified_whole(edges: DataFrame, classes: DataFrame, rows_of: DataFrame, percent: int) -> DataFrame:
    """Links inside the groups that ``edges`` (u, v) connect, each group compared as a whole on full sets: in pairs of blocks, of which each text's set goes to every one of its own."""
    members = written(components(edges).join(classes, "node").select(F.col("root").alias("value"), "node", "n"))
    total = members.groupBy("value").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("held"))
    total = written(total.select("value", F.ceil(F.greatest(F.col("size") / BLOCK_NODES, F.col("held") / BLOCK_VALUES)).cast("int").alias("blocks")))
    rows = members.join(total, "value").withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    meet = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("own")).alias("i"), F.greatest(o, F.col("own")).alias("j")))
    rows = rows.withColumn("p", F.explode(meet)).select("value", "p.i", "p.j", "node", "n", F.col("node").alias("label"), "own")
    sets = _sets_of(members.select("node"), classes, rows_of)
    return written(_pairs(rows.join(sets, "node"), _joined, percent).select("u", "v").distinct())


def near_duplicates(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Groups of near duplicates: id, text_hash, n_shingles, component_id, kept (id = component_id), stays (one row of each group), and the columns ``carry``.

    Two documents are linked when percent * |union| <= 100 * |intersection| of their sets of five-word shingles (A-Z folded; a text of
    fewer words is one shingle). component_id is the least id reachable over links. A document without words is linked with nothing and stays.
    Null ids are rows like others, above all ids; equal ids don't link rows. Other columns are ignored; an empty table gives no rows.

    1. Each text gets the 32 least of its shingle hashes as sketch; equal sets are one node from here on.
    2. Inverted lists of retained values. Similar sketches share 11 of 32 values, so one of a node's 22 rarest is
       enough to meet: values that many texts share head a list only for texts made of little else.
    3. In each list (in blocks of it, where it is long), each text is paired with the one before it that the estimate over the union of both sketches has as closest. Of all
       lists, the closest one counts: one pair a text. Those pairs are verified on full sets, which already joins nearly all texts that belong together.
    4. What remains are pairs between components: lists with texts of several components are compared across them. All pairs that pass the estimate are verified on full sets one by one,
       but for lists in which they are many (more than DENSE a text): the groups that those connect are compared as a whole, each set sent once to each pair of blocks of its group.

    A pair with J >= 0.75 is missed by the estimate with probability 1e-5 or less; no list, group or partner is capped. Work is linear in the texts of a group of
    close texts, and in the pairs that overlap where these are few. Only texts that are all near by estimate (0.375 or more) and yet not joined cost a comparison a pair, as nothing else can tell them apart; tasks return
    forests of these, but each text's set is sent once for each BLOCK_NODES texts of such a group, so that what is shuffled grows with the square of a group over that number.
    """
    carried = [f"carried_{c}" for c in carry]
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), *[F.col(c).alias(o) for c, o in zip(carry, carried)], F.col(text).alias("text"))
    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes[:-1])
    rows = written(rows.mapInArrow(_sketched, f"{kinds}, n long, a long, b long, sketch array<long>").withColumn("rid", F.monotonically_increasing_id()))
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "rid", F.xxhash64("id", "text_hash").alias("place"))
    classes = written(rows.where("n > 0").groupBy("a", "b").agg(F.min("rid").alias("node"), F.min(rank).alias("first"), F.max("n").alias("n")))
    nodes = written(rows.join(classes.select(F.col("node").alias("rid")), "rid", "left_semi").select(F.col("rid").alias("node"), "n", F.col("sketch").alias("values")))

    held = nodes.select("node", F.size("values").alias("k"), F.explode("values").alias("value"))
    often = written(held.groupBy("value").agg(F.count(F.lit(1)).alias("often")).where("often > 1"))
    each = held.join(often, "value").groupBy("node").agg(F.max("k").alias("k"), F.sort_array(F.collect_list(F.struct("often", "value"))).alias("vs"))
    reach = F.col("k") - F.ceil(F.col("k") * SHARED / K) + 1 - (F.col("k") - F.size("vs"))
    lists = written(each.where(reach > 0).select("node", F.explode(F.slice("vs", F.lit(1), reach.cast("int"))).alias("x")).select("node", F.col("x.value").alias("value")))
    sizes = lists.groupBy("value").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    sizes = written(sizes.select("value", F.ceil(F.col("size") / BLOCK_NODES).alias("blocks")))
    block = F.pmod(F.xxhash64("value", "node"), F.col("blocks")).cast("int")
    dealt = lists.join(sizes, "value").select("value", block.alias("i"), block.alias("j"), "node", F.col("node").alias("label"), block.alias("own"))
    closest = _pairs(dealt.join(nodes, "node"), _closest, percent).groupBy("v").agg(F.max(F.struct("score", "u")).alias("x"))
    closest = written(closest.select("x.u", "v"))
    rows_of = docs.select(F.xxhash64(F.col(id_col), F.xxhash64(text)).alias("place"), F.col(text).alias("text"))
    links = _verified(closest, classes, rows_of, percent)
    across = _facing(lists, written(components(links)), BLOCK_NODES).join(nodes, "node")
    across = written(_pairs(across, _across, percent).distinct())
    single, whole = across.where("score = 0").select("u", "v").join(closest, ["u", "v"], "left_anti"), across.where("score < 0").select("u", "v")
    for pairs, verify in ((single, _verified), (whole, _verified_whole)):
        if not pairs.isEmpty():
            links = links.unionByName(verify(pairs, classes, rows_of, percent))

    found = components(links)
    of = classes.join(found, "node", "left").select("a", "b", F.coalesce("root", "node").alias("root"), "first")
    of = written(of)
    least = written(of.groupBy("root").agg(F.min("first").alias("least")))
    of = written(of.join(least, "root").select("a", "b", F.col("least.id").alias("component_id"), F.col("least.rid").alias("stay")))
    out = rows.drop("sketch").join(of, ["a", "b"], "left")
    alone = F.col("n") == 0
    component = F.when(alone, F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), "text_hash", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"), (alone | (F.col("rid") == F.col("stay"))).alias("stays"), *[F.col(o).alias(c) for c, o in zip(carry, carried)])
