"""Removal of passages that an earlier document holds, by relative Lempel-Ziv parsing against indexed reference blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .textvec import chunks, mix, word_hashes

WINDOW = 13  #: words of the shortest factor that counts
ANCHOR = 5  #: words of an anchor
SPREAD = WINDOW - ANCHOR + 1  #: anchors of a window, of which it takes the least
BLOCK = 1024  #: words of a reference block
PIECES = 4_000  #: pieces of documents that one task parses against one block
_rng = np.random.default_rng(20240612)
_A, _B = (_rng.integers(1, 1 << 63, WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))


def _grams(words: np.ndarray, k: int, factors: np.ndarray = _A) -> np.ndarray:
    """64-bit hash of each ``k`` neighbouring words, over all texts alike."""
    n = max(len(words) - k + 1, 0)
    out = np.zeros(n, np.uint64)
    for x in range(k):
        out += words[x : x + n] * factors[x]
    return mix(out)


def anchors(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, code) of the anchors of texts: each window of 13 words has the leftmost of its least five-word hashes, so equal windows have equal anchors.

    ``code`` is 256 times the anchor's place in its text, and how far before it the first (times 16) and the last window begin that have it: 8 words at most.
    """
    n = len(words) - WINDOW + 1
    if n < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    g = _grams(words, ANCHOR)
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    s = np.flatnonzero(text[:n] == text[WINDOW - 1 :])
    p = (np.argmin(np.lib.stride_tricks.sliding_window_view(g, SPREAD), 1) + np.arange(n))[s]
    new = np.ones(len(s), bool)
    new[1:] = p[1:] != p[:-1]
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(s)]])[: len(first)] - 1
    p, lo, hi = p[first], s[first], s[last]
    t = text[p]
    return g[p], t, (p - at[t]) * 256 + (p - lo) * 16 + (p - hi)


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors (a, doc, tag, code) of texts (doc, tag, text)."""
    for batch in batches:
        for i, j, data, off in chunks(batch.column(2)):
            a, t, code = anchors(*word_hashes(data, off, folded=False))
            at = pa.array(t + i)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), batch.column(0).take(at), batch.column(1).take(at), pa.array(code)], ["a", "doc", "tag", "code"])


def _bounds(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a text begin and end."""
    data = np.frombuffer(text, np.uint8)
    word = np.ones(len(data) + 2, np.int8)
    word[0] = word[-1] = 0
    word[1:-1] = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.diff(word)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _by_text(batches: Iterator[pa.RecordBatch], last: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows in runs that end with a row of kind ``last``, and the places of these; batches are cut and joined where need be."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        ends = np.flatnonzero(batch.column("kind").to_numpy() == last)
        if not len(ends):
            held.append(batch)
            continue
        upto = int(ends[-1]) + 1
        table = pa.Table.from_batches([*held, batch.slice(0, upto)]).combine_chunks()
        yield table, np.flatnonzero(table.column("kind").to_numpy() == last)
        held = [batch.slice(upto)] if upto < batch.num_rows else []


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reference blocks (kind 0) and pieces to parse against them (kind 1), from each document's wanted blocks, its routed anchors, and its text.

    A piece is what the windows of neighbouring anchors with one route hold.
    """
    for table, ends in _by_text(batches, 2):
        kind, code = table.column("kind").to_numpy(), table.column("code").fill_null(0).to_numpy()
        doc = np.searchsorted(ends, np.arange(len(kind)))
        bounds = {}

        def part(d: int, lo: int, hi: int) -> bytes:
            if d not in bounds:
                bounds.clear()
                text = (table.column("text")[int(ends[d])].as_py() or "").encode()
                bounds[d] = text, *_bounds(text)
            text, begin, end = bounds[d]
            lo, hi = max(lo, 0), min(hi, len(begin))
            return text[begin[lo] : end[hi - 1]]

        rows = np.flatnonzero(kind == 0)
        rows = rows[np.concatenate([[True], (np.diff(doc[rows]) != 0) | (np.diff(code[rows]) != 0)])[: len(rows)]]
        texts = [part(d, b * BLOCK - SPREAD, (b + 1) * BLOCK + WINDOW) for d, b in zip(doc[rows].tolist(), code[rows].tolist())]
        key = pa.array(rows)
        none = pa.nulls(len(rows), table.schema.field("doc").type)
        yield pa.RecordBatch.from_arrays([*(table.column(c).take(key).combine_chunks() for c in ("doc", "tag")), pa.array(code[rows]), pa.array(np.zeros(len(rows), np.int32)), none, pa.nulls(len(rows), pa.int64()), pa.nulls(len(rows), pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())], list(PIECE))

        rows = np.flatnonzero(kind == 1)
        rows = rows[np.concatenate([[True], (np.diff(doc[rows]) != 0) | (np.diff(code[rows]) != 0)])[: len(rows)]]  # equal rows of documents have equal anchors
        if not len(rows):
            continue
        place = code[rows] >> 8
        lo, hi = place - (code[rows] >> 4 & 15), place - (code[rows] & 15)
        routes = [table.column(c).take(pa.array(rows)).combine_chunks().dictionary_encode().indices.to_numpy() for c in ("f", "f_tag", "block")]
        new = np.ones(len(rows), bool)
        new[1:] = (np.diff(doc[rows]) != 0) | (lo[1:] != hi[:-1] + 1)
        for r in routes:
            new[1:] |= np.diff(r) != 0
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:], [len(rows)]]) - 1
        texts = [part(d, a, b + WINDOW) for d, a, b in zip(doc[rows[first]].tolist(), lo[first].tolist(), hi[last].tolist())]
        key = pa.array(rows[first])
        col = {c: table.column(c).take(key).combine_chunks() for c in ("f", "f_tag", "block", "doc", "tag")}
        yield pa.RecordBatch.from_arrays([col["f"], col["f_tag"], col["block"], pa.array(np.ones(len(first), np.int32)), col["doc"], col["tag"], pa.array(lo[first]), pa.array(texts, pa.binary()).cast(pa.string())], list(PIECE))


PIECE = {"f": "{0}", "f_tag": "long", "block": "long", "kind": "int", "doc": "{0}", "tag": "long", "start": "long", "text": "string"}
PARSED = {"kind": "int", "doc": "{0}", "tag": "long", "lo": "long", "hi": "long", "f1": "long", "f2": "long"}


def _schema(columns: dict[str, str], kind: str) -> str:
    return ", ".join(f"{c} {t.format(kind)}" for c, t in columns.items())


class Block:
    """A reference block's words and the sorted hashes of its windows."""

    def __init__(self, words: np.ndarray, windows: np.ndarray):
        self.words, self.order = words, np.argsort(windows, kind="stable")
        self.sorted = windows[self.order]

    def hits(self, windows: np.ndarray) -> np.ndarray:
        """Whether each window is in the block."""
        if not len(self.sorted):
            return np.zeros(len(windows), bool)
        return self.sorted[np.minimum(np.searchsorted(self.sorted, windows), len(self.sorted) - 1)] == windows

    def factors(self, words: np.ndarray, windows: np.ndarray, hits: np.ndarray) -> Iterator[tuple[int, int]]:
        """Greedy factors (first word, after the last) of a piece: the longest match from each place that isn't inside the factor before.

        Where a factor ends, windows that cross its end are looked for as well, as they can match elsewhere in the block.
        """
        starts = np.flatnonzero(hits)
        k = 0
        while k < len(starts):
            s = int(starts[k])
            lo, hi = np.searchsorted(self.sorted, windows[s]), np.searchsorted(self.sorted, windows[s], "right")
            longest = WINDOW
            for place in self.order[lo:hi]:
                n = min(len(words) - s, len(self.words) - int(place))
                differ = np.flatnonzero(words[s : s + n] != self.words[place : place + n])
                longest = max(longest, int(differ[0]) if len(differ) else n)
            yield s, s + longest
            k = int(np.searchsorted(starts, s + longest - WINDOW + 1))


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Factors (kind 0: lo, hi) of pieces and their windows without a factor (kind 1: lo, two hashes); each block comes before its pieces."""
    block = None
    for batch in batches:
        kind, other, start = (batch.column(c).fill_null(0).to_numpy(zero_copy_only=False) for c in ("kind", "other", "start"))
        for i, j, data, off in chunks(batch.column("text")):
            words, at = word_hashes(data, off, folded=False)
            one, two = _grams(words, WINDOW), _grams(words, WINDOW, _B)
            found, missed = [], []
            for k in range(i, j):
                a, b = int(at[k - i]), int(at[k - i + 1])
                windows = one[a : max(b - WINDOW + 1, a)]
                if kind[k] == 0:
                    block = Block(words[a:b].copy(), windows.copy())
                    continue
                hits = block.hits(windows)
                first = int(start[k])
                if other[k]:
                    found += [(k, first + s, first + e) for s, e in block.factors(words[a:b], windows, hits)]
                if not hits.all():
                    places = np.flatnonzero(~hits)
                    missed.append(np.stack([np.full(len(places), k), places + first, places + a]))
            for what, rows in ((0, np.array(found, np.int64).reshape(-1, 3).T), (1, np.concatenate(missed, 1) if missed else np.zeros((3, 0), np.int64))):
                if not rows.shape[1]:
                    continue
                none, own = pa.nulls(rows.shape[1], pa.int64()), pa.array(rows[0])
                more = [pa.array(rows[2]), none, none] if what == 0 else [none, pa.array(one[rows[2]].view(np.int64)), pa.array(two[rows[2]].view(np.int64))]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(rows.shape[1], what, np.int32)), batch.column("doc").take(own), batch.column("tag").take(own), pa.array(rows[1]), *more], list(PARSED))


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, n_words, n_removed, text) of each text, from its spans, which come first; equal rows share them."""
    held, key = [], None
    for table, ends in _by_text(batches, 1):
        lo, hi, doc, tag = (table.column(c) for c in ("lo", "hi", "doc", "tag"))
        lo, hi = lo.fill_null(0).to_numpy(), hi.fill_null(0).to_numpy()
        rows, before = [], 0
        for t in ends.tolist():
            own = doc[t].as_py(), tag[t].as_py()
            if t > before or own != key:
                held, key = list(zip(lo[before:t], hi[before:t])), own
            before = t + 1
            words = (table.column("text")[t].as_py() or "").encode().split()
            n = len(words)
            if held:
                gone = np.zeros(n + 1, np.int64)
                for a, b in held:
                    gone[a] += 1
                    gone[b] -= 1
                words = [w for w, g in zip(words, np.cumsum(gone).tolist()) if not g]
            rows.append((n, n - len(words), b" ".join(words).decode()))
        yield pa.RecordBatch.from_arrays([doc.take(pa.array(ends)).combine_chunks(), *(pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string())))], ["id", "n_words", "n_removed", "text"])


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Texts without the passages of 13 words or more that a document with a smaller id holds: (id, n_words, n_removed, text), text the words that stay, joined by single blanks.

    The reference is made of blocks of documents, and each document is parsed greedily against every block that can hold a factor of it:

    * each window of 13 words has an anchor, its least five-word hash; anchors that several documents hold are routed to the block where the least document has
      them first (a grouped minimum, combined before the shuffle, and a join whose hot keys adaptive execution splits);
    * what lies around neighbouring anchors of one route is a piece, parsed against the block's index: the longest match from a place is a factor, and the windows across
      its end are looked for as well. Blocks are of bounded size; one that very many pieces come to is indexed in several tasks;
    * windows that find no factor there, at borders of factors and where an anchor's first document goes on otherwise, are
      checked against all other such windows by a 128-bit hash: the least document that holds one is found by a grouped minimum. As a window and all its equals fail in the same block, none is lost.

    So each window is compared with a number of places that doesn't depend on the table, and nothing is paired within a group. Windows count as equal by their hashes (64 bits a word).
    Documents of one id don't take from each other; one without id keeps all its words and takes none; repeated rows get the same result each; null and empty texts have no word; other columns are ignored; an empty table gives no rows. One text must fit in a task.
    """
    kind = dict(docs.dtypes)[id_col]
    plain = docs.select(F.col(id_col).alias("doc"), F.col(text).alias("text"))
    several = written(plain.where("doc is not null").groupBy("doc").count().where("count > 1").select(F.col("doc").alias("several")))
    told = F.when(F.col("doc").isNull() | F.col("several").isNotNull(), F.xxhash64("text")).otherwise(F.lit(0))
    keyed = plain.join(several, F.col("doc") == F.col("several"), "left").select("doc", told.cast("long").alias("tag"), "text")
    ids = keyed.where("doc is not null")

    found = written(ids.mapInArrow(_find, f"a long, doc {kind}, tag long, code long"))
    first = found.groupBy("a").agg(F.min("doc").alias("f"), F.max("doc").alias("top"), F.min_by("tag", "doc").alias("f_tag"), F.min_by("code", "doc").alias("f_code"))
    first = written(first.where("f < top").select("a", "f", "f_tag", "f_code"))
    block = F.expr(f"shiftright(f_code, 8) div {BLOCK}").alias("block")
    routed = found.join(first, "a").where("not (doc = f and tag = f_tag and code = f_code)")
    routed = routed.select("doc", "tag", F.lit(1).alias("kind"), "code", "f", "f_tag", block, F.lit(None).cast("string").alias("text"))
    none = [F.lit(None).cast(k).alias(c) for c, k in (("f", kind), ("f_tag", "long"), ("block", "long"))]
    wanted = first.select(F.col("f").alias("doc"), F.col("f_tag").alias("tag"), F.lit(0).alias("kind"), block.alias("code")).distinct()
    wanted = wanted.select("*", *none, F.lit(None).cast("string").alias("text"))
    texts = ids.select("doc", "tag", F.lit(2).alias("kind"), F.lit(None).cast("long").alias("code"), *none, "text")
    rows = routed.unionByName(wanted).unionByName(texts).repartition("doc", "tag").sortWithinPartitions("doc", "tag", "kind", "code")
    pieces = written(rows.mapInArrow(_cut, _schema(PIECE, kind)))

    to = ["f", "f_tag", "block"]
    hot = written(pieces.where("kind = 1").groupBy(*to).count().where(F.col("count") > PIECES).select(*to, F.expr(f"count div {PIECES} + 1").alias("parts")))
    dealt = pieces.join(hot, to, "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long")))
    part = F.when(F.col("kind") == 1, F.array(F.pmod(F.xxhash64("doc", "start"), F.col("parts")))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    dealt = dealt.select(*to, F.explode(part).alias("part"), "kind", "doc", "tag", "start", F.coalesce((F.col("doc") > F.col("f")).cast("int"), F.lit(0)).alias("other"), "text")
    dealt = dealt.repartition(*to, "part").sortWithinPartitions(*to, "part", "kind")
    parsed = written(dealt.mapInArrow(_parse, _schema(PARSED, kind)))

    missed = parsed.where("kind = 1").select("doc", "tag", "lo", "f1", "f2")
    least = missed.groupBy("f1", "f2").agg(F.min("doc").alias("least"), F.max("doc").alias("top")).where("least < top").drop("top")
    crossing = missed.join(least, ["f1", "f2"]).where("doc > least").select("doc", "tag", "lo", (F.col("lo") + WINDOW).alias("hi"))
    spans = parsed.where("kind = 0").select("doc", "tag", "lo", "hi").unionByName(crossing)
    spans = spans.select("doc", "tag", F.lit(0).alias("kind"), "lo", "hi", F.lit(None).cast("string").alias("text"))
    texts = keyed.select("doc", "tag", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("lo"), F.lit(None).cast("long").alias("hi"), "text")
    rows = spans.unionByName(texts).repartition("doc", "tag").sortWithinPartitions("doc", "tag", "kind", "lo")
    done = rows.mapInArrow(_finish, f"id {kind}, n_words long, n_removed long, text string")
    return done.withColumnRenamed("id", id_col)
