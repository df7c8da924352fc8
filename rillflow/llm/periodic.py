"""Periodic runs of words: suffix trees of a text and its reversal, longest common extensions by lowest common ancestors, Lyndon roots as candidates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textvec import chunks, shingles, word_hashes

LEAST_LENGTH = 24  #: words of a run
LEAST_POWER = 3  #: periods of a run
GRAM = 5  #: words whose recurrence shows where a run can be


class Extensions:
    """Longest common prefixes of suffixes of a sequence of numbers from 1 on, in constant time each, after Ukkonen's construction of its suffix tree.

    A depth-first tour lists the leaves; of the tour only the least depth between neighbouring leaves matters, as a range minimum over these is the depth of the lowest common ancestor.
    """

    def __init__(self, words: list[int]):
        self.n = len(words)
        self.s = [*words, 0]  # the end is less than any word
        self._build()
        order, low = self._tour(1)
        self.rank = np.empty(self.n + 1, np.int64)
        self.rank[order] = np.arange(self.n + 1)
        table = [np.array(low, np.int32)]
        while 2 << (len(table) - 1) <= self.n + 1:
            half = 1 << (len(table) - 1)
            table.append(np.minimum(table[-1][:-half], table[-1][half:]))
        self._table = table

    def _build(self) -> None:
        s, n, sigma = self.s, self.n + 1, max(self.s) + 1
        start, stop, link, child = [0], [0], [0], {}
        node = edge = length = rest = 0
        for i, c in enumerate(s):
            rest += 1
            unlinked = 0
            while rest:
                if not length:
                    edge = i
                key = node * sigma + s[edge]
                v = child.get(key)
                if v is None:
                    child[key] = len(start)
                    start.append(i)
                    stop.append(n)
                    link.append(0)
                    if unlinked:
                        link[unlinked] = node
                    unlinked = node
                else:
                    b = start[v]
                    size = min(stop[v], i + 1) - b
                    if length >= size:
                        edge += size
                        length -= size
                        node = v
                        continue
                    if s[b + length] == c:
                        length += 1
                        if unlinked:
                            link[unlinked] = node
                        break
                    mid = child[key] = len(start)
                    start += (b, i)
                    stop += (b + length, n)
                    link += (0, 0)
                    child[mid * sigma + c] = mid + 1
                    start[v] = b + length
                    child[mid * sigma + s[b + length]] = v
                    if unlinked:
                        link[unlinked] = mid
                    unlinked = mid
                rest -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - rest + 1
        keys = np.fromiter(child.keys(), np.int64, len(child))
        to = np.fromiter(child.values(), np.int64, len(child))
        self._edges = keys // sigma, keys % sigma, to
        self._long = np.array(stop) - np.array(start)

    def _tour(self, sign: int) -> tuple[list[int], list[int]]:
        """Suffixes in the order of the tour that takes children by their first word, times ``sign``, the end first; and the least depth since the leaf before."""
        parent, word, to = self._edges
        by = np.lexsort((word * sign, word > 0, parent))
        to, parent = to[by], parent[by]
        at = np.searchsorted(parent, np.arange(len(self._long) + 1)).tolist()
        kids, long = to.tolist(), self._long.tolist()
        depth, above, n = [0] * len(long), [-1] * len(long), self.n + 1
        order, low, least, stack = [], [], 0, [0]
        while stack:
            v = stack.pop()
            if above[v] >= 0:  # not the first child: what comes next meets what was before in the parent
                least = above[v]
            a, b = at[v], at[v + 1]
            if a == b:
                order.append(n - depth[v])
                low.append(least)
                continue
            d = depth[v]
            for c in kids[a:b]:
                depth[c] = d + long[c]
            for c in kids[a + 1 : b]:
                above[c] = d
            stack += kids[a:b][::-1]
        return order, low

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of suffixes i and j, which differ."""
        a, b = self.rank[i], self.rank[j]
        lo, hi = np.minimum(a, b) + 1, np.maximum(a, b) + 1
        k = np.frexp((hi - lo).astype(np.float64))[1] - 1
        out = np.empty(len(lo), np.int64)
        for level in np.unique(k):
            own = k == level
            t = self._table[level]
            out[own] = np.minimum(t[lo[own]], t[hi[own] - (1 << int(level))])
        return out

    def roots(self) -> tuple[np.ndarray, np.ndarray]:
        """(i, j) of the longest Lyndon word from each i, by the order of words and by its reverse: it ends where the next smaller suffix begins."""
        found = []
        order, _ = self._tour(-1)
        reverse = np.empty(self.n + 1, np.int64)
        reverse[order] = np.arange(self.n + 1)
        for ranks in (self.rank.tolist(), reverse.tolist()):
            ends, open_ = [self.n] * self.n, []
            for i in range(self.n - 1, -1, -1):
                r = ranks[i]
                while open_ and ranks[open_[-1]] > r:
                    open_.pop()
                if open_:
                    ends[i] = open_[-1]
                open_.append(i)
            found.append(np.array(ends, np.int64))
        i = np.tile(np.arange(self.n), 2)
        j = np.concatenate(found)
        inside = j < self.n
        return i[inside], j[inside]


def runs(words: list[int], least: int = LEAST_LENGTH, power: int = LEAST_POWER) -> list[tuple[int, int, int]]:
    """(start, length, period) of all maximal runs of at least ``least`` words and ``power`` periods (3 or more), by start and period.

    Each such run holds a Lyndon word of its period, by one of two opposite orders, that is the longest from its place;
    it is extended to both sides as far as words one period apart are equal.
    """
    n = len(words)
    if n < least:
        return []
    ahead = Extensions(words)
    i, j = ahead.roots()
    right = ahead.common(i, j)
    del ahead
    back = Extensions(words[::-1])
    left = np.zeros(len(i), np.int64)
    some = i > 0
    left[some] = back.common(n - i[some], n - j[some])
    start, period = i - left, j - i
    length = left + period + right
    good = (length >= least) & (length >= power * period)
    found = np.unique(np.stack([start[good], length[good], period[good]], 1), axis=0)
    return [tuple(map(int, r)) for r in found[np.lexsort((found[:, 2], found[:, 0]))]]


def _places(grams: np.ndarray, text: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of ``grams`` (numbered over several texts, ``text`` says which) that each occur again later in their text, first and last, where long enough for a run."""
    order = np.lexsort((grams, text))  # stable, so places ascend
    again = np.zeros(len(grams), bool)
    same = (grams[order][1:] == grams[order][:-1]) & (text[order][1:] == text[order][:-1])
    again[order[:-1][same]] = True
    edge = np.diff(np.concatenate([[0], again.view(np.int8), [0]]))
    split = np.flatnonzero(again[1:] & again[:-1] & (text[1:] != text[:-1])) + 1
    first, last = np.sort(np.concatenate([np.flatnonzero(edge == 1), split])), np.sort(np.concatenate([np.flatnonzero(edge == -1), split])) - 1
    long = last - first + 1 >= least
    return first[long], last[long]


def _regions(words: np.ndarray, at: np.ndarray) -> dict[int, list[tuple[int, int]]]:
    """Ranges of words, by text, outside of which no run can be.

    In a run of length L and period q, each of the first L - q - 4 five-word sequences occurs again q words later. As L is at least 24 and 3 q, these are 12 and (2 q - 4) at least, so a
    run lies in a stretch of m such sequences and the (m + 4) / 2 + 4 words after it.
    """
    grams, to = shingles(words, at, GRAM)
    text = np.repeat(np.arange(len(at) - 1), np.diff(to))
    first, last = _places(grams, text, LEAST_LENGTH - LEAST_LENGTH // LEAST_POWER - GRAM + 1)
    out: dict[int, list[tuple[int, int]]] = {}
    for f, e in zip(first.tolist(), last.tolist()):
        t = int(text[f])
        lo, m = f - int(to[t]), e - f + 1
        hi = min(int(at[t + 1] - at[t]), lo + m + (m + GRAM - 1) // 2 + GRAM)
        own = out.setdefault(t, [])
        if own and lo <= own[-1][1]:
            own[-1] = (own[-1][0], max(hi, own[-1][1]))
        else:
            own.append((lo, hi))
    return out


def _of_text(words: list[bytes], regions: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Runs of a text that lie in its regions; one that goes on beyond a region's border isn't a whole run and is left out (the region that holds it whole has it)."""
    found = []
    for lo, hi in regions:
        numbers: dict[bytes, int] = {}
        own = [numbers.setdefault(w, len(numbers) + 1) for w in words[lo:hi]]
        for start, length, q in runs(own):
            b, e = lo + start, lo + start + length
            if (b == 0 or words[b - 1] != words[b - 1 + q]) and (e == len(words) or words[e] != words[e - q]):
                found.append((b, length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def find_runs(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Periodic runs of the words of each text: (id, n_words, runs, text), ``runs`` an array of (start, length, period) by start and period, ``text`` the words that stay, joined by single blanks.

    A run is a stretch of at least 24 words and three of its smallest periods that can't be made longer. A word is dropped where a run holds it after that run's first period. Texts are
    taken whole, each inside a task: all are searched for repeated five-word sequences with array passes, and trees are built only over places where a run can be (see ``_regions``), so
    memory grows with the longest such place. No shuffle. Null and empty texts have no word and no run; null ids and
    repeated rows are rows like others; other columns are ignored; an empty table gives no rows.
    """
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for i, j, data, off in chunks(texts):
                regions = _regions(*word_hashes(data, off, folded=False))
                counts, all_runs, kept = [], [], []
                for k in range(j - i):
                    words = data[off[k] : off[k + 1]].tobytes().split()
                    own = _of_text(words, regions[k]) if k in regions else []
                    counts.append(len(words))
                    all_runs.append([dict(zip(("start", "length", "period"), r)) for r in own])
                    if own:
                        gone = np.zeros(len(words) + 1, np.int64)
                        for b, length, q in own:
                            gone[b + q] += 1
                            gone[b + length] -= 1
                        words = [w for w, g in zip(words, np.cumsum(gone).tolist()) if not g]
                    kept.append(b" ".join(words).decode())
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(counts, pa.int64()), pa.array(all_runs, pa.list_(of)), pa.array(kept, pa.string())], ["id", "n_words", "runs", "text"])

    found = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, text string")
    return found.withColumnRenamed("id", id_col)
