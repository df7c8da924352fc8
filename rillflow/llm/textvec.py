"""Words and shingles of whole texts as arrays, for use inside tasks: a batch of texts is hashed with a few passes over its bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text hashed at once; a longer text is taken alone.
CHUNK_BYTES = 1 << 21
_rng = np.random.default_rng(20240229)
_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLDED = _CODE.copy()
_FOLDED[65:91] = _CODE[97:123]
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_MARK = np.zeros(256, bool)  # ASCII punctuation
_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_BASE = 0x9E3779B97F4A7C15
_PLACE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_UP, _DOWN = _powers(_BASE, 1 << 16), _powers(pow(_BASE, -1, 1 << 64), 1 << 16)


def _grown(n: int) -> None:
    global _UP, _DOWN
    if len(_UP) < n:
        _UP, _DOWN = _powers(_BASE, 2 * n), _powers(pow(_BASE, -1, 1 << 64), 2 * n)


def chunks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, offsets) of runs of texts of about ``CHUNK_BYTES``; a null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8) if len(texts) else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(off, off[i] + CHUNK_BYTES, "right")) - 1)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def _bare(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words from ``s`` to ``e`` without ASCII marks and U+2000 to U+203F (dashes, quotes) at their ends; those with nothing else are left out."""
    inner = ~(_MARK | _BLANK)[data]
    at = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x80))
    for j in range(3):
        inner[at + j] = False
    place = np.flatnonzero(inner)
    upto = np.concatenate([[0], np.cumsum(inner)])
    lo, hi = upto[s], upto[e]
    some = hi > lo
    return place[lo[some]], place[hi[some] - 1] + 1


def word_hashes(data: np.ndarray, off: np.ndarray, folded: bool = True, bare: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word (``bare``: without punctuation at its ends), and where each text's words begin (one more entry than texts)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    _grown(n + 1)
    word = ~_BLANK[data]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    begin = word.copy()
    begin[1:] &= ~word[:-1] | edge[1:n]
    end = word.copy()
    end[:-1] &= ~word[1:] | edge[1:n]
    s, e = np.flatnonzero(begin), np.flatnonzero(end) + 1
    if bare:
        s, e = _bare(data, s, e)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((_FOLDED if folded else _CODE)[data] * _UP[:n], dtype=np.uint64, out=total[1:])
    return mix((total[e] - total[s]) * _DOWN[s] + (e - s).astype(np.uint64)), np.searchsorted(s, off)


def shingles(words: np.ndarray, at: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """63-bit hash of each run of ``k`` words inside a text (the whole text where it has 1 to k - 1 words), and where each text's runs begin."""
    counts = np.diff(at)
    runs = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    to = np.concatenate([[0], np.cumsum(runs)]).astype(np.int64)
    doc = np.repeat(np.arange(len(runs)), runs)
    first = at[:-1][doc] + np.arange(len(doc)) - to[:-1][doc]
    size = np.minimum(counts, k)[doc]
    h = np.zeros(len(doc), np.uint64)
    padded = np.concatenate([words, np.zeros(k, np.uint64)])
    for j in range(k):
        h += np.where(j < size, padded[first + j] * _PLACE[j], np.uint64(0))
    return mix(h + size.astype(np.uint64)) >> np.uint64(1), to
