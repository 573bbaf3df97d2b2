"""Byte-level words of whole Arrow text columns, hashed in numpy without a Python string per word.

A word is a maximal run of bytes outside a separator set; its hash is a polynomial over a table of random
values (A-Z folded on demand), taken from running sums of the whole buffer, so the cost is a few vector operations
a byte whatever the word lengths. Buffers are cut into pieces at separators to bound memory with very long texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes hashed at a time, and bytes of text that are held as word arrays at a time.
PIECE, GROUP = 1 << 20, 2 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

WHITE = np.zeros(256, bool)
WHITE[[32, 9, 10, 11, 12, 13]] = True
#: Everything in ASCII that is neither a letter nor a digit.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; a bijection."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
FOLDED = VALUE.copy()
FOLDED[65:91] = VALUE[97:123]
_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        m = max(n, PIECE + 4096)
        _powers[:] = [np.concatenate([[np.uint64(1)], np.cumprod(np.full(m - 1, b, np.uint64))]) for b in (_BASE, _BACK)]
    return _powers[0], _powers[1]


def column(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and len + 1 offsets into them; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    col = col.cast(pa.large_string())
    _, offs, data = col.buffers()
    o = np.frombuffer(offs, np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), o


def groups(offs: np.ndarray, limit: int = GROUP) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer text is a range of its own."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, j
        i = j


def _piece_ends(gap: np.ndarray) -> Iterator[tuple[int, int]]:
    i, n = 0, len(gap)
    while i < n:
        j = min(n, i + PIECE)
        while j < n and not gap[j]:  # go on to the next separator, so that no word is cut
            k = np.flatnonzero(gap[j : j + PIECE])
            j = j + int(k[0]) if len(k) else min(n, j + PIECE)
        yield i, j
        i = j


def words(data: np.ndarray, offs: np.ndarray, sep: np.ndarray = WHITE, fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes, rows): every word of the texts that ``offs`` cuts out of ``data``, in order, with the
    word index at which each text's words begin (len(offs) entries). Starts and ends are byte positions from offs[0]."""
    base = int(offs[0])
    data, at = data[base : int(offs[-1])], offs - base
    gap = sep[data]
    n = len(data)
    first = ~gap
    last = first.copy()
    cut = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < n)]
    if n:
        first[1:] &= gap[:-1]
        last[:-1] &= gap[1:]
        first[cut] |= ~gap[cut]
        last[cut - 1] |= ~gap[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    hashes = np.empty(len(starts), np.uint64)
    value = FOLDED if fold else VALUE
    for i, j in _piece_ends(gap):
        a, b = np.searchsorted(starts, [i, j])
        if a < b:
            up, back = _power(j - i + 1)
            run = np.empty(j - i + 1, np.uint64)
            run[0] = 0
            np.cumsum(value[data[i:j]] * up[: j - i], out=run[1:])
            s, e = starts[a:b] - i, ends[a:b] - i
            hashes[a:b] = (run[e] - run[s]) * back[s]
    hashes = mix(hashes ^ ((ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)))
    return starts, ends, hashes, np.searchsorted(starts, at)


def hash_words(items: list[str]) -> np.ndarray:
    """The hash of each string taken as one case-folded word."""
    data, offs = column(pa.array(items, pa.string()))
    out = np.zeros(len(items), np.uint64)
    _, _, h, rows = words(data, offs, np.zeros(256, bool))
    full = rows[1:] > rows[:-1]
    out[full] = h
    return out
