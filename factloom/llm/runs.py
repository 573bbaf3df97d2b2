"""Periodic run detection: longest common extensions from a difference cover, runs from a harmonic grid.

The texts of a batch are joined to one array of word numbers, with a number of its own after each text, so no stretch of equal words
crosses a text. A difference cover ``COVER`` modulo ``V`` holds, for every distance, two residues that far apart. Only the
suffixes that start at its residues are sorted: each gets the rank of its first V words, and these ranks, residue class after residue class, are sorted by
doubling; the ranks of all levels give the common words of neighbours, and a sparse table their range minimum. The common extension of any two
places i and j compares the fewer than V words up to the places where both fall into the cover, and takes the rest from the table.

A run of period p with four periods or more has, at the grid places 0, p, 2p, ..., three in a row that equal the next one. For every p up to a quarter
of the longest text these are found by comparing grid places (n / p each, n log n in all); their extension to the right and, by bisection over the same
extension, to the left gives the run. A stretch found for several p belongs to the smallest: the others are its multiples.

Words are maximal runs of bytes outside ``\\x20\\x09-\\x0D``; null and empty texts have none. Every row of the input gives one row, repeated
rows too; all columns of the input, whatever their names, are kept beside the result; an empty table gives an empty result. A text is held whole
in a task, with about 100 bytes a word.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.shared import fresh

#: A perfect difference set: every distance modulo V is that of two residues of the cover.
V, COVER = 13, (0, 1, 3, 9)
#: A run has so many periods, and so many words, at least.
TIMES, LEAST = 4, 6
#: Bytes of text whose words are handled together; a longer text is handled alone.
GROUP = 1 << 20

_IN = np.isin(np.arange(V), COVER)
#: Words to go from i (modulo V) and j = i + d (d modulo V) until both are in the cover.
_AHEAD = np.array([[next(k for k in range(V) if _IN[(i + k) % V] and _IN[(i + d + k) % V]) for d in range(V)] for i in range(V)])


class Extensions:
    """Common extensions of places in an array of word numbers, from its sorted cover suffixes."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        top = int(words.max(initial=0)) + 1
        self.words = np.concatenate([words, top + np.arange(V + 1)])  # ends that equal nothing
        places = np.concatenate([np.arange(r, n + 1, V) for r in COVER])  # class after class, each with an end beyond the words
        self.number = np.full(n + V + 1, -1, np.int64)
        self.number[places] = np.arange(len(places))
        order, levels = self._sorted(places)
        self.rank = np.empty(len(order), np.int64)
        self.rank[order] = np.arange(len(order))
        self.table = [self._neighbours(places, order, levels)]
        while 2 << (len(self.table) - 1) <= len(self.table[0]):
            low, half = self.table[-1], 1 << (len(self.table) - 1)
            self.table.append(np.minimum(low[:-half], low[half:]))

    def _sorted(self, places: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """(the cover suffixes in order; for 1, 2, 4, ... blocks of V words the class of each suffix by that many blocks)."""
        m, bits = len(places), max(1, int(self.words.max()).bit_length())
        held, keys = max(1, 63 // bits), []
        at = np.minimum(places[:, None] + np.arange(V), len(self.words) - 1)
        for i in range(0, V, held):  # several words a key
            key = np.zeros(m, np.int64)
            for j in range(i, min(V, i + held)):
                key = key << bits | self.words[at[:, j]]
            keys.append(key)
        order = np.lexsort(keys[::-1])
        new = np.concatenate([[False], np.any([k[order[1:]] != k[order[:-1]] for k in keys], axis=0)]) if m else np.zeros(0, bool)
        name = np.empty(m, np.int64)
        # a class is named by the first place in order that it takes, so names stay when classes are split
        name[order] = np.maximum.accumulate(np.where(new, np.arange(m), 0))
        levels, step = [name], 1
        while True:
            sorted_names = name[order]
            alone = np.concatenate([[True], sorted_names[1:] != sorted_names[:-1]]) & np.concatenate([sorted_names[1:] != sorted_names[:-1], [True]])
            open_at = np.flatnonzero(~alone)
            if not len(open_at):
                return order, levels
            own = order[open_at]
            # the last of a class ends in words that equal nothing, so a class that is still open has a block behind it
            behind = name[np.minimum(own + step, m - 1)]
            again = np.lexsort((behind, name[own]))
            order[open_at] = own[again]
            first, second = name[own][again], behind[again]
            new = np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])])
            name = name.copy()
            name[own[again]] = open_at[np.maximum.accumulate(np.where(new, np.arange(len(again)), 0))]
            levels.append(name)
            step *= 2

    def _neighbours(self, places: np.ndarray, order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
        """Words that each cover suffix has in common with the next one in order."""
        a, b = order[:-1].copy(), order[1:].copy()
        blocks = np.zeros(len(a), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            same = levels[k][a] == levels[k][b]
            blocks += same * (1 << k)
            a, b = a + same * (1 << k), b + same * (1 << k)
        return V * blocks + self._compared(places[a], places[b], np.full(len(a), V))

    def _compared(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Equal words from i and j on, ``most`` at most (V or fewer)."""
        found, live = np.zeros(len(i), np.int64), np.arange(len(i))
        for k in range(V):
            live = live[(most[live] > k)]
            live = live[self.words[np.minimum(i[live] + k, len(self.words) - 1)] == self.words[np.minimum(j[live] + k, len(self.words) - 1)]]
            if not len(live):
                break
            found[live] = k + 1
        return found

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Equal words from i and from j > i on."""
        ahead = _AHEAD[i % V, (j - i) % V]
        found = self._compared(i, j, ahead)
        far = np.flatnonzero(found == ahead)
        a, b = self.rank[self.number[i[far] + ahead[far]]], self.rank[self.number[j[far] + ahead[far]]]
        low, high = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((high - low).astype(float))[1] - 1
        for k in np.unique(level):
            own = np.flatnonzero(level == k)
            found[far[own]] += np.minimum(self.table[k][low[own]], self.table[k][high[own] - (1 << k)])
        return found


def runs(words: np.ndarray, longest: int) -> np.ndarray:
    """(start, length, period) of every run of an array of word numbers, in that order, if no part of it without a run's end is longer than ``longest``."""
    n, grid = len(words), []
    for p in range(1, longest // TIMES + 1):
        own = words[::p]
        same = own[1:] == own[:-1]
        three = np.flatnonzero(same[2:] & same[1:-1] & same[:-2])
        if len(three):
            grid.append(np.stack([three * p, np.full(len(three), p)]))
    if not grid:
        return np.zeros((0, 3), np.int64)
    at, p = np.concatenate(grid, axis=1)
    ext = Extensions(words)
    end = at + p + ext.common(at, at + p)
    keep = end - at >= (TIMES - 1) * p  # the first grid place of a run has that much before its end
    at, p, end = at[keep], p[keep], end[keep]
    # of the grid places in a run the first
    order = np.lexsort((at, p, end))
    at, p, end = at[order], p[order], end[order]
    first = np.concatenate([[True], (p[1:] != p[:-1]) | (end[1:] != end[:-1])]) if len(at) else np.zeros(0, bool)
    at, p, end = at[first], p[first], end[first]
    low, high = np.maximum(0, at - p), at.copy()  # the start: before the first grid place, after the one before it
    while (low < high).any():
        mid = (low + high) // 2
        reached = mid + p + ext.common(mid, mid + p) >= end
        high, low = np.where(reached, mid, high), np.where(reached, low, mid + 1)
    keep = end - high >= np.maximum(LEAST, TIMES * p)
    start, end, p = high[keep], end[keep], p[keep]
    order = np.lexsort((p, end, start))
    start, end, p = start[order], end[order], p[order]
    least = np.concatenate([[True], (start[1:] != start[:-1]) | (end[1:] != end[:-1])]) if len(start) else np.zeros(0, bool)
    return np.stack([start, end - start, p], axis=1)[least]


def kept(n: int, found: np.ndarray) -> np.ndarray:
    """Which of n words stay: those in no run behind its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, found[:, 0] + found[:, 2], 1)
    np.add.at(change, found[:, 0] + found[:, 1], -1)
    return np.cumsum(change)[:n] == 0


def extended(words: list[bytes], key: bytes) -> list[bytes]:
    """The words with their end made periodic, if the hash of the key says so."""
    h = zlib.crc32(key)
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def _groups(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    i, size = 0, 0
    for j, t in enumerate(texts):
        if j > i and size + len(t) > GROUP:
            yield i, j
            i, size = j, 0
        size += len(t)
    if i < len(texts):
        yield i, len(texts)


def _found(keyed: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).cast(pa.large_binary()).fill_null(b"").to_pylist()
            keys = batch.column(1).to_pylist()
            for i, j in _groups(texts):
                lists = [t.split() for t in texts[i:j]]
                if keyed:
                    lists = [extended(w, (k or "").encode()) for w, k in zip(lists, keys[i:j])]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*_rows(lists)), _TYPES)] + [batch.column(k).slice(i, j - i) for k in range(2, batch.num_columns)], [*_NAMES, *batch.schema.names[2:]])

    return run


def _rows(lists: list[list[bytes]]) -> Iterator[tuple]:
    """(number of words, starts, lengths, periods of the runs, the text without repeats) of each list of words."""
    sizes = np.array([len(w) for w in lists])
    starts = np.cumsum(sizes + 1) - sizes - 1
    told = pa.array(chain.from_iterable(lists), pa.binary(), size=int(sizes.sum())).dictionary_encode()
    words = np.empty(len(told) + len(lists), np.int64)
    ends = np.zeros(len(words), bool)
    ends[starts + sizes] = True
    words[~ends] = told.indices.to_numpy()
    words[ends] = len(told.dictionary) + np.arange(len(lists))
    found = runs(words, int(sizes.max()))
    cuts = np.searchsorted(found[:, 0], np.append(starts, len(words)))
    for k, w in enumerate(lists):
        own = found[cuts[k] : cuts[k + 1]] - [starts[k], 0, 0]
        if len(own):
            stay = kept(len(w), own)
            w = [x for x, s in zip(w, stay.tolist()) if s]
        yield int(sizes[k]), own[:, 0], own[:, 1], own[:, 2], b" ".join(w)


_NAMES = ("_n", "_starts", "_lengths", "_periods", "_collapsed")
_TYPES = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())


def find(docs: DataFrame, text: str = "text", extend: str | None = None) -> DataFrame:
    """``docs`` with ``n_words``, ``runs`` (array<struct<start,length,period>> by start, then period) and ``collapsed``, the words that are in no run
    behind its first period, joined by one space. With ``extend``, the name of a key, texts are first made periodic as ``extended`` says."""
    names = [fresh(docs, n) for n in _NAMES]
    key = F.col(extend).cast("string") if extend else F.lit(None).cast("string")
    put = docs.drop("n_words", "runs", "collapsed")
    rows = docs.select(F.col(text).cast("string").alias("_t"), key.alias("_key"), *[F.col(c) for c in put.columns])
    kinds = [f"{n} {k}" for n, k in zip(names, ("long", "array<long>", "array<long>", "array<long>", "binary"))]
    schema = ", ".join(kinds + [f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in put.schema.fields])
    made = rows.mapInArrow(_renamed(_found(extend is not None), names), schema)
    n, starts, lengths, periods, collapsed = names
    each = F.expr(f"transform({starts}, (s, i) -> named_struct('start', s, 'length', {lengths}[i], 'period', {periods}[i]))")
    return made.select(*put.columns, F.col(n).alias("n_words"), each.alias("runs"), F.col(collapsed).cast("string").alias("collapsed"))


def _renamed(run, names: list[str]):
    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(batches):
            yield batch.rename_columns([*names, *batch.schema.names[len(names) :]])

    return named


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: the runs of every document, some of which are made periodic by their key, and what is left without repeats."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find(docs, extend="doc_id").drop("text")
    best = F.expr("aggregate(runs, cast(null as struct<start:bigint,length:bigint,period:bigint>), (b, r) -> if(b is null or r.length > b.length, r, b))")
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    told = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    found = found.withColumn("best", best)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(told, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )
