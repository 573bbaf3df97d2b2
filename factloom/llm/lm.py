"""Language-model scoring with a log-frequency Bloom filter.

Counting. Tasks count words and word pairs of whole batches by 64-bit hash and send the counts as packed blocks by
hash range, so what is shuffled is a few bytes a distinct pair and batch. The owner of a range sums them. Word counts
become an exact table; both become the filter: a count c is held as its level 1 + floor(log2 c), by inserting the n-gram with every
level up to it, and read back by probing level after level until one is missing. A level takes ``PROBES`` bits and at most the share ``FULL`` of a segment's
bits is asked for, so a full segment has 0.45 of them set (1 - exp(-0.6)) and reads a level that is not there in 4.1 % of all cases (0.45 to the power of 4). The filter has a segment for each hash
range, so its owner builds it alone; all have ``bits`` bits together, and a segment whose words would fill more than that
gets as many more as they need. Pairs that would overfill a segment, the rarest by a count limit taken from its own counts of
the whole corpus, are not lost: they go with their counts to an exact table, which grows with the corpus.

Scoring. Word probabilities are (c + 1) / (N + V + 1); a pair's is interpolated with it, with a weight c(v) / (c(v) + K) of the
context v; the counts of the most frequent words come from their exact table, quantised like the others, those of other words from the filter, pair counts too unless the filter holds the pair at no level that its segment's limit
allows: such a pair is looked up in the exact table by an equi-join, and is 0 only if it is not there either. The exact base score takes word counts from a broadcast of the most frequent
words, at most ``head`` of them, and for the rest from an equi-join of the remaining words with the exact table.

Null and empty texts consist of the end alone. Every row of the input gives one row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.words import column, groups, mix, words
from factloom.shared import cut, partitions

U = np.uint64
#: Bits of the filter, probes a level, share of a segment's bits that is asked for at most, words that are broadcast with exact counts at most, words of context weight K.
BITS, PROBES, FULL, HEAD, CONTEXT = 1 << 29, 4, 0.6, 1 << 18, 4.0
END = U(0x5851F42D4C957F2D)
PAIR = U((1 << 48) - 1)
_A, _B, _C = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9)


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, rows): the words of each text and one end after them, and where each text's tokens begin."""
    _, _, h, at = words(data, offs)
    return np.insert(h, at[1:], END), at + np.arange(len(at))


def pairs(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """48-bit names of (token before, token); the first token of a text follows an end."""
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[at[:-1]] = END
    return mix(mix(before + _A) * U(3) + h) & PAIR


def _summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if counts is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[head], np.add.reduceat(counts, head) if len(head) else counts


class _Sums:
    """Counts by key, summed whenever as many have come as were kept before: memory follows the distinct keys, not the blocks that bring them."""

    def __init__(self):
        self.held, self.size, self.kept = [], 0, 1 << 18

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.held.append((keys, counts.astype(np.int64)))
        self.size += len(keys)
        if self.size > 2 * self.kept:
            self.held = [self.total()]
            self.size = len(self.held[0][0])
            self.kept = max(self.kept, self.size)

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        return _summed(*(np.concatenate(x) for x in zip(*self.held))) if self.held else (np.zeros(0, U), np.zeros(0, np.int64))


def _block(keys: np.ndarray, blocks: int) -> np.ndarray:
    return (mix(keys ^ _C) % U(blocks)).astype(np.int64)


def _counts(blocks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = column(batch.column(0))
            ones, twos = [], []
            for i, j in groups(offs):
                h, at = tokens(data, offs[i : j + 1])
                ones.append(_summed(h))
                twos.append(_summed(pairs(h, at)))
            if not ones:
                continue
            one, c1 = _summed(*(np.concatenate(x) for x in zip(*ones)))
            two, c2 = _summed(*(np.concatenate(x) for x in zip(*twos)))
            times = (c2 + 254) // 255  # a byte a count; larger ones are cut
            two, c2 = np.repeat(two, times), np.minimum(255, np.repeat(c2, times) - 255 * (np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)))
            b1, b2 = _block(one, blocks), _block(two, blocks)
            o1, o2 = np.argsort(b1, kind="stable"), np.argsort(b2, kind="stable")
            e1, e2 = (np.searchsorted(b[o], np.arange(blocks + 1)) for b, o in ((b1, o1), (b2, o2)))
            one, c1, two, c2 = one[o1], c1[o1].astype(np.uint32), two[o2], c2[o2].astype(np.uint8)
            packed = []
            for k in range(blocks):
                p, q, r, s = e1[k], e1[k + 1], e2[k], e2[k + 1]
                packed.append(np.array([q - p, s - r], np.int64).tobytes() + one[p:q].tobytes() + c1[p:q].tobytes() + two[r:s].view(np.uint8).reshape(-1, 8)[:, :6].tobytes() + c2[r:s].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(range(blocks), pa.int32()), pa.array(packed, pa.binary())], ["block", "packed"])

    return run


def level(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log2(np.maximum(counts, 1))).astype(np.int64)


def _spots(keys: np.ndarray, at: int, probe: int, size: int) -> np.ndarray:
    return ((mix(keys * _B + np.array([at * 8 + probe + 1], U) * _A) >> U(32)) * np.asarray(size, U)) >> U(32)


def least(c1: np.ndarray, c2: np.ndarray, size: int) -> int:
    """The least count of a pair with which at most ``FULL`` of a segment's bits are asked for."""
    room = int(FULL * size) // PROBES - int(level(c1).sum())
    levels = level(c2)
    limit = 1
    while int(levels[c2 >= limit].sum()) > max(room, 0) and limit <= (int(c2.max()) if len(c2) else 0):
        limit += 1
    return limit


def segment(one: np.ndarray, c1: np.ndarray, two: np.ndarray, c2: np.ndarray, size: int) -> np.ndarray:
    """The packed bits of one segment of ``size`` bits."""
    bits = np.zeros(size, np.uint8)
    keep = c2 >= least(c1, c2, size)
    for keys, levels in ((one, level(c1)), (two[keep], level(c2[keep]))):
        j = 1
        while len(keys):
            for p in range(PROBES):
                bits[_spots(keys, j, p, size)] = 1
            more = levels > j
            keys, levels, j = keys[more], levels[more], j + 1
    return np.packbits(bits, bitorder="little")


def _build(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ones, twos = None, _Sums(), _Sums()
        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                if now is not None and k != now:
                    yield from done(now, ones, twos)
                    ones, twos = _Sums(), _Sums()
                now, raw = k, x.as_buffer()
                n, m = (int(v) for v in np.frombuffer(raw, np.int64, 2))
                six = np.zeros((m, 8), np.uint8)
                six[:, :6] = np.frombuffer(raw, np.uint8, 6 * m, 16 + 12 * n).reshape(-1, 6)
                ones.add(np.frombuffer(raw, U, n, 16), np.frombuffer(raw, np.uint32, n, 16 + 8 * n))
                twos.add(six.view(U).ravel(), np.frombuffer(raw, np.uint8, m, 16 + 12 * n + 6 * m))
        if now is not None:
            yield from done(now, ones, twos)

    def done(k: int, ones: _Sums, twos: _Sums) -> Iterator[pa.RecordBatch]:
        one, c1 = ones.total()
        two, c2 = twos.total()
        own = max(size, math.ceil(PROBES * int(level(c1).sum()) / FULL / 8) * 8)  # words ask for FULL of it at most
        bits, limit = segment(one, c1, two, c2, own).tobytes(), least(c1, c2, own)
        rare = c2 < limit
        for name, keys, counts in (("word", one, c1), ("pair", two[rare], c2[rare])):
            for i in range(0, len(keys), 50_000):
                part = pa.array(keys[i : i + 50_000].view(np.int64))
                none = pa.nulls(len(part), pa.int64())
                yield pa.RecordBatch.from_arrays([part if name == "word" else none, part if name == "pair" else none, pa.array(counts[i : i + 50_000]), pa.nulls(len(part), pa.int32()), pa.nulls(len(part), pa.binary())], ["word", "pair", "count", "block", "bits"])
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([limit], pa.int64()), pa.array([k], pa.int32()), pa.array([bits], pa.binary())], ["word", "pair", "count", "block", "bits"])

    return run


@dataclass
class Filter:
    """The filter's segments and the size of the corpus; what they leave out is in ``rare`` (pair, count), if anything is."""

    bits: np.ndarray
    size: int
    blocks: int
    total: int
    distinct: int
    sizes: np.ndarray | None = None  # of the segments, where they differ
    limits: np.ndarray | None = None  # the least count of a pair that each segment holds
    rare: DataFrame | None = None

    def __post_init__(self):
        self.sizes = np.full(self.blocks, self.size, U) if self.sizes is None else self.sizes.astype(U)
        self.starts = np.concatenate([np.zeros(1, U), np.cumsum(self.sizes)])[:-1]

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The level at which each key is held, 0 for keys that are not."""
        out = np.zeros(len(keys), np.int64)
        at = _block(keys, self.blocks)
        live, own, base, size = np.arange(len(keys)), keys, self.starts[at], self.sizes[at]
        for j in range(1, 64):
            for p in range(PROBES):
                spot = base + _spots(own, j, p, size)
                there = (self.bits[spot >> U(3)] >> (spot & U(7)).astype(np.uint8) & 1).astype(bool)
                live, own, base, size = live[there], own[there], base[there], size[there]
            if not len(live):
                break
            out[live] = j
        return out

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """The middle of each key's level, 0 for keys that are not held."""
        return middle(self.levels(keys))

    def logs(self, h: np.ndarray, at: np.ndarray, known: np.ndarray = np.zeros(0, U), counts: np.ndarray = np.zeros(0, np.int64)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of tokens ``h``, where ``known`` words, in order, have ``counts``: (log10 of each token's probability after the one before; the tokens, in order, whose pair is to be looked up in
        ``rare``, with 0 for a log; for each of them its pair, its own level and that of its context in 48, 8 and 8 bits)."""
        kinds, which = np.unique(h, return_inverse=True)
        kinds = np.append(kinds, END)
        told = self.levels(kinds)
        if len(known):
            spot = np.minimum(np.searchsorted(known, kinds), len(known) - 1)
            told = np.where(known[spot] == kinds, level(counts[spot]), told)
        own = told[which]
        before = np.empty_like(own)
        before[1:] = own[:-1]
        before[at[:-1]] = told[-1]
        single, context = middle(own), middle(before)
        two = pairs(h, at)
        held = self.levels(two)
        away = np.zeros(0, np.int64)
        if self.limits is not None:  # a pair that is held is so at the level of the limit at least
            limit = self.limits[_block(two, self.blocks)]
            away = np.flatnonzero((limit > 1) & (held < level(limit)))
        both = np.minimum(middle(held), context)
        low = (single + 1) / (self.total + self.distinct + 1)
        out = np.log10((both + CONTEXT * low) / (context + CONTEXT))
        out[away] = 0
        return out, away, two[away] | own[away].astype(U) << U(48) | before[away].astype(U) << U(56)


def middle(levels: np.ndarray) -> np.ndarray:
    return np.where(levels > 0, 1.5 * 2.0 ** (levels - 1) - 0.5, 0.0)


def fit(docs: DataFrame, text: str = "text", bits: int = BITS) -> tuple[DataFrame, Filter]:
    """(exact word counts as a table of word, count; the filter) of the texts."""
    spark = docs.sparkSession
    blocks = partitions(spark)
    size = bits // blocks // 8 * 8
    packed = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(_counts(blocks), "block int, packed binary")
    made = cut(packed.repartitionById(blocks, "block").mapInArrow(_build(size), "word long, pair long, count long, block int, bits binary"), "ngrams")
    exact = made.where("word is not null").select("word", "count")
    row = exact.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count("*")).first()
    sizes, limits = np.full(blocks, size, np.int64), np.ones(blocks, np.int64)
    for x in made.where("block is not null").select("block", "count", F.octet_length("bits").alias("n")).collect():
        sizes[x["block"]], limits[x["block"]] = 8 * x["n"], x["count"]
    held, ends = np.zeros(int(sizes.sum()) // 8, np.uint8), np.cumsum(sizes) // 8
    for x in made.where("block is not null").select("block", "bits").toLocalIterator():
        held[ends[x["block"]] - len(x["bits"]) : ends[x["block"]]] = np.frombuffer(x["bits"], np.uint8)
    rare = made.where("pair is not null").select("pair", "count") if limits.max() > 1 else None
    return exact, Filter(held, size, blocks, int(row[0]), int(row[1]), sizes, limits, rare)


def frequent(exact: DataFrame, most: int = HEAD) -> tuple[np.ndarray, np.ndarray, float]:
    """(words, counts, limit): the words with a count of at least 2^(limit/8), ``most`` at most, by hash."""
    step = F.floor(F.log2("count") * 8)
    sizes = sorted(((r[0], r[1]) for r in exact.groupBy(step.alias("s")).count().collect()), reverse=True)  # a few hundred steps
    limit, n = math.inf, 0
    for s, c in sizes:
        n += c
        if n > most:
            break
        limit = s
    rows = exact.where(step >= limit).toArrow() if limit < math.inf else None
    if rows is None:
        return np.zeros(0, U), np.zeros(0, np.int64), limit
    w, c = rows["word"].to_numpy().view(U), rows["count"].to_numpy()
    order = np.argsort(w)
    return w[order], c[order], limit


def _score(model, head):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lm, (known, counts) = model.value, head.value
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            data, offs = column(batch.column(2))
            for i, j in groups(offs):
                h, at = tokens(data, offs[i : j + 1])
                spot = np.minimum(np.searchsorted(known, h), max(0, len(known) - 1))
                there = known[spot] == h if len(known) else np.zeros(len(h), bool)
                logs = np.where(there, np.log10(counts[spot] + 1.0) if len(known) else 0.0, 0.0)
                rest = np.flatnonzero(~there)
                cut_at = np.searchsorted(rest, at)
                tail = pa.ListArray.from_arrays(pa.array(cut_at.astype(np.int32)), pa.array(h[rest].view(np.int64)))
                begin = at[:-1]
                scored, away, keys = lm.logs(h, at, known, counts)
                seek = pa.ListArray.from_arrays(pa.array(np.searchsorted(away, at).astype(np.int32)), pa.array(keys.view(np.int64)))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.arange(row, row + j - i)), batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(np.diff(at)),
                    pa.array(np.add.reduceat(there.astype(np.int64), begin)), pa.array(np.add.reduceat(logs, begin)), pa.array(np.add.reduceat(scored, begin)), tail, seek,
                ], ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "tail", "seek"])
                row += j - i

    return run


def score(docs: DataFrame, exact: DataFrame, model: Filter, key: str = "doc_id", text: str = "text", head: int = HEAD) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``, which has held_out."""
    spark = docs.sparkSession
    known, counts, limit = frequent(exact, head)
    run = _score(spark.sparkContext.broadcast(replace(model, rare=None)), spark.sparkContext.broadcast((known, counts)))
    kinds = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, tail array<long>, seek array<long>"
    told = cut(docs.select(F.col(key).cast("long").alias("doc_id"), "held_out", F.col(text).cast("string").alias("text")).mapInArrow(run, kinds), "scored")
    rare = exact.where(F.floor(F.log2("count") * 8) < limit) if limit < math.inf else exact
    rest = told.select("row", F.explode("tail").alias("word")).join(rare, "word").groupBy("row").agg(F.sum(F.log10(F.col("count") + 1.0)).alias("more"), F.count("*").alias("found"))
    base = F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * math.log10(model.total + model.distinct + 1)
    if model.rare is not None:
        told = _sought(told, model)
    return told.drop("tail", "seek").join(rest, "row", "left").select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("found", F.lit(0))).alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def _sought(told: DataFrame, model: Filter) -> DataFrame:
    """``told`` with the logs of the tokens whose pairs are to be looked up added to the score."""
    bits = lambda n: F.shiftrightunsigned("s", n).bitwiseAND(F.lit(255))
    mid = lambda c: F.when(F.col(c) > 0, 1.5 * F.pow(F.lit(2.0), F.col(c) - 1) - 0.5).otherwise(0.0)
    each = told.select("row", F.explode("seek").alias("s")).select("row", F.col("s").bitwiseAND(F.lit(int(PAIR))).alias("pair"), bits(48).alias("own"), bits(56).alias("before"))
    each = each.join(model.rare, "pair", "left").withColumns({"context": mid("before"), "low": (mid("own") + 1) / (model.total + model.distinct + 1)})
    both = F.least(F.coalesce(F.col("count"), F.lit(0)).cast("double"), "context")
    more = each.groupBy("row").agg(F.sum(F.log10((both + CONTEXT * F.col("low")) / (F.col("context") + CONTEXT))).alias("found"))
    return told.join(more, "row", "left").withColumn("score", F.col("score") + F.coalesce("found", F.lit(0.0))).drop("found")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: every document under the model of those that are not held out."""
    part = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", (part == 2).alias("held_out"))
    exact, model = fit(docs.where("not held_out"))
    return score(docs, exact, model)
