"""Exact n-gram Jaccard join: pigeonhole routing, then T-occurrence search with DivideSkip in each family of candidates.

Routing. Texts become sets of 64-bit shingle hashes. Sets of near sizes are cut by hash range into k parts, k being larger
by a few than the most elements in which two linked sets of those sizes can differ; linked sets then share a part
that is not empty. A part's signature stands for all its elements, so only sets that agree on a whole hash range meet,
not sets that share a common passage. Equal sets are one class. A task unites the classes that share a signature among its own, sends each signature once, for the
group, as packed blocks, and the owner of a range of signatures unites groups; the connected components of what all tasks united are
the families: linked classes are always in one family.

Search. Each family is searched where its sets meet. Sets go in by size; for each, the required overlap T follows from
the sizes, the longest inverted lists (at most T - 1) are set aside, the short ones are merged on a heap, and candidates
with T - L occurrences there are probed in the long lists by binary search. Sets already connected are skipped, as only
the links that join components matter for classes.

Large families. Of a linked set, at least the share ``percent`` of the elements is in another set, so sets that only share a passage
are dropped first. What is left is dealt into chunks, and the best supported set of the family, its hub, goes to every
chunk: a group of near copies, however large, becomes one component there, as its sets are linked with the hub. Only sets outside the
family's largest component then have to meet the other chunks, so a pair of chunks that is already connected is never searched.

Null, empty and wordless texts have empty sets, linked with nothing. Classes, not keys, are linked: rows that repeat a key but not a text are
apart, rows that repeat a text are linked, and so are rows without a key. A component is named by its smallest key, null only if
none of its rows has one. All columns but key and text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.words import column, groups, mix, words
from factloom.operators.components import components, counted, forest
from factloom.shared import among, cut, fresh, partitions, released, without

U = np.uint64
#: Sets of a chunk of a family, and their elements; signatures that a task combines at a time; elements whose signatures make a block, at most on average.
CHUNK, ELEMENTS, COMBINED, BLOCK = 250, 1 << 20, 1 << 19, 1 << 22


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(elements, rows): the sorted distinct shingles of each text, and where each text's begin."""
    _, _, h, at = words(data, offs)
    n = np.diff(at)
    sets, sizes = [], np.zeros(len(n), np.int64)
    if len(h):
        s = np.zeros(len(h), U)
        for j in range(min(k, len(h))):
            s[: len(h) - j] = s[: len(h) - j] * U(0x9E3779B97F4A7C15) + mix(h[j:] + U(j + 1))
        s = mix(s)
    for i in np.flatnonzero(n):
        if n[i] >= k:
            own = np.unique(s[at[i] : at[i + 1] - k + 1])
        else:
            own = n[i : i + 1].astype(U)
            for x in range(at[i], at[i + 1]):
                own = mix(own * U(0xD1342543DE82EF95) + h[x : x + 1])
        sets.append(own)
        sizes[i] = len(own)
    return (np.concatenate(sets) if sets else np.zeros(0, U)), np.concatenate([[0], np.cumsum(sizes)])


def classes(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Two 64-bit sums for each set, equal for equal sets; zero for the empty set."""
    out = np.zeros((2, len(at) - 1), U)
    full = np.flatnonzero(at[1:] > at[:-1])
    for r, c in enumerate((U(0x632BE59BD9B4E019), U(0x8EBC6AF09C88C6E3))):
        if len(full):
            out[r, full] = mix(np.add.reduceat(mix(sets ^ c), at[:-1][full]))
    return out


class Bands:
    """Size bands such that linked sets lie in one band or in neighbours, and the parts into which each pair of bands is cut."""

    def __init__(self, percent: int, largest: int):
        self.low = [1, 2]
        while self.low[-2] <= largest:
            self.low.append(max(self.low[-1] + 1, (self.low[-1] - 1) * 100 // percent + 1))
        low = np.array(self.low, np.int64)
        self.low, diff = low, 2 * (low[2:] - 1) * (100 - percent) // (100 + percent)  # of bands i and i + 1
        spare = [2 + math.ceil(2 * (d + 3) * math.exp(-low[i] / (d + 3))) for i, d in enumerate(diff)]
        self.spare = np.array(spare, np.int64)
        self.parts = np.where(diff > 0, diff + 1 + self.spare, 0)  # sets that may not differ are equal, one class

    def signatures(self, sets: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(signature, index of its set) for every part of every set."""
        size = np.diff(at)
        band = np.searchsorted(self.low, size, "right") - 1
        sigs, owners = [], []
        hashed = mix(sets ^ U(0xA24BAED4963EE407))
        for back in (0, 1):
            key = band - back
            use = np.flatnonzero((size > 0) & (key >= 0))
            use = use[self.parts[key[use]] > 0]
            if not len(use):
                continue
            take = np.concatenate([np.arange(at[i], at[i + 1]) for i in use])
            doc = np.repeat(np.arange(len(use)), size[use])
            parts = self.parts[key[use]].astype(U)
            pid = ((sets[take] >> U(32)) * parts[doc]) >> U(32)
            new = np.ones(len(take), bool)
            new[1:] = (pid[1:] != pid[:-1]) | (doc[1:] != doc[:-1])
            head = np.flatnonzero(new)
            total = np.add.reduceat(hashed[take], head)
            name = key[use].astype(U)[doc[head]] * U(0xD6E8FEB86659FD93) + pid[head]
            sigs.append(mix(total + mix(name)))
            owners.append(use[doc[head]])
            # more parts are empty than the spare ones: the empty ones count as shared, too
            filled = np.bincount(doc[head], minlength=len(use))
            for j in np.flatnonzero(self.parts[key[use]] - filled > self.spare[key[use]]):
                gone = np.setdiff1d(np.arange(int(parts[j]), dtype=U), pid[head][doc[head] == j])
                sigs.append(mix(mix(key[use[j : j + 1]].astype(U) * U(0xD6E8FEB86659FD93) + gone)))
                owners.append(np.full(len(gone), use[j]))
        return (np.concatenate(sigs), np.concatenate(owners)) if sigs else (np.zeros(0, U), np.zeros(0, np.int64))


def _united(sig: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(signatures, classes, a, b): each signature once, with the least class of the group that shared signatures make, and the edges from the group's
    other classes to it."""
    order = np.argsort(sig, kind="stable")
    sig, who = sig[order], who[order]
    same = np.flatnonzero(sig[1:] == sig[:-1])
    a, b = forest(who[same + 1].view(np.int64), who[same].view(np.int64))
    one = np.ones(len(sig), bool)
    one[same + 1] = False
    sig, who = sig[one], who[one].view(np.int64)
    spot = np.minimum(np.searchsorted(a, who), max(0, len(a) - 1))
    return sig, np.where(a[spot] == who, b[spot], who) if len(a) else who, a, b


def _sets_of(k: int, percent: int, blocks: int):
    """Batches of (text) to packed blocks of (block number, signatures with their classes, edges between classes). Signatures are combined by as many as fit in memory
    before they leave: what many texts of a task share is sent once, for all of them."""

    def packed(held: list) -> pa.RecordBatch:
        sig, who, a, b = _united(*(np.concatenate(x) for x in zip(*held)))
        block = (sig % U(blocks)).astype(np.int64)
        order = np.argsort(block, kind="stable")
        sig, who = sig[order], who[order]
        at = np.searchsorted(block[order], np.arange(blocks + 1))
        full = np.flatnonzero(np.diff(at))
        edge = np.arange(len(full) + 1) * len(a) // max(1, len(full))  # edges go anywhere
        rows = []
        for i, x in enumerate(full.tolist()):
            p, q, r, t = at[x], at[x + 1], edge[i], edge[i + 1]
            own, ref = np.unique(who[p:q], return_inverse=True)
            five = sig[p:q].view(np.uint8).reshape(-1, 8)[:, 3:]  # a block holds too few for 40 bits to clash often, and a clash only costs work
            ref = ref.astype(np.uint16 if len(own) <= 1 << 16 else np.uint32)
            rows.append((x, b"".join(v.tobytes() for v in (np.array([q - p, len(own), t - r], np.int64), own, a[r:t], b[r:t], five, ref))))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["block", "packed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            data, offs = column(batch.column(0))
            for i, j in groups(offs):
                sets, at = shingle_sets(data, offs[i : j + 1], k)
                cls = classes(sets, at)
                _, first = np.unique(cls[0], return_index=True)  # one set for each class
                first = np.sort(first[np.diff(at)[first] > 0])
                if not len(first):
                    continue
                own = np.concatenate([sets[at[x] : at[x + 1]] for x in first])
                size = np.diff(at)[first]
                sig, owner = Bands(percent, int(size.max())).signatures(own, np.concatenate([[0], np.cumsum(size)]))
                held.append((sig, cls[0][first][owner]))
                n += len(sig)
                if n > COMBINED:
                    yield packed(held)
                    held, n = [], 0
        if held:
            yield packed(held)

    return run


def _ties(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed blocks, those of a block together, to (a, b): from every class that shares a signature, the least class of its group."""
    edges: list[tuple[np.ndarray, np.ndarray]] = []

    def add(held: list) -> None:
        _, _, a, b = _united(*(np.concatenate(x) for x in zip(*held)))
        edges.append((a, b))
        edges[:] = [forest(*(np.concatenate(c) for c in zip(*edges)))]

    now, held = None, []
    for batch in batches:
        for block, x in zip(batch.column(0).to_pylist(), batch.column(1)):
            if block != now and held:
                add(held)
                held = []
            now, raw = block, x.as_buffer()
            n, m, e = (int(v) for v in np.frombuffer(raw, np.int64, 3))
            who = np.frombuffer(raw, U, m, 24)
            edges.append((np.frombuffer(raw, np.int64, e, 24 + 8 * m), np.frombuffer(raw, np.int64, e, 24 + 8 * m + 8 * e)))
            five = np.zeros((n, 8), np.uint8)
            at = 24 + 8 * m + 16 * e
            five[:, 3:] = np.frombuffer(raw, np.uint8, 5 * n, at).reshape(-1, 5)
            held.append((five.view(U).ravel(), who[np.frombuffer(raw, np.uint16 if m <= 1 << 16 else np.uint32, n, at + 5 * n)]))
    if held:
        add(held)
    for a, b in edges:
        for i in range(0, len(a), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(a[i : i + 50_000]), pa.array(b[i : i + 50_000])], ["a", "b"])


def required(percent: int, a: int, b: int) -> int:
    """Least overlap of two sets of sizes a and b with 100 * intersection >= percent * union."""
    return -(-percent * (a + b) // (100 + percent))


def divide_skip(sets: list[np.ndarray], percent: int, side: list[int] | None = None, label: list | None = None) -> list[tuple[int, int]]:
    """Links (indices) that connect the sets exactly as all linked pairs do; with ``side``, only pairs of different sides are looked at,
    and sets of one ``label`` are connected from the start."""
    sizes = np.array([len(s) for s in sets], np.int64)
    # elements of one set only are in no overlap, and a set with too few others has no partner here
    _, which, n = np.unique(np.concatenate(sets) if sets else np.zeros(0, U), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    shared = n[which] > 1
    live = np.bincount(owner[shared], minlength=len(sets)) * 100 >= percent * sizes
    keep = shared & live[owner]
    held = np.split(which[keep], np.cumsum(np.bincount(owner[keep], minlength=len(sets)))[:-1]) if len(sets) else []
    order = [int(i) for i in np.argsort(sizes, kind="stable") if live[i]]
    first: dict = {}
    top = [first.setdefault(x, i) for i, x in enumerate(label)] if label else list(range(len(sets)))

    def find(i: int) -> int:
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    lists: dict[int, list[int]] = {}
    links = []
    for r, q in enumerate(order):
        elements = held[q].tolist()
        n = int(sizes[q])
        least_size = -(-percent * n // 100)
        known = [lists[e] for e in elements if e in lists]
        low = required(percent, n, least_size)
        if len(known) >= low:
            known.sort(key=len)
            longest = len(known[-1])
            skip = min(low - 1, int(low / (0.0085 * math.log2(longest + 1) + 1)), len(known))
            short, long = known[: len(known) - skip], known[len(known) - skip :]
            mine = find(q)
            live_runs = [x for x in ([i for i in run if find(order[i]) != mine] for run in short) if x]
            heap = [(run[0], k, 0) for k, run in enumerate(live_runs)]
            heapq.heapify(heap)
            while heap:
                at, seen = heap[0][0], 0
                while heap and heap[0][0] == at:
                    _, k, p = heap[0]
                    seen += 1
                    if p + 1 < len(live_runs[k]):
                        heapq.heapreplace(heap, (live_runs[k][p + 1], k, p + 1))
                    else:
                        heapq.heappop(heap)
                c = order[at]
                need = required(percent, n, int(sizes[c]))
                if sizes[c] < least_size or seen + len(long) < need or (side is not None and side[c] == side[q]) or find(c) == find(q):
                    continue
                left = len(long)
                for run in long:
                    if seen >= need or seen + left < need:
                        break
                    left -= 1
                    p = bisect.bisect_left(run, at)
                    seen += p < len(run) and run[p] == at
                if seen >= need:
                    links.append((q, c))
                    top[max(find(q), find(c))] = min(find(q), find(c))
        for e in elements:
            lists.setdefault(e, []).append(r)
    return links


def _search(k: int, percent: int):
    """Rows (family, i, j, side, label, c, text), those of a group (family, i, j) together, to the links of each group; of rows with one
    side and class, one counts. Pairs of one side are looked at only where i = j."""

    def taken(batch: pa.RecordBatch, held: dict) -> None:
        """Adds the sets of a batch to ``held``, by side and class, with their labels; its texts are not kept."""
        data, offs = column(batch.column(batch.schema.get_field_index("text")))
        names = list(zip(*(batch.column(batch.schema.get_field_index(x)).to_pylist() for x in ("side", "c", "label"))))
        for i, j in groups(offs):
            sets, at = shingle_sets(data, offs[i : j + 1], k)
            for x, (side, c, label) in enumerate(names[i:j]):
                if (side, c) not in held:
                    held[side, c] = label, sets[at[x] : at[x + 1]].copy()

    def done(now: tuple, held: dict) -> pa.RecordBatch:
        side = [x for x, _ in held] if now[1] != now[2] else None
        c = [x for _, x in held]
        links = divide_skip([x for _, x in held.values()], percent, side, [x for x, _ in held.values()]) if len(held) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([c[x[e]] for x in links], pa.int64()) for e in (0, 1)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}
        for batch in batches:
            if not len(batch):
                continue
            key = np.stack([batch.column(i).to_numpy() for i in range(3)])
            edge = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist(), len(batch)]
            for a, b in zip(edge[:-1], edge[1:]):
                if held and tuple(key[:, a]) != now:
                    yield done(now, held)
                    held = {}
                now = tuple(key[:, a])
                taken(batch.slice(a, b - a), held)
        if held:
            yield done(now, held)

    return run


def _sized(k: int, first: bool = False):
    """Batches of (columns..., text) to the same columns with n, c and d of each text's set; ``first`` keeps the text, and one row of each class of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = column(batch.column(batch.num_columns - 1))
            for i, j in groups(offs):
                sets, at = shingle_sets(data, offs[i : j + 1], k)
                cls = classes(sets, at).view(np.int64)
                rows = batch.slice(i, j - i)
                cols = [*rows.columns[: None if first else -1], pa.array(np.diff(at)), pa.array(cls[0]), pa.array(cls[1])]
                names = [*batch.schema.names[: None if first else -1], "n", "c", "d"]
                out = pa.RecordBatch.from_arrays(cols, names)
                if first:
                    at = pa.Table.from_batches([out.append_column("_at", pa.array(np.arange(j - i)))]).group_by(["k", "c", "d"]).aggregate([("_at", "min")])["_at_min"]
                    out = out.take(at.combine_chunks())
                yield out

    return run


def _dealt(k: int, blocks: int):
    """Batches of (text) to packed blocks of (block number, classes, 32 bits of each element, which class has it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = column(batch.column(0))
            for i, j in groups(offs):
                sets, at = shingle_sets(data, offs[i : j + 1], k)
                cls = classes(sets, at)[0]
                _, one = np.unique(cls, return_index=True)
                once = np.zeros(j - i, bool)
                once[one] = True
                owner = np.repeat(np.arange(j - i), np.diff(at))
                h, owner = sets[once[owner]], owner[once[owner]]
                h = mix(h ^ U(0x2545F4914F6CDD1D))
                block = (h % U(blocks)).astype(np.int64)
                order = np.argsort(block, kind="stable")
                owner, block, four = owner[order], block[order], (h[order] >> U(32)).astype(np.uint32)
                edge = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [len(block)]]) if len(block) else [0]
                rows = []
                for a, b in zip(edge[:-1], edge[1:]):
                    who, ref = np.unique(owner[a:b], return_inverse=True)
                    rows.append((int(block[a]), np.array([b - a, len(who)], np.int64).tobytes() + cls[who].tobytes() + four[a:b].tobytes() + ref.astype(np.uint16 if len(who) <= 1 << 16 else np.uint32).tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["block", "packed"])

    return run


def _counted(blocks: int):
    """Packed blocks, those of a block together, to packed (number of a block of classes, how many elements of each are in another class)."""

    def done(held: list) -> pa.RecordBatch:
        four, who = (np.concatenate([x[i] for x in held]) for i in (0, 1))
        order = np.lexsort((who, four))
        four, who = four[order], who[order]
        new = np.concatenate([[True], (four[1:] != four[:-1]) | (who[1:] != who[:-1])])  # a class counts once, however many rows it has
        four, who = four[new], who[new]
        again = np.zeros(len(four), bool)
        again[1:] = four[1:] == four[:-1]
        again[:-1] |= again[1:]
        c, shared = np.unique(who[again], return_counts=True)
        to = (mix(c) % U(blocks)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        at = np.searchsorted(to[order], np.arange(blocks + 1))
        c, shared = c[order], shared[order].astype(np.uint32)
        full = np.flatnonzero(np.diff(at)).tolist()
        return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([c[at[x] : at[x + 1]].tobytes() + shared[at[x] : at[x + 1]].tobytes() for x in full], pa.binary())], ["block", "packed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for block, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                if block != now and held:
                    yield done(held)
                    held = []
                now, raw = block, x.as_buffer()
                n, m = (int(v) for v in np.frombuffer(raw, np.int64, 2))
                who = np.frombuffer(raw, U, m, 16)
                ref = np.frombuffer(raw, np.uint16 if m <= 1 << 16 else np.uint32, n, 16 + 8 * m + 4 * n)
                held.append((np.frombuffer(raw, np.uint32, n, 16 + 8 * m), who[ref]))
        if held:
            yield done(held)

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed counts, those of a block of classes in one partition, to (c, shared)."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        for x in batch.column(1):
            raw = x.as_buffer()
            n = raw.size // 12
            held.append((np.frombuffer(raw, U, n), np.frombuffer(raw, np.uint32, n, 8 * n)))
        if held:
            c, which = np.unique(np.concatenate([x[0] for x in held]), return_inverse=True)
            held = [(c, np.bincount(which, np.concatenate([x[1] for x in held])).astype(np.uint32))]
    for c, shared in held:
        yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)), pa.array(shared.astype(np.int64))], ["c", "shared"])


def _blocks(sizes: DataFrame) -> int:
    """Into how many blocks the elements of sets of sizes n are dealt: as many as their number asks for, so what a task holds does not grow with it."""
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return max(partitions(sizes.sparkSession), -(-int(total) // BLOCK))


def _families(texts: DataFrame, k: int, percent: int, blocks: int) -> DataFrame:
    """(node, component): the family of every class of ``texts`` (text) that shares a signature with another."""
    packed = texts.mapInArrow(released(_sets_of(k, percent, blocks)), "block int, packed binary")
    return components(packed.repartitionById(blocks, "block").mapInArrow(released(_ties), "a long, b long"), done=True)


def _supported(texts: DataFrame, big: DataFrame, k: int, percent: int) -> DataFrame:
    """``big`` (c, n, ...), members of large families, with ``share``, how many of a set's elements are in another set of ``texts``, and without those
    sets that can't have a partner. Elements that share a hash are counted as one, which keeps sets but drops none."""
    blocks = _blocks(big)
    dealt = texts.mapInArrow(released(_dealt(k, blocks)), "block int, packed binary")
    counted = dealt.repartitionById(blocks, "block").mapInArrow(released(_counted(blocks)), "block int, packed binary")
    shared = counted.repartitionById(blocks, "block").mapInArrow(released(_summed), "c long, shared long")
    return big.join(shared, "c").where(F.col("shared") * 100 >= percent * F.col("n")).withColumn("share", F.col("shared") / F.col("n")).drop("shared")


def _chunked(rows: DataFrame, by: list[str], chunk: int) -> DataFrame:
    """``rows`` with the number of chunks of their group, which have about ``chunk`` sets and ``ELEMENTS`` elements at most, and theirs."""
    sizes = rows.groupBy(*by).agg(F.ceil(F.greatest(F.count("*") / chunk, F.sum("n") / ELEMENTS)).cast("int").alias("chunks"))
    return rows.join(sizes, by).withColumn("chunk", F.pmod(F.xxhash64("c"), F.col("chunks")).cast("int"))


_GROUP = ["family", "i", "j"]


def _linked(rows: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) of classes in each group of rows (family, i, j, side, label, c, text)."""
    rows = rows.select(*_GROUP, "side", "label", "c", "text")
    return rows.repartition(partitions(rows.sparkSession), *_GROUP).sortWithinPartitions(*_GROUP).mapInArrow(released(_search(k, percent)), "a long, b long")


def _links(docs: DataFrame, member: DataFrame, k: int, percent: int, chunk: int) -> tuple[DataFrame, int]:
    """Links that connect the classes of ``member`` (c, d, n, k, family) exactly as all linked pairs do, stored, and their number."""
    alone = lambda rows: rows.select("family", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"), F.col("c").alias("label"), "c", "text")
    sizes = lambda rows: rows.groupBy("family").agg(((F.count("*") > chunk) | (F.sum("n") > ELEMENTS)).alias("large"))
    member, n = counted(member.join(sizes(member), "family"), "members", "large")
    some = member
    if n:  # else there is no large family
        big = member.where("large")
        some = cut(_supported(among(docs, "k", big.select("k")).select("text"), big, k, percent).drop("share").unionByName(member.where("not large")), "some")

    near = among(docs, "k", some.select("k")).select("k", "text")  # other texts stay where they are
    near = near.mapInArrow(released(_sized(k, True)), "k string, text string, n long, c long, d long").drop("n")  # a key may have several texts
    one = [F.first(x).alias(x) for x in ("n", "family", "large", "text")]  # and several rows of one text
    held, n = counted(near.join(some, ["k", "c", "d"]).groupBy("k", "c", "d").agg(*one), "texts", "large")
    if not n:
        return counted(_linked(alone(held), k, percent), "links")

    # without the sets that were dropped, what chained large families together is mostly gone: their rest is routed once more
    texts = held.where("large").select("c", "n", "text")
    again = texts.select("c", "n").join(_families(texts.select("text"), k, percent, _blocks(texts)), F.col("c") == F.col("node")).select("c", "n", F.col("component").alias("family"))
    again, n = counted(again.join(sizes(again), "family"), "members", "large")
    if not n:
        small = held.where("not large").select("family", "c", "text").unionByName(texts.select("c", "text").join(again.select("c", "family"), "c").select("family", "c", "text"))
        return counted(_linked(alone(small), k, percent), "links")
    big = cut(_supported(texts.select("text"), again.where("large"), k, percent), "supported")
    hubs = big.groupBy("family").agg(F.max_by("c", F.struct("share", "c")).alias("hub"))
    dealt = _chunked(big, ["family"], chunk).join(hubs, "family").select("c", "n", "family", "chunk", "chunks", "hub")
    dealt = again.where("not large").select("c", "n", "family", F.lit(0).alias("chunk"), F.lit(1).alias("chunks"), F.lit(None).cast("long").alias("hub")).unionByName(dealt)
    dealt = cut(texts.select("c", "text").join(dealt, "c"), "dealt")
    every = F.expr("explode(if(c = hub, sequence(0, chunks - 1), array(chunk)))")
    first = held.where("not large").select("c", "text", "family", F.lit(0).alias("i")).unionByName(dealt.select("c", "text", "family", every.alias("i")))
    links, n = counted(_linked(first.select("family", "i", F.col("i").alias("j"), F.lit(0).alias("side"), F.col("c").alias("label"), "c", "text"), k, percent), "links")

    # what the largest component of a large family leaves out meets all its chunks
    dealt = dealt.where("hub is not null").select("c", "n", "family", "text")
    told = dealt.select("c", "n", "family").join(components(links, size=n), F.col("c") == F.col("node"), "left").select("c", "n", "family", F.coalesce("component", "c").alias("label"))
    told = cut(told, "labels")
    most = told.groupBy("family", "label").agg(F.count("*").alias("size")).groupBy("family").agg(F.max_by("label", F.struct("size", "label")).alias("most"), F.count("*").alias("labels"))
    told = told.join(most.where("labels > 1"), "family").select("c", "n", "family", "label", (F.col("label") != F.col("most")).alias("rest"))
    told, left = counted(_chunked(told, ["family", "rest"], 4 * chunk), "rest", "rest")
    if not left:
        return links, n
    ends = told.groupBy("family").agg(F.max(F.when(F.col("rest"), F.col("chunks"))).alias("rests"), F.max(F.when(~F.col("rest"), F.col("chunks"))).alias("mains"))
    told = told.join(ends, "family").select("c", "label", "rest", F.when(F.col("rest"), F.col("chunk")).otherwise(F.col("chunk") + F.col("rests")).alias("x"), "rests", (F.col("rests") + F.col("mains")).alias("all"))
    other = F.expr("explode(sequence(0, if(rest, all, rests) - 1))")
    met = dealt.drop("n").join(told, "c").withColumn("o", other)
    met = met.select("family", F.least("x", "o").alias("i"), F.greatest("x", "o").alias("j"), (F.col("x") > F.col("o")).cast("int").alias("side"), "label", "c", "text")
    more, m = counted(_linked(met, k, percent), "links")
    return links.unionByName(more), n + m


def _key(key: str, text: str) -> Column:
    """A row's key as text, or a name from the text where it has none."""
    return F.coalesce(F.col(key).cast("long").cast("string"), F.concat(F.lit("~"), F.xxhash64(F.col(text).cast("string")).cast("string")))


def resolved(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80, chunk: int = CHUNK) -> DataFrame:
    """(k, doc_id, n, c, d, component_id, first) for every row of ``docs``: its key as text, the size and name of its set, the smallest key
    of its component, and whether it is the component's first, that is, has this key and the first set of this key."""
    docs = docs.select(_key(key, text).alias("k"), F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    sized = cut(docs.mapInArrow(released(_sized(k)), "k string, doc_id long, n long, c long, d long"), "sized")
    head = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k")).alias("head")
    reps = cut(sized.where("n > 0").groupBy("c", "d", "n").agg(head), "classes")

    member = reps.join(_families(docs.select("text"), k, percent, _blocks(sized)), F.col("c") == F.col("node")).select("c", "d", "n", F.col("head.k").alias("k"), F.col("component").alias("family"))
    links, n = _links(docs, member, k, percent, chunk)
    tops = components(links, size=n)

    rooted = cut(reps.join(tops, F.col("c") == F.col("node"), "left").select("c", "d", "n", "head", F.coalesce("component", "c").alias("root")), "rooted")
    heads = rooted.groupBy("root").agg(F.min(F.struct("head", "c", "d")).alias("least"))
    own = (F.col("c") == F.col("least.c")) & (F.col("d") == F.col("least.d"))
    named = rooted.join(heads, "root").select("c", "d", "n", F.col("least.head.doc_id").alias("component_id"), F.when(own, F.col("least.head.k")).alias("kept"))
    out = sized.join(named, ["c", "d", "n"], "left")
    return out.select("k", "doc_id", "n", "c", "d", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), ((F.col("n") == 0) | F.coalesce(F.col("kept") == F.col("k"), F.lit(False))).alias("first"))


def similar(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``: components of the documents whose sets of distinct k-word
    shingles have a Jaccard similarity of ``percent`` or more, named by their smallest key."""
    return resolved(docs, key, text, k, percent, chunk).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, with one row of each component: that of its smallest key. Of several rows with this key and set the one
    that comes first as JSON stays; rows with empty sets all stay. Texts are shuffled only where several rows share a key."""
    found = cut(resolved(docs, key, text, k, percent), "found")
    keys = cut(found.groupBy("k").agg(F.count("*").alias("rows"), F.count_if("first").alias("firsts"), F.count_if(F.col("n") > 0).alias("full")), "keys")
    stay = (F.col("firsts") == F.col("rows")) & ((F.col("rows") == 1) | (F.col("full") == 0))
    name = fresh(docs, "_k")
    marked = docs.withColumn(name, _key(key, text))
    kept = without(marked, name, keys.where(~stay).select("k"))
    mixed = keys.where(~stay & (F.col("firsts") > 0)).select(F.col("k").alias(name))
    some = among(marked, name, mixed).join(mixed, name)  # a semi join would be moved below the filter, to all rows
    rows = some.select(F.struct(*docs.columns).alias("row"), F.col(name).alias("k"), F.col(text).cast("string").alias("text"))
    sets = rows.mapInArrow(released(_sized(k)), rows.drop("text").schema.add("n", "long").add("c", "long").add("d", "long"))
    good = found.where("first and n > 0").select("k", "c", "d").distinct()
    one = sets.where("n > 0").join(good, ["k", "c", "d"], "left_semi").groupBy("k", "c", "d").agg(F.min_by("row", F.to_json("row")).alias("row"))
    rest = one.select("row.*").unionByName(sets.where("n = 0").select("row.*"))
    return kept.select(docs.columns).unionByName(rest.select(docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: components of all documents at three words and 0.9."""
    return similar(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=3, percent=90)
