"""Benchmark decontamination over a distributed positional inverted index.

Index. Texts are dealt into shards of a few megabytes; a shard is one row of the stored index: its terms, their ascending positions, and its documents. Positions
run through the shard, with a gap between documents, so that no phrase crosses one. Only terms that test items may hold are stored: a
bit for each hash of an item's term, 8 MB at most whatever the number of items, goes to all tasks.

Search. Test items come in blocks of bounded size; one at a time is on the driver and broadcast. A phrase is anchored at the term that the fewest phrases of its block
hold; a shard looks at the phrases whose anchors it has, and of these at those all of whose terms it has. From the rarest of its terms on, the shard shifts the
term's list by its offset and keeps what the other lists, rarest first, hold at theirs; what is left are exact starts. Proximity search keeps
positions of the rarest term that have every other term near, then takes spans that hold every term.

Words are maximal runs of ASCII letters, digits and all characters beyond ASCII, A-Z folded. Null and empty texts have
no words; an item without words is found nowhere; repeated items and rows each count as themselves; without items no document is hit, without
documents the result is empty. Columns other than keys and texts are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.words import NOT_ALNUM, column, groups, words
from factloom.shared import cut, fresh, released, without

U = np.uint64
#: Words of a window, windows of a block of test items, words that hold a window that is only near.
WINDOW, BLOCK, SLOP = 10, 200_000, 15
GAP = 64
#: Bits of the filter of terms, and of one of its pages.
BITS, PAGE = 1 << 26, 1 << 15
NAMES = ["terms", "counts", "positions", "row", "doc_id", "n_words", "start"]


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        h = words(*column(batch.column(0)), NOT_ALNUM)[2]
        yield pa.RecordBatch.from_arrays([pa.array((np.unique(h) % U(BITS)).view(np.int64))], ["spot"])


def vocabulary(items: DataFrame, text: str = "text") -> np.ndarray:
    """A bit for each hash of a term of ``items``, packed: BITS bits."""
    spots = items.select(F.col(text).cast("string")).mapInArrow(released(_terms), "spot long")
    pages = spots.groupBy(F.expr(f"spot div {PAGE}").alias("page")).agg(F.bitmap_construct_agg(F.col("spot") % PAGE).alias("bits"))
    out = np.zeros(BITS // 8, np.uint8)
    for r in pages.toLocalIterator():  # 2048 pages of 4 KB at most
        out[r["page"] * PAGE // 8 : (r["page"] + 1) * PAGE // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def _postings(known, gap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, row = known.value, TaskContext.get().partitionId() << 40
        for batch in batches:
            data, offs = column(batch.column(1))
            for i, j in groups(offs):
                _, _, h, at = words(data, offs[i : j + 1], NOT_ALNUM)
                n = np.diff(at)
                begin = at[:-1] + gap * np.arange(len(n))
                place = np.arange(len(h)) + gap * np.repeat(np.arange(len(n)), n)
                spot = h % U(BITS)
                keep = np.flatnonzero(bits[spot >> U(3)] >> (spot & U(7)).astype(np.uint8) & 1)
                keep = keep[np.argsort(h[keep], kind="stable")]
                terms, counts = np.unique(h[keep], return_counts=True)
                packed = [x.tobytes() for x in (terms, counts.astype(np.uint32), place[keep].astype(np.uint32))]
                whole = lambda x: pa.ListArray.from_arrays(pa.array([0, len(n)], pa.int32()), x)
                docs = [pa.array(np.arange(row, row + len(n))), batch.column(0).slice(i, j - i), pa.array(n), pa.array(begin)]
                yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.binary()) for x in packed), *map(whole, docs)], NAMES)
                row += len(n)

    return run


def index(docs: DataFrame, known: np.ndarray, key: str = "doc_id", text: str = "text", gap: int = GAP) -> DataFrame:
    """The stored index of ``docs``, of the terms whose bit is in ``known`` (see ``vocabulary``): a row a shard."""
    held = docs.sparkSession.sparkContext.broadcast(known)
    kind = docs.schema[key].dataType.simpleString()
    form = f"terms binary, counts binary, positions binary, row array<long>, doc_id array<{kind}>, n_words array<long>, start array<long>"
    return cut(docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(released(_postings(held, gap)), form), "postings")


class Shard:
    """Postings and documents of one shard, in memory."""

    def __init__(self, terms: np.ndarray, counts: np.ndarray, positions: np.ndarray, row: np.ndarray, start: np.ndarray):
        self.terms, self.positions, self.row, self.start = terms, positions.astype(np.int64), row, start
        self.ends = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])

    def places(self, terms: np.ndarray) -> np.ndarray:
        """The number of each term in this shard, -1 for terms that it lacks."""
        at = np.minimum(np.searchsorted(self.terms, terms), max(0, len(self.terms) - 1))
        return np.where(self.terms[at] == terms, at, -1) if len(self.terms) else np.full(len(terms), -1)

    def list(self, place: int) -> np.ndarray:
        return self.positions[self.ends[place] : self.ends[place + 1]]

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.start, at, "right") - 1

    def phrase(self, places: list[int]) -> np.ndarray:
        """Ascending positions at which the terms stand one after the other."""
        order = sorted(range(len(places)), key=lambda k: self.ends[places[k] + 1] - self.ends[places[k]])
        at = self.list(places[order[0]]) - order[0]
        for k in order[1:]:
            if not len(at):
                break
            own = self.list(places[k])
            spot = np.searchsorted(own, at + k)
            at = at[(spot < len(own)) & (own[np.minimum(spot, len(own) - 1)] == at + k)]
        return at

    def near(self, places: list[int], slop: int) -> np.ndarray:
        """Documents (numbers in this shard) in which ``slop`` consecutive words hold all terms, in any order."""
        order = sorted(set(places), key=lambda p: self.ends[p + 1] - self.ends[p])
        at = self.list(order[0])
        for p in order[1:]:
            if not len(at):
                return np.zeros(0, np.int64)
            own = self.list(p)
            spot = np.searchsorted(own, at - slop + 1)  # the first at or after the earliest place that is near enough
            at = at[(spot < len(own)) & (own[np.minimum(spot, len(own) - 1)] < at + slop)]
        out = set()
        for x in at.tolist():
            kinds = np.concatenate([np.full(b - a, q) for q, (a, b) in enumerate(np.searchsorted(self.list(p), [x - slop + 1, x + slop]) for p in order)])
            spots = np.concatenate([self.list(p)[slice(*np.searchsorted(self.list(p), [x - slop + 1, x + slop]))] for p in order])
            last = [-slop] * len(order)
            for k in np.argsort(spots, kind="stable"):
                last[kinds[k]] = int(spots[k])
                if spots[k] - min(last) < slop:
                    out.add(int(self.doc_of(np.array([x]))[0]))
                    break
        return np.array(sorted(out), np.int64)


class Block:
    """Phrases of a block of items: their terms, the items of each, and the phrases that are anchored at each term."""

    def __init__(self, ids: list[str], phrases: list[list[tuple]]):
        of: dict[tuple, list[str]] = {}
        for i, own in zip(ids, phrases):
            for p in own:
                of.setdefault(p, []).append(i)
        self.items, self.wide = list(of.values()), np.array([len(p) for p in of], np.int64)
        flat = np.array([t for p in of for t in p], np.int64).view(U)
        self.terms, self.which = np.unique(flat, return_inverse=True)
        self.at = np.concatenate([[0], np.cumsum(self.wide)])
        often = np.bincount(self.which, minlength=len(self.terms))[self.which]
        phrase = np.repeat(np.arange(len(self.wide)), self.wide)
        first = np.lexsort((often, phrase))[self.at[:-1]] if len(self.wide) else np.zeros(0, np.int64)
        self.order = np.argsort(self.which[first], kind="stable")  # phrases by anchor
        self.bounds = np.searchsorted(self.which[first][self.order], np.arange(len(self.terms) + 1))

    def within(self, shard: Shard) -> Iterator[tuple[int, list[int]]]:
        """(phrase, the numbers of its terms in the shard) of every phrase all of whose terms the shard has."""
        place = shard.places(self.terms)
        for t in np.flatnonzero((place >= 0) & (self.bounds[1:] > self.bounds[:-1])).tolist():
            for p in self.order[self.bounds[t] : self.bounds[t + 1]].tolist():
                own = place[self.which[self.at[p] : self.at[p + 1]]]
                if (own >= 0).all():
                    yield p, own.tolist()


def blocks(items: DataFrame, window: int | None = WINDOW, key: str = "item_id", text: str = "text") -> Iterator[Block]:
    """Blocks of items: windows of an item's words, or all its words as one phrase if ``window`` is null."""
    ids, phrases, n = [], [], 0
    for r in items.select(F.col(key).cast("string").alias("i"), F.col(text).cast("string").alias("t")).toLocalIterator():
        h = words(*column(pa.array([r["t"]], pa.string())), NOT_ALNUM)[2].view(np.int64).tolist()
        if not h:
            continue
        wide = min(window or len(h), len(h))
        own = list(dict.fromkeys(tuple(h[k : k + wide]) for k in range(len(h) - wide + 1)))
        ids.append(r["i"])
        phrases.append(own)
        n += len(own)
        if n >= BLOCK:
            yield Block(ids, phrases)
            ids, phrases, n = [], [], 0
    if ids:
        yield Block(ids, phrases)


FOUND = "row long, start long, wide long, item_id string"


def _match(held, slop: int | None):
    """Shards to occurrences: starts and widths of exact ones; with ``slop``, also documents that have a phrase near, with null for both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = held.value
        for batch in batches:
            for k in range(len(batch)):
                raw = [np.frombuffer(batch.column(c)[k].as_buffer(), t) for c, t in ((0, U), (1, np.uint32), (2, np.uint32))]
                shard = Shard(*raw, *(batch.column(c)[k].values.to_numpy() for c in (3, 4)))
                rows: list[tuple] = []
                for p, places in block.within(shard):
                    at = shard.phrase(places)
                    for x, d in zip(at.tolist(), shard.doc_of(at).tolist()):
                        rows += [(int(shard.row[d]), x, int(block.wide[p]), i) for i in block.items[p]]
                    for d in shard.near(places, max(slop, len(places))).tolist() if slop else ():
                        rows += [(int(shard.row[d]), None, None, i) for i in block.items[p]]
                cols = list(zip(*rows)) if rows else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["row", "start", "wide", "item_id"])

    return run


def find(docs: DataFrame, items: DataFrame, window: int | None = WINDOW, key: str = "doc_id", text: str = "text", slop: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, occurrences): (row, doc_id, n_words) of every row of ``docs``, and (row, start, wide, item_id) for every
    exact occurrence of a window of an item; starts count words through the row's shard. With ``slop``, also (row, null, null, item_id) where
    that many consecutive words hold all words of a window."""
    spark = docs.sparkSession
    stored = index(docs, vocabulary(items), key, text, max(GAP, slop or 0))
    shards = stored.select("terms", "counts", "positions", "row", "start")
    found = spark.createDataFrame([], FOUND)
    for block in blocks(items, window):
        held = spark.sparkContext.broadcast(block)
        found = found.unionByName(cut(shards.mapInArrow(released(_match(held, slop)), FOUND), "found"))
        held.destroy()
    every = stored.select(F.explode(F.arrays_zip("row", "doc_id", "n_words")).alias("x")).select("x.*")
    return every, found


def near(docs: DataFrame, items: DataFrame, slop: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id) where ``slop`` consecutive words of a document (or as many as the item has, if more) hold all words of an item, in any order."""
    every, found = find(docs, items, None, key, text, slop)
    return every.join(found.where("start is null").select("row", "item_id").distinct(), "row").select("doc_id", "item_id")


def _covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (row, spans, items, n_near) to (row, n_hit, n_items, items_sha256, n_near)."""
    for batch in batches:
        out = []
        for row, spans, items, n_near in zip(*(batch.column(i).to_pylist() for i in range(4))):
            n, upto = 0, -1
            for s, w in sorted((x["start"], x["wide"]) for x in spans):
                n += max(0, s + w - max(s, upto))
                upto = max(upto, s + w)
            out.append((row, n, len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), n_near))
        cols = list(zip(*out)) if out else [[]] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["row", "n_hit", "n_items", "items_sha256", "n_near"])


def mark(docs: DataFrame, items: DataFrame, window: int = WINDOW, slop: int | None = SLOP) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near) for every row of ``docs``; n_near counts the items of which
    ``slop`` consecutive words of the document hold all words of a window, exact occurrences among them."""
    every, found = find(docs, items, window, slop=slop)
    exact = F.when(F.col("start").isNotNull(), F.struct("start", "wide"))
    own = found.groupBy("row").agg(F.collect_set(exact).alias("spans"), F.collect_set(F.when(exact.isNotNull(), F.col("item_id"))).alias("items"), F.size(F.collect_set("item_id")).cast("long").alias("n_near"))
    hits = own.mapInArrow(released(_covered), "row long, n_hit long, n_items long, items_sha256 string, n_near long")
    count = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return every.join(hits, "row", "left").select("doc_id", "n_words", count("n_hit").alias("n_hit"), count("n_items").alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (count("n_hit") > 0).alias("contaminated"), count("n_near").alias("n_near"))


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, in which no window of an item occurs. Rows are told apart by key and text, so a null or repeated key decides nothing."""
    name = fresh(docs, "_k")
    marked = docs.withColumn(name, F.concat(F.coalesce(F.col(key).cast("string"), F.lit("~")), F.lit(":"), F.xxhash64(F.col(text).cast("string")).cast("string")))
    every, found = find(marked, items, window, name, text)
    hit = cut(every.join(found.select("row").distinct(), "row").select("doc_id").distinct(), "leaks")
    return without(marked, name, hit).select(docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: every document against every benchmark item."""
    return mark(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), slop=None).drop("n_near")


def near_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that a document holds word for word (n_items) and near (n_near), for every document."""
    found = mark(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_items", "n_near")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, w, least({WINDOW}, len(w)) AS n FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
p AS (SELECT DISTINCT item_id, n, list_slice(w, i, i + n - 1) AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM b)),
q AS (SELECT doc_id, n, i, list_slice(w, i, i + n - 1) AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM b) WHERE len(w) >= n)),
m AS (SELECT q.doc_id, q.i, q.n, p.item_id FROM q JOIN p ON q.n = p.n AND q.g = p.g),
h AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS x FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
