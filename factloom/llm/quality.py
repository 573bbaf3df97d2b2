"""Quality classifier: random-indexing word vectors pooled by document, then a two-layer network in numpy.

Random indexing. Every word has an index vector, a few +1 and -1 at places that its hash names. The vector of a word is
the sum of the index vectors of the words around it, over the fitting sample, scaled to unit length; a word that the sample
lacks has its own index vector, so any text has vectors. Words are taken as they are written; beside each word stands its
shape (runs of upper case, lower case, digits, other ASCII and non-ASCII bytes), treated as a word of a second vocabulary. A document is
the means of its word vectors and of its shape vectors, with their lengths, which tell repetition.

Network. A hidden layer of tanh units and a sigmoid, fitted with Adam on standardised features, classes weighted equally;
a fifth of the sample is kept back to choose the temperature that makes probabilities fit. The sample is at most ``EACH``
labelled rows a label; every text is scored whole. Without labels of both kinds every score is 0.5, and so is nothing else decided: 0.5
counts as accepted. Null and empty texts have zero vectors and are scored like any other.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from factloom.llm.sampling import draw, fitted, labelled
from factloom.llm.words import WHITE, column, groups, mix, words
from factloom.shared import fresh, released

U = np.uint64
#: Labelled rows a label, dimensions, places of an index vector, words with vectors at most, words on each side, hidden units.
EACH, DIM, PLACES, VOCABULARY, SIDE, HIDDEN = 1200, 64, 6, 1 << 14, 2, 24
_SLOTS = 1 << 18
_KIND = np.full(256, ord("n"), np.uint8)
for _b in range(128):
    _c = chr(_b)
    _KIND[_b] = _b if WHITE[_b] else ord("A") if _c.isupper() else ord("a") if _c.islower() else ord("0") if _c.isdigit() else _b if _c in ".,;:'-" else ord("#")


def index_vectors(h: np.ndarray) -> np.ndarray:
    out = np.zeros((len(h), DIM), np.float32)
    bits = mix(h)
    for p in range(PLACES):
        bits = mix(bits + U(p + 1))
        out[np.arange(len(h)), (bits >> U(40)).astype(np.int64) % DIM] += np.where(bits & U(1), 1, -1).astype(np.float32)
    return out / np.float32(np.sqrt(PLACES))


def shapes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word's shape, rows), in the order of the words."""
    base = int(offs[0])
    kind = _KIND[data[base : int(offs[-1])]]
    keep = np.ones(len(kind), bool)
    keep[1:] = kind[1:] != kind[:-1]
    at = offs - base
    keep[at[:-1][at[:-1] < len(kind)]] = True  # a text's first byte is never a run's rest
    count = np.concatenate([[0], np.cumsum(keep)])
    _, _, h, rows = words(kind[keep], count[at], WHITE, False)
    return h, rows


class Vectors:
    """Word vectors by hash; a word without one has its index vector."""

    def __init__(self, h: np.ndarray, rows: np.ndarray):
        kinds, which, counts = np.unique(h, return_inverse=True, return_counts=True)
        best = np.argsort(-counts, kind="stable")[:VOCABULARY]
        place = np.full(len(kinds), -1)
        place[best] = np.arange(len(best))
        sums = np.zeros((len(best), DIM), np.float32)
        text = np.searchsorted(rows, np.arange(len(h)), "right")
        for d in range(1, SIDE + 1):
            for a, b in ((slice(None, -d), slice(d, None)), (slice(d, None), slice(None, -d))):
                same = text[a] == text[b]
                into, what = place[which[a][same]], which[b][same]
                into, what = into[into >= 0], what[into >= 0]
                pair, n = np.unique(into.astype(np.int64) * len(kinds) + what, return_counts=True)
                into, what = pair // max(1, len(kinds)), pair % max(1, len(kinds))
                for i in range(0, len(into), 1 << 14):
                    part = slice(i, i + (1 << 14))
                    head = np.flatnonzero(np.concatenate([[True], np.diff(into[part]) != 0]))
                    sums[into[part][head]] += np.add.reduceat(index_vectors(kinds[what[part]]) * np.log1p(n[part])[:, None].astype(np.float32), head, axis=0)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        own = index_vectors(kinds[best])
        sums = np.where(norm > 0, sums / np.maximum(norm, 1e-9), own)
        if not len(best):  # nothing to learn from: a vector for a hash that no word is likely to have
            kinds, best, sums, own = np.zeros(1, U), np.zeros(1, np.int64), np.zeros((1, DIM), np.float32), np.zeros((1, DIM), np.float32)
        self.vectors, self.own = sums.astype(np.float32), own
        # a slot for most words, and a short sorted list of those whose slot another one has
        self.keys, self.table = np.zeros(_SLOTS, U), np.zeros(_SLOTS, np.int32)
        slot = (kinds[best] % U(_SLOTS)).astype(np.int64)
        self.keys[slot], self.table[slot] = kinds[best], np.arange(len(best), dtype=np.int32)
        away = np.flatnonzero(self.keys[slot] != kinds[best])
        self.away = away[np.argsort(kinds[best][away])].astype(np.int32)
        self.away_keys = kinds[best][self.away]

    def places(self, h: np.ndarray) -> np.ndarray:
        """The number of each word, -1 for words without a vector."""
        slot = (h % U(_SLOTS)).astype(np.int64)
        out = np.where(self.keys[slot] == h, self.table[slot], -1)
        rest = np.flatnonzero(out < 0)
        if len(rest) and len(self.away):
            spot = np.minimum(np.searchsorted(self.away_keys, h[rest]), len(self.away) - 1)
            out[rest] = np.where(self.away_keys[spot] == h[rest], self.away[spot], -1)
        return out

    def pooled(self, h: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Mean vector of each text and its length, and the length of the mean index vector; zero for no words."""
        out = np.zeros((len(rows) - 1, DIM + 2), np.float32)
        place = self.places(h)
        for i in np.flatnonzero(rows[1:] > rows[:-1]):
            raw = np.zeros(DIM, np.float32)
            for a in range(rows[i], rows[i + 1], 1 << 16):
                own = place[a : min(rows[i + 1], a + (1 << 16))]
                n = np.bincount(own[own >= 0])
                use = np.flatnonzero(n)
                if len(use):
                    out[i, :DIM] += n[use].astype(np.float32) @ self.vectors[use]
                    raw += n[use].astype(np.float32) @ self.own[use]
                rest = h[a : a + len(own)][own < 0]
                if len(rest):
                    more = index_vectors(rest).sum(0)
                    out[i, :DIM] += more
                    raw += more
            out[i, DIM + 1] = np.log(1 + raw @ raw / (rows[i + 1] - rows[i]))  # 1 + words a distinct word
        out[:, :DIM] /= np.maximum(1, np.diff(rows))[:, None]
        out[:, DIM] = np.linalg.norm(out[:, :DIM], axis=1)
        return out


@dataclass
class Model:
    words: Vectors
    shapes: Vectors
    mean: np.ndarray
    scale: np.ndarray
    layers: tuple
    temperature: float

    def pooled(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        _, _, h, rows = words(data, offs, WHITE, False)
        return np.concatenate([self.words.pooled(h, rows), self.shapes.pooled(*shapes(data, offs)), np.log1p(np.diff(rows))[:, None].astype(np.float32)], 1)

    def score(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        x = (self.pooled(data, offs) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(logits(self.layers, x) / self.temperature, -30, 30)))


def logits(layers: tuple, x: np.ndarray) -> np.ndarray:
    w1, b1, w2, b2 = layers
    return np.tanh(x @ w1 + b1) @ w2 + b2


def network(x: np.ndarray, y: np.ndarray, epochs: int = 60, rate: float = 0.004, decay: float = 1e-3) -> tuple:
    """Weights of the two layers, fitted on x and y in {0, 1}."""
    draw = np.random.default_rng(11)
    p = [draw.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), draw.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    for _ in range(epochs):
        order = draw.permutation(len(y))
        for k in range(0, len(order), 64):
            i = order[k : k + 64]
            a = np.tanh(x[i] @ p[0] + p[1])
            e = (1 / (1 + np.exp(-np.clip(a @ p[2] + p[3], -30, 30))) - y[i]) * weight[i] / len(i)
            back = np.outer(e, p[2]) * (1 - a * a)
            grads = [x[i].T @ back + decay * p[0], back.sum(0), a.T @ e + decay * p[2], np.array([e.sum()])]
            t += 1
            for q, g in enumerate(grads):
                m[q], v[q] = 0.9 * m[q] + 0.1 * g, 0.999 * v[q] + 0.001 * g * g
                p[q] = p[q] - rate * (m[q] / (1 - 0.9**t)) / (np.sqrt(v[q] / (1 - 0.999**t)) + 1e-8)
    return tuple(p)


def temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits with the least log loss."""
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
    loss = [np.mean(np.logaddexp(0, z / t) - y * z / t) for t in grid]
    return float(grid[int(np.argmin(loss))]) if len(z) else 1.0


def fit(labels: list[int], texts: pa.Array) -> Model | None:
    """The model of a sample; none without labels of both kinds."""
    y = np.array(labels, float)
    if len(set(labels)) < 2:
        return None
    data, offs = column(texts)
    model = Model(Vectors(*words(data, offs, WHITE, False)[2:]), Vectors(*shapes(data, offs)), np.zeros(1), np.ones(1), (), 1.0)
    x = model.pooled(data, offs)
    back = np.arange(len(y)) % 5 == 4
    model.mean, model.scale = x[~back].mean(0), x[~back].std(0) + 1e-3
    x = (x - model.mean) / model.scale
    model.layers = network(x[~back], y[~back])
    model.temperature = temperature(logits(model.layers, x[back]), y[back])
    return model


def classify(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, with ``score`` and ``predicted`` (a column of such a name is replaced)."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop("score", "predicted")
    at = kept.columns.index(text)
    names = [*kept.columns, "score", "predicted"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = column(batch.column(at))
            for i, j in groups(offs, 2 << 20):
                score = held.value.score(data, offs[i : j + 1]).astype(float) if held.value is not None else np.full(j - i, 0.5)
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in batch.columns), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names)

    return kept.mapInArrow(released(run), StructType(list(kept.schema.fields)).add("score", "double").add("predicted", "integer"))


def accepted(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, that the model accepts."""
    clash = [c for c in docs.columns if c.lower() in ("score", "predicted")]
    away = {c: fresh(docs, f"_{c}") for c in clash}
    good = classify(docs.withColumnsRenamed(away), model, text).where("predicted = 1").drop("score", "predicted")
    return good.withColumnsRenamed({v: k for k, v in away.items()}).select(docs.columns)


def held_out():
    """Rows that no fit sees: those whose crc32 of the key as text leaves 1 when divided by 3."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, each: int = EACH) -> Model | None:
    """A model from the labelled rows of ``docs`` that are not held out."""
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where(F.col("quality").isin(0, 1) & ~held_out())
    drawn = draw(known, F.col("quality"), "doc_id", each)[0].groupBy(F.col("doc_id").alias("i")).agg(F.min("quality").alias("quality"))
    # about `each` keys for each of two labels, so small enough for every worker: the texts stay where they are
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), F.col("doc_id") == F.col("i"))
    return fitted(labelled(rows, F.col("quality"), each=2 * each), fit)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: the quality of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return classify(docs.withColumn("held_out", held_out()), model).select("doc_id", "held_out", "score", "predicted")
