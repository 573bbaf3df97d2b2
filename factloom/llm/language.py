"""Language identification in two steps: a family first, then one-versus-one linear support vector machines in it.

Features are counts of hashed byte sequences of two and three bytes of the case-folded text, with digits, marks and white space
as one separator, as shares of the text's sequences under a square root. The family machine and every pair of
languages of a family have a weight a feature and an offset, fitted by averaged subgradient descent on the hinge loss
with the sample's classes weighted equally. Families come from a table of related languages; a language that isn't in it is a
family of its own. A language wins its family by pairwise votes, ties by summed margins.

The fit sees a bounded sample (``EACH`` texts a language); every text is scored whole. Null and letterless texts are
``und`` with score 0, as are all texts if there is nothing to learn from.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.sampling import fitted, labelled
from factloom.llm.words import column, groups

#: Related languages; fixed values.
FAMILIES = {
    "germanic": "en de nl af sv da no nb nn is fy lb yi",
    "romance": "fr es it pt ca gl ro oc",
    "slavic": "ru uk be pl cs sk sl hr sr bs mk bg",
    "uralic": "fi et hu",
    "celtic": "ga gd cy br",
    "baltic": "lt lv",
    "indic": "hi ur bn mr ne pa gu",
    "turkic": "tr az kk uz ky",
    "semitic": "ar he mt am",
    "sinitic": "zh yue wuu",
}
OF = {code: name for name, codes in FAMILIES.items() for code in codes.split()}
EACH, FEATURES, ROUNDS = 600, 1 << 12, 16
#: Any letter, of any script; numbers and numeral signs are none.
LETTER = r"\p{L}"
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[:128] = [ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in range(128)]


def _codes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature of the sequence that ends at each byte, for two and three bytes; runs of separators are one."""
    f = _FOLD[data]
    f = f[np.concatenate([[True], (f[1:] != 32) | (f[:-1] != 32)])] if len(f) else f
    two = f[:-1] * np.uint32(257) + f[1:]
    three = two[:-1] * np.uint32(8191) + f[2:]
    turn = lambda x, salt: ((x * np.uint32(2654435761) + np.uint32(salt)) >> np.uint32(20)).astype(np.int64)
    return turn(two, 0x3C6EF372), turn(three, 0)


def features(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A row of FEATURES values of unit length for each text."""
    out = np.zeros((len(offs) - 1, FEATURES), np.float32)
    for i, (a, b) in enumerate(zip(offs[:-1], offs[1:])):
        for c in _codes(data[a:b]):
            if len(c):
                out[i] += np.bincount(c, minlength=FEATURES).astype(np.float32) / (2 * len(c))
    return np.sqrt(out)


def machine(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, rate: float = 0.5, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """(weights, offset) of a linear support vector machine for y in {-1, 1}, fitted in shuffled batches; averaged over the second half."""
    draw = np.random.default_rng(7)
    w, b, ws, bs, n = np.zeros(x.shape[1], np.float32), 0.0, np.zeros(x.shape[1]), 0.0, 0
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * len(y)
    for r in range(rounds):
        order = draw.permutation(len(y))
        step = rate / (1 + 0.2 * r)
        for k in range(0, len(order), 64):
            i = order[k : k + 64]
            wrong = y[i] * (x[i] @ w + b) < 1
            g = (y[i] * weight[i] * wrong).astype(np.float32)
            w = w * np.float32(1 - step * decay) + np.float32(step / len(i) * 8) * (g @ x[i])
            b += step * float(g.mean())
        if r >= rounds // 2:
            ws, bs, n = ws + w, bs + b, n + 1
    return (ws / n).astype(np.float32), bs / n


@dataclass
class Model:
    """Languages by family, a machine for each family against the rest, and one for each pair of languages of a family."""

    families: list[list[str]]
    weights: np.ndarray
    offsets: np.ndarray
    pairs: list[tuple[int, str, str]]

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        margin = x @ self.weights.T + self.offsets
        n = len(self.families)
        chosen = margin[:, :n].argmax(1) if n > 1 else np.zeros(len(x), np.int64)
        best = margin[:, :n].max(1) if n > 1 else np.full(len(x), 5.0)
        sure = 1 / (1 + np.exp(-3 * best.clip(-10, 10)))
        names = np.empty(len(x), object)
        score = sure.copy()
        for f, langs in enumerate(self.families):
            rows = np.flatnonzero(chosen == f)
            votes, sums = np.zeros((len(rows), len(langs))), np.zeros((len(rows), len(langs)))
            for k, (g, a, b) in enumerate(self.pairs):
                if g == f:
                    m = margin[rows, n + k]
                    for name, sign in ((a, 1), (b, -1)):
                        votes[:, langs.index(name)] += m * sign > 0
                        sums[:, langs.index(name)] += sign * m
            total = votes + np.tanh(sums) / 4
            win = total.argmax(1)
            names[rows] = np.array(langs, object)[win]
            if len(langs) > 1:
                score[rows] *= 1 / (1 + np.exp(-3 * (sums[np.arange(len(rows)), win] / (len(langs) - 1)).clip(-10, 10)))
        return names.tolist(), score


def fit(labels: list[str], texts: pa.Array) -> Model | None:
    """The machines for the languages of a sample; none if it is empty."""
    if not len(labels):
        return None
    langs = sorted(set(labels))
    families: dict[str, list[str]] = {}
    for x in langs:
        families.setdefault(OF.get(x, x), []).append(x)
    x, y = features(*_flat(texts)), np.array(labels, object)
    held = list(families.values())
    rows, offsets, pairs = [], [], []
    for own in held:
        inside = np.isin(y, own)
        w, b = machine(x, np.where(inside, 1.0, -1.0)) if len(held) > 1 else (np.zeros(FEATURES, np.float32), 0.0)
        rows.append(w)
        offsets.append(b)
    for f, own in enumerate(held):
        for a, b in itertools.combinations(own, 2):
            use = np.flatnonzero((y == a) | (y == b))
            w, o = machine(x[use], np.where(y[use] == a, 1.0, -1.0))
            rows.append(w)
            offsets.append(o)
            pairs.append((f, a, b))
    return Model(held, np.stack(rows), np.array(offsets), pairs)


def _flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offs = column(texts)
    return data[offs[0] : offs[-1]], offs - offs[0]


def identify(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, ``extra``, lang_pred, score) of every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", *extra, "lang_pred", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(batch.num_columns - 1)
            data, offs = column(col)
            for i, j in groups(offs, 2 << 20):
                for a in range(i, j, 256):
                    b = min(j, a + 256)
                    lang, score = ["und"] * (b - a), np.zeros(b - a)
                    if held.value is not None:
                        lang, score = held.value.predict(features(data, offs[a : b + 1]))
                    none = np.flatnonzero(~batch.column(batch.num_columns - 2).slice(a, b - a).to_numpy(zero_copy_only=False))
                    score[none] = 0.0
                    for k in none:
                        lang[k] = "und"
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in range(batch.num_columns - 2)), pa.array(lang, pa.string()), pa.array(score.astype(float))], names)

    lettered = F.coalesce(F.col(text).cast("string").rlike(LETTER), F.lit(False))
    kept = docs.select(F.col(key).alias("doc_id"), *extra, lettered.alias("lettered"), F.col(text).cast("string").alias("text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-2])
    return kept.mapInArrow(run, f"{kinds}, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: the language of every document, learnt from those that are not held out."""
    part = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", (part == 2).alias("held_out"))
    model = fitted(labelled(docs.where("not held_out"), F.col("lang"), each=EACH), fit)
    return identify(docs, model, extra=("held_out",))
