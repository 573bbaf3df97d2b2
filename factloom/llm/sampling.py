"""Bounded samples of labelled texts for fitting, drawn by hash so that reruns agree."""

from __future__ import annotations

import pickle

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.shared import released


def draw(rows: DataFrame, label: Column, key: str, each: int) -> tuple[DataFrame, int]:
    """The rows with ``label`` and ``u``, their place in 0..1 by the hash of their key: about ``each`` a label, all if there are fewer; the number of labels."""
    rows = rows.withColumns({"label": label, "u": F.xxhash64(F.lit("fit"), F.col(key)).bitwiseAND(F.lit((1 << 40) - 1)) / float(1 << 40)}).where("label is not null")
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}  # a row a label
    if not sizes:
        return rows.where("false"), 0
    share = F.create_map(*[F.lit(x) for k, n in sorted(sizes.items(), key=str) for x in (k, min(1.0, each / n))])[F.col("label")]
    return rows.where(F.col("u") < share), len(sizes)


def labelled(docs: DataFrame, label: Column, text: str = "text", key: str = "doc_id", each: int = 2000, most_bytes: int = 12 << 20) -> DataFrame:
    """(label, text, u) of about ``each`` keys a label, in order of the hash of the key as long as the texts before take less than the label's share of
    ``most_bytes``: the length of a text has no part in whether it is drawn, and every label has one text at least. Rows that share a key and
    label count as one, with the least of their texts; null texts are left out."""
    drawn, labels = draw(docs.where(F.col(text).isNotNull()), label, key, each)
    before = Window.partitionBy("label").orderBy("u").rowsBetween(Window.unboundedPreceding, -1)
    sized = drawn.groupBy("label", "u").agg(F.max(F.octet_length(text)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    ends = sized.where(F.col("before") < most_bytes / max(1, labels)).groupBy(F.col("label").alias("l")).agg(F.max("u").alias("end"))
    kept = drawn.join(F.broadcast(ends), (F.col("label") == F.col("l")) & (F.col("u") <= F.col("end")))  # ends: a row a label
    return kept.groupBy("label", "u").agg(F.min(text).alias("text")).select("label", "text", "u")


def fitted(sample: DataFrame, fit):
    """``fit(labels, texts)`` of a bounded sample (label, text, u), in order of u; it runs in one task, away from the driver."""

    def run(batches):
        held = list(batches)
        rows = pa.Table.from_batches(held).sort_by([("u", "ascending")]) if held else None
        model = fit(rows["label"].to_pylist(), rows["text"].combine_chunks()) if rows is not None else fit([], pa.array([], pa.string()))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    rows = sample.repartition(1).mapInArrow(released(run), "model binary").collect()  # none if Spark sees that the sample is empty
    return pickle.loads(rows[0]["model"]) if rows else fit([], pa.array([], pa.string()))
