"""Sentences that arrive as files become mentions once: a stream that remembers the sentences it has seen in keyed state.

What was seen is in the stream's state, by sentence, for a stated time, and not read from the output: a batch costs what its own sentences
cost, however large the output is, and a sentence that gave no mention is remembered like any other. The output of a batch is a folder named by the stream and the
batch, so a batch that is repeated after a failure replaces what it wrote.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factloom.operators.mentions import kept_by_sentence, word_mentions

SENTENCES = "sentence_id string, page_no int, text string"


def new_sentences(stream: DataFrame, remember: str = "30 days") -> DataFrame:
    """The rows of a stream whose sentence_id did not come before, within ``remember``.

    Time is that of arrival (the start of the batch), so no row is ever late, and the state of a sentence goes when that time has passed. Of several rows of one
    sentence in a batch one is kept; null is an identifier like others."""
    timed = stream.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", remember)
    return timed.dropDuplicatesWithinWatermark(["sentence_id"]).drop("_arrived")


def append_mentions(spark: SparkSession, source: str, target: str, checkpoint: str, extract: Callable[[DataFrame], DataFrame] | None = None, once: bool = True, remember: str = "30 days") -> StreamingQuery:
    """Append mentions of new sentences under ``source`` (Parquet) to ``target``; a batch that is repeated after a failure adds nothing twice.

    ``extract`` turns sentences into mentions; the default is the deterministic extractor with its limit a sentence. ``target`` is a Parquet table
    partitioned by stream and batch."""
    extract = extract or (lambda rows: kept_by_sentence(word_mentions(rows, ["sentence_id", "page_no"])))

    def batch(rows: DataFrame, number: int) -> None:
        # the stream's own name, which is in its checkpoint: a new checkpoint never writes over the batches of an old one
        name = json.loads(rows.sparkSession.read.text(f"{checkpoint}/metadata").first()[0])["id"]
        extract(rows).write.mode("overwrite").parquet(f"{target}/stream={name}/batch={number}")

    rows = new_sentences(spark.readStream.schema(SENTENCES).parquet(source), remember)
    stream = rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream).start()


def counts_by_window(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window start, event_type, n) of a stream of events with ts, bounded by a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
