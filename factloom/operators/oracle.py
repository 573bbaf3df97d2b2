"""Model-backed steps behind one interface: a function from a batch of rows to a batch of replies, run in Arrow batches.

The defaults are deterministic and offline; ``replayed`` takes replies from a table instead. Failures are retried with a growing pause and
end in a default reply with a warning, so one bad row never fails a job. A task keeps a bounded number of calls in flight; with a reply log, a task
that runs again after it was lost reads what it was told before and asks about the rest only.
"""

from __future__ import annotations

import glob
import hashlib
import json
import os
import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def with_retry(ask: Callable[[dict], str], attempts: int = 3, pause: float = 1.2) -> Callable[[dict], tuple[str | None, str]]:
    """(reply, warning) of a call that is tried up to ``attempts`` times, waiting ``pause`` times the attempt in between."""

    def run(row: dict) -> tuple[str | None, str]:
        said = ""
        for n in range(1, attempts + 1):
            try:
                return ask(row), ""
            except Exception as e:  # noqa: BLE001  any failure of the model counts
                said = f"LLM_FAILED: {type(e).__name__}: {e}"
                if n < attempts:
                    time.sleep(pause * n)
        return None, said

    return run


class ReplyLog:
    """Replies of one partition, by a digest of what was asked: a file for each attempt, in a folder that all workers mount, written line by line as
    replies come. A line that a lost worker left half written is not read. Warnings are not kept: such rows are asked about again."""

    def __init__(self, folder: str, partition: int, attempt: int | str):
        os.makedirs(folder, exist_ok=True)
        self.known: dict[str, str] = {}
        for path in sorted(glob.glob(os.path.join(glob.escape(folder), f"{partition}-*.jsonl"))):
            with open(path, encoding="utf-8") as f:
                for line in f:
                    if line.endswith("\n"):
                        self.known |= dict([json.loads(line)])
        self._lock = threading.Lock()
        self._file = open(os.path.join(folder, f"{partition}-{attempt}.jsonl"), "a", encoding="utf-8")  # noqa: SIM115  closed with the task

    @staticmethod
    def key(row: dict) -> str:
        return hashlib.sha256(json.dumps(row, sort_keys=True, default=str).encode()).hexdigest()

    def put(self, key: str, reply: str) -> None:
        with self._lock:
            self._file.write(json.dumps([key, reply]) + "\n")
            self._file.flush()
            self.known[key] = reply

    def close(self) -> None:
        self._file.close()


def _logged(call: Callable[[dict], tuple[str | None, str]], log: ReplyLog) -> Callable[[dict], tuple[str | None, str]]:
    def run(row: dict) -> tuple[str | None, str]:
        key = log.key(row)
        if key in log.known:
            return log.known[key], ""
        reply, warning = call(row)
        if reply is not None:
            log.put(key, reply)
        return reply, warning

    return run


def asked(rows: DataFrame, ask: Callable[[dict], str], columns: list[str], attempts: int = 3, pause: float = 1.2, at_once: int = 8, log: str | None = None) -> DataFrame:
    """``rows`` with ``reply`` and ``warning``: ``ask`` sees the named columns of each row.

    A task has ``at_once`` calls in flight at most, so ``ask`` runs in threads; replies stay with their rows. ``log``: a folder of a ``ReplyLog``, one of its own for
    each step of a job."""
    schema = StructType([*rows.schema.fields, StructField("reply", StringType()), StructField("warning", StringType())])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call, held = with_retry(ask, attempts, pause), None
        if log is not None:
            task = TaskContext.get()
            held = ReplyLog(log, task.partitionId(), task.taskAttemptId())
            call = _logged(call, held)
        try:
            with ThreadPoolExecutor(at_once) as pool:
                for part in parts:
                    told = part[columns].to_dict("records")
                    said = []
                    for i in range(0, len(told), 4 * at_once):  # a call that ends the task leaves few behind it in the queue
                        said += pool.map(call, told[i : i + 4 * at_once])
                    yield part.assign(reply=[x[0] for x in said], warning=[x[1] for x in said])
        finally:
            if held is not None:
                held.close()

    return rows.mapInPandas(run, schema)


def replayed(rows: DataFrame, replies: DataFrame, key: list[str]) -> DataFrame:
    """``rows`` with ``reply`` from a table of earlier replies and a warning where there is none."""
    known = replies.select(*key, "reply").dropDuplicates(key)
    return rows.join(known, key, "left").withColumn("warning", F.when(F.col("reply").isNull(), "LLM_FAILED: no recorded reply").otherwise(""))


def rule_judge(row: dict) -> str:
    """A coherence score: the default of 60, and 20 more if the question holds a word of its context."""
    words = {w for w in str(row.get("context") or "").lower().split() if len(w) > 3}
    return f'{{"score": {80 if words & set(str(row.get("question") or "").lower().split()) else 60}}}'


def skip_verify(candidates: DataFrame, sentence: str = "sentence_id") -> tuple[DataFrame, DataFrame]:
    """(rows that need no verifier, typed Other; rows for the verifier): sentences with one candidate at most are taken as they are."""
    n = candidates.groupBy(sentence).agg(F.count("*").alias("_n"))
    rows = candidates.join(n, sentence)
    return rows.where("_n <= 1").drop("_n").withColumn("ent_type", F.lit("Other")), rows.where("_n > 1").drop("_n")
