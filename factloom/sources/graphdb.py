"""Graph stores as a sink with commit and abort.

``GraphSource`` is a Spark data source that writes nodes or edges to a store. Tasks stage their rows under the name of the write and of the task attempt, where no reader sees
them; the driver publishes the attempts that Spark counts, in one transaction, so a write is there as a whole or not at all, whatever tasks or attempts are lost. Keys
are a uniqueness constraint of the store, checked when staged rows are published: a key that a write brings twice fails it, as tasks have no order that could say
which row is the last (``graph.upsert_nodes`` and ``upsert_edges`` leave one row a key); a key that the store has already is updated. Mode ``overwrite``
clears the kind first, in the same transaction.

A store is a class of ``GraphStore``'s methods, named ``module:Class`` and made anew in every worker from its target. ``SqliteStore`` is an embedded one on a folder that
workers share; a store of a graph server does the same with the server's transactions.
"""

from __future__ import annotations

import importlib
import json
import sqlite3
import uuid
from collections.abc import Iterator
from contextlib import closing
from dataclasses import dataclass
from typing import Protocol

from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: Keys of each kind; an edge is one an ordered pair of nodes.
KEYS = {"nodes": ("node_id",), "edges": ("src_id", "dst_id")}
#: Rows that a task stages at a time.
BATCH = 500


class GraphStore(Protocol):
    def constrain(self) -> None:
        """Make the keys unique, where they are not yet."""

    def stage(self, write: str, task: str, kind: str, rows: list[dict]) -> None:
        """Keep rows of a task attempt out of sight."""

    def publish(self, write: str, tasks: list[str], kind: str, clear: bool) -> int:
        """Upsert what ``tasks`` staged, edges only between known nodes; the number of rows that were taken. All or nothing."""

    def discard(self, write: str) -> None:
        """Forget what a write staged."""

    def clear(self) -> None:
        """Delete all nodes and edges."""


class SqliteStore:
    """Nodes and edges in one SQLite file, with their columns as JSON."""

    def __init__(self, target: str):
        self.target = target

    def _open(self) -> closing[sqlite3.Connection]:
        db = sqlite3.connect(self.target, timeout=120, isolation_level=None)
        db.execute("PRAGMA foreign_keys = ON")
        return closing(db)

    def constrain(self) -> None:
        with self._open() as db:
            db.execute("CREATE TABLE IF NOT EXISTS nodes (node_id TEXT PRIMARY KEY, data TEXT NOT NULL)")
            db.execute("CREATE TABLE IF NOT EXISTS edges (src_id TEXT NOT NULL REFERENCES nodes ON DELETE CASCADE, dst_id TEXT NOT NULL REFERENCES nodes ON DELETE CASCADE, data TEXT NOT NULL, PRIMARY KEY (src_id, dst_id))")
            db.execute("CREATE TABLE IF NOT EXISTS staged (run TEXT, task TEXT, a TEXT, b TEXT, data TEXT)")
            db.execute("CREATE INDEX IF NOT EXISTS staged_by_run ON staged (run, task)")

    def stage(self, write: str, task: str, kind: str, rows: list[dict]) -> None:
        keys = KEYS[kind]
        told = [(write, task, row[keys[0]], row[keys[-1]], json.dumps(row, ensure_ascii=False, default=str)) for row in rows]
        with self._open() as db:
            db.execute("BEGIN IMMEDIATE")
            db.executemany("INSERT INTO staged VALUES (?, ?, ?, ?, ?)", told)
            db.execute("COMMIT")

    def publish(self, write: str, tasks: list[str], kind: str, clear: bool) -> int:
        with self._open() as db:
            db.execute("BEGIN IMMEDIATE")
            try:
                db.execute("CREATE TEMP TABLE taken (task TEXT PRIMARY KEY)")
                db.executemany("INSERT INTO taken VALUES (?)", [(t,) for t in tasks])
                own = "FROM staged JOIN taken USING (task) WHERE run = ?"
                twice = db.execute(f"SELECT a, b {own} GROUP BY a, b HAVING count(*) > 1 OR a IS NULL OR b IS NULL LIMIT 1", (write,)).fetchone()
                if twice:
                    raise ValueError(f"{kind}: the key {twice[0] if kind == 'nodes' else twice} is missing or comes twice")
                if clear:
                    db.execute(f"DELETE FROM {kind}")
                if kind == "nodes":
                    done = db.execute(f"INSERT INTO nodes SELECT a, data {own} ON CONFLICT (node_id) DO UPDATE SET data = excluded.data", (write,))
                else:
                    known = "a IN (SELECT node_id FROM nodes) AND b IN (SELECT node_id FROM nodes)"
                    done = db.execute(f"INSERT INTO edges SELECT a, b, data {own} AND {known} ON CONFLICT (src_id, dst_id) DO UPDATE SET data = excluded.data", (write,))
                count = done.rowcount
                db.execute("DELETE FROM staged WHERE run = ?", (write,))
                db.execute("COMMIT")
            except BaseException:
                db.execute("ROLLBACK")
                raise
            return count

    def discard(self, write: str) -> None:
        with self._open() as db:
            db.execute("DELETE FROM staged WHERE run = ?", (write,))

    def clear(self) -> None:
        with self._open() as db:
            db.execute("BEGIN IMMEDIATE")
            db.execute("DELETE FROM edges")
            db.execute("DELETE FROM nodes")
            db.execute("COMMIT")

    def rows(self, kind: str) -> list[dict]:
        """What is published, in order of the keys."""
        with self._open() as db:
            return [json.loads(x) for (x,) in db.execute(f"SELECT data FROM {kind} ORDER BY {', '.join(KEYS[kind])}")]


def open_store(name: str, target: str) -> GraphStore:
    module, made = name.split(":")
    return getattr(importlib.import_module(module), made)(target)


@dataclass
class Staged(WriterCommitMessage):
    task: str


class _Writer(DataSourceWriter):
    def __init__(self, store: str, target: str, kind: str, overwrite: bool):
        self.store, self.target, self.kind, self.overwrite, self.name = store, target, kind, overwrite, uuid.uuid4().hex
        self._open().constrain()

    def _open(self) -> GraphStore:
        return open_store(self.store, self.target)

    def write(self, rows: Iterator[Row]) -> Staged:
        task = TaskContext.get()
        name, store, batch = f"{task.partitionId()}-{task.taskAttemptId()}", self._open(), []
        for row in rows:
            batch.append(row.asDict(True))
            if len(batch) >= BATCH:
                store.stage(self.name, name, self.kind, batch)
                batch = []
        if batch:
            store.stage(self.name, name, self.kind, batch)
        return Staged(name)

    def commit(self, messages: list[Staged | None]) -> None:
        self._open().publish(self.name, [m.task for m in messages if m is not None], self.kind, self.overwrite)

    def abort(self, messages: list[Staged | None]) -> None:
        self._open().discard(self.name)


class GraphSource(DataSource):
    """Options: ``kind`` (nodes or edges), ``store`` (module:Class), ``target`` (what the store is made from)."""

    @classmethod
    def name(cls) -> str:
        return "factloom_graph"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        kind = self.options["kind"]
        lack = [k for k in KEYS[kind] if k not in schema.names]
        if lack:
            raise ValueError(f"missing columns: {', '.join(lack)}")
        return _Writer(self.options.get("store", f"{__name__}:SqliteStore"), self.options["target"], kind, overwrite)


def write_graph(df: DataFrame, kind: str, target: str, store: str = f"{__name__}:SqliteStore", clear: bool = False) -> None:
    """Upsert ``df`` into a store's nodes or edges, as a whole; ``clear`` deletes those that were there."""
    df.sparkSession.dataSource.register(GraphSource)
    df.write.format("factloom_graph").option("kind", kind).option("target", target).option("store", store).mode("overwrite" if clear else "append").save()
