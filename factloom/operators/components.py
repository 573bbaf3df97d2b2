"""Connected components: union-find within tasks, and alternating large-star and small-star steps between them.

A task unites up to ``HELD`` edges and passes on one edge from each node to the least of its group. A graph that fits into one such task is settled by it; a larger one takes
shuffled rounds besides. A step of a round is an equi-join with a min that combines map-side, so no node's neighbourhood is
ever collected. A round is one write to the shared folder, which keeps plans short and survives lost executors; it also tells how many
edges it moved, and a round that moves none is the last: then every edge leads from a node to the least of its component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from factloom.shared import cut, drop, released

#: Edges that a task unites at a time.
HELD = 1 << 20


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, least): every node of the edges (a, b) that is not the least of its group, and that least."""
    ends = np.concatenate([a, b])
    if ends.dtype == object:  # texts are told apart by hash, and only distinct ones are sorted
        at, names = pd.factorize(ends, sort=True)
    else:
        names, at = np.unique(ends, return_inverse=True)
    top, x, y = np.arange(len(names)), at[: len(a)], at[len(a) :]
    while True:
        x, y = top[x], top[y]
        apart = x != y
        if not apart.any():
            break
        x, y = x[apart], y[apart]
        np.minimum.at(top, np.maximum(x, y), np.minimum(x, y))
        while (top != (up := top[top])).any():
            top = up
    moved = np.flatnonzero(top != np.arange(len(names)))
    return names[moved], names[top[moved]]


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n, kind, loops = [], 0, None, None

    def done() -> list[tuple[np.ndarray, np.ndarray]]:
        return [forest(*(np.concatenate(c) for c in zip(*held)))] if held else []

    for batch in batches:
        a, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
        kind, same = batch.column(0).type, a[a == b]
        loops = np.unique(same if loops is None else np.concatenate([loops, same]))
        held.append((a, b))
        n += len(batch)
        if n > HELD:
            held = done()
            n = len(held[0][0]) // 2
    for a, b in [*done(), *([(loops, loops)] if loops is not None else [])]:
        for i in range(0, len(a), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(a[i : i + 50_000], kind), pa.array(b[i : i + 50_000], kind)], ["a", "b"])


def counted(edges: DataFrame, name: str = "cc", which: str = "true") -> tuple[DataFrame, int]:
    """The rows stored, and of how many ``which`` holds."""
    seen = Observation()
    stored = cut(edges.observe(seen, F.count_if(F.expr(which)).alias("n")), name)
    return stored, seen.get["n"]


def united(edges: DataFrame) -> DataFrame:
    """Edges (a, b) that connect what those of each partition do: one from every node to the least of its group there, and the loops."""
    return edges.mapInArrow(released(_united), edges.schema)


def _round(edges: DataFrame) -> DataFrame:
    """Large-star, then small-star; ``moved`` marks the edges that either step changed."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("m"))
    large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"), (F.col("m") < F.col("a")).alias("moved"))
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"), (F.col("moved") | (F.col("b") > F.col("m"))).alias("moved"))
    return small.where("a <> b or moved").unionByName(least.select("a", F.col("m").alias("b"), F.lit(False).alias("moved")))


def components(edges: DataFrame, max_rounds: int = 60, done: bool = False, size: int | None = None) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns a, b of one orderable type); component is the smallest node.

    Self-loops name a node without linking it; null ends are dropped; an empty edge list gives an empty table; repeated edges count once.
    ``done``: the edges of each partition are united already. ``size``: the edges are stored, and so many.
    """
    edges = edges.where("a is not null and b is not null").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    first, n = (edges, size) if size is not None else counted(edges if done else united(edges))
    now = first
    for _ in range(max_rounds):
        if n <= HELD:  # one task settles what is left
            now = cut(united(now.coalesce(1)), "cc")
            break
        seen, before = Observation(), now
        stepped = _round(now.where("a <> b")).observe(seen, F.count_if("moved").alias("moved"))
        now, n = counted(united(stepped.where("a <> b").select("a", "b")))
        if before is not first:
            drop(before)
        if not seen.get["moved"]:
            break
    else:
        raise RuntimeError("components did not settle")
    now = now.where("a <> b")
    ends = now.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("component")), F.struct(F.col("b").alias("node"), F.col("b").alias("component")))).alias("x")).select("x.*")
    loops = first.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("component"))
    return ends.unionByName(loops).groupBy("node").agg(F.min("component").alias("component"))
