"""String similarity: 2 * matching characters / all characters, matched by longest blocks first, for a whole batch of pairs at a time.

The longest common block of each pair, of equal ones that with the earliest end in the first string, then in the second, comes from a table of common endings
that is filled row by row for all pairs together; what lies left of it and right of it are pairs of their own, until nothing matches. The work is done in
arrays, a few operations a row of the table, whatever the number of pairs.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Cells of a row of the table for all pairs of a batch; the length from which a second string's frequent characters start no block.
CELLS, LONG = 1 << 18, 200


def _padded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points + 1, a row a text, 0 behind its end; lengths)."""
    sizes = np.array([len(t) for t in texts], np.int64)
    out = np.zeros((len(texts), int(sizes.max(initial=0))), np.int32)
    out[np.arange(out.shape[1]) < sizes[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32) + 1
    return out, sizes


def _windows(rows: np.ndarray, which: np.ndarray, low: np.ndarray, high: np.ndarray, behind: int) -> np.ndarray:
    """The characters from ``low`` to ``high`` of the rows, ``behind`` where there are no more."""
    at = low[:, None] + np.arange(int((high - low).max(initial=0)))
    return np.where(at < high[:, None], rows[which[:, None], np.minimum(at, rows.shape[1] - 1)], behind)


def _blocks(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(size, start in a, start in b) of the longest common block of each pair of rows."""
    n = len(a)
    size, i_end, j_end = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    row = np.zeros((n, b.shape[1] + 1), np.int32)
    for i in range(a.shape[1]):
        row[:, 1:] = np.where(a[:, i : i + 1] == b, row[:, :-1] + 1, 0)
        j = row.argmax(axis=1)
        best = row[np.arange(n), j]
        more = best > size
        size[more], i_end[more], j_end[more] = best[more], i + 1, j[more]
    return size, i_end - size, j_end - size


def matched(a: list[str], b: list[str]) -> np.ndarray:
    """Matching characters of each pair."""
    (x, xn), (y, yn) = _padded(a), _padded(b)
    out = np.zeros(len(a), np.int64)
    todo = np.stack([np.arange(len(a)), np.zeros(len(a), np.int64), xn, np.zeros(len(a), np.int64), yn])
    while True:
        todo = todo[:, (todo[1] < todo[2]) & (todo[3] < todo[4])]
        if not todo.shape[1]:
            return out
        todo = todo[:, np.argsort(todo[4] - todo[3], kind="stable")]  # of like sizes together
        then, at = [], 0
        while at < todo.shape[1]:
            width = int(todo[4, at] - todo[3, at])
            step = max(1, CELLS // (width + 1))
            part = todo[:, at : at + step]
            at += part.shape[1]
            which, alo, ahi, blo, bhi = part
            n, i, j = _blocks(_windows(x, which, alo, ahi, -1), _windows(y, which, blo, bhi, -2))
            np.add.at(out, which, n)
            for low, high, left, right in ((alo, alo + i, blo, blo + j), (alo + i + n, ahi, blo + j + n, bhi)):
                then.append(np.stack([which, low, high, left, right])[:, n > 0])
        todo = np.concatenate(then, axis=1)


def ratios(a: list[str], b: list[str]) -> np.ndarray:
    """The ratio of each pair, in the order given (it is not always symmetric); 1 for two empty strings."""
    every = np.array([len(s) + len(t) for s, t in zip(a, b)], np.int64)
    out = np.ones(len(a))
    long = np.array([len(t) >= LONG for t in b], bool)
    short = np.flatnonzero(~long)
    if len(short):
        m = matched([a[i] for i in short], [b[i] for i in short])
        out[short] = np.where(every[short] > 0, 2.0 * m / np.maximum(every[short], 1), 1.0)
    for i in np.flatnonzero(long):
        out[i] = SequenceMatcher(None, a[i], b[i]).ratio()
    return out


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """The ratio of each pair; null for a null."""
    full = np.flatnonzero((a.notna() & b.notna()).to_numpy())
    out = np.full(len(a), np.nan)
    if len(full):
        out[full] = ratios(a.iloc[full].tolist(), b.iloc[full].tolist())
    return pd.Series(out).astype(object).where(~np.isnan(out), None)


def may_reach(a: Column, b: Column, least: float) -> Column:
    """False only where lengths alone keep the ratio below ``least``."""
    return 2.0 * F.least(F.length(a), F.length(b)) >= least * (F.length(a) + F.length(b))


def bigrams(col: Column) -> Column:
    """Distinct pairs of neighbouring characters; a shorter text as itself."""
    return F.when(F.length(col) < 2, F.array(col)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(col) - 1), lambda i: F.substr(col, i, F.lit(2)))))
