"""Runs against plain loops over periods."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factloom.llm import runs


def plain_runs(w):
    """Every maximal stretch with a period, with the least of its periods."""
    n, found = len(w), {}
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            if j + p - i >= max(6, 4 * p) and (i, j + p) not in found:
                found[i, j + p] = p
            i = max(j, i) + 1
    return sorted((s, e - s, p) for (s, e), p in found.items())


def plain_row(key, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str("" if key is None else key).encode()), len(w)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w)
    gone = {i for s, m, p in found for i in range(s + p, s + m)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
    return key, len(found), *best, best[1] * 1000 // best[2] if found else None, sha("".join(f"{s},{m},{p}\n" for s, m, p in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=80))
def test_runs_of_small_alphabets(w):
    assert [tuple(x) for x in runs.runs(np.array(w, np.int64), len(w)).tolist()] == plain_runs(w)


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**9))
def test_runs_of_repeated_parts(seed):
    r = random.Random(seed)
    w = []
    for _ in range(r.randint(1, 6)):
        part = [r.randint(0, 3) for _ in range(r.randint(1, 40))]
        times = r.randint(1, 9)
        w += part * times + part[: r.randint(0, len(part))]
    assert [tuple(x) for x in runs.runs(np.array(w, np.int64), len(w)).tolist()] == plain_runs(w)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 1), min_size=2, max_size=120), st.integers(0, 10**6))
def test_common_extensions(w, seed):
    ext, r = runs.Extensions(np.array(w, np.int64)), random.Random(seed)
    pairs = [sorted(r.sample(range(len(w)), 2)) for _ in range(50)]
    i, j = np.array(pairs).T
    for a, b, got in zip(i, j, ext.common(i, j)):
        n = 0
        while b + n < len(w) and w[a + n] == w[b + n]:
            n += 1
        assert got == n


def texts():
    r = random.Random(2)
    word = lambda: r.choice(["a", "b", "é", "中", "word", "longer"])
    out = [None, "", " \n\x0b", "one", "x " * 6, "x " * 5, "a b " * 4, "    " * 5, "ab\x1c " * 9]
    out += [" ".join(word() for _ in range(r.randint(1, 300))) for _ in range(120)]
    for _ in range(60):
        part = [word() for _ in range(r.randint(1, 30))]
        out.append(" ".join([word() for _ in range(20)] + part * r.randint(2, 8) + [word() for _ in range(20)]) + "\t\n")
    return out + ["again and " * 3000, " ".join(str(r.randint(0, 50)) for _ in range(9000))]


@pytest.mark.parametrize("group", [1 << 20, 500])
def test_query_equals_plain_loops(spark, tmp_path, monkeypatch, group):
    monkeypatch.setattr(runs, "GROUP", group)
    rows = list(enumerate(texts())) + [(None, "a " * 8), (4, "x " * 6), (4, "x " * 6)]
    # keys whose texts are made periodic
    keys = [i for i in range(1000, 3000) if zlib.crc32(str(i).encode()) % 10 == 0][:60]
    rows += [(k, t) for k, t in zip(keys, texts()[9:])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("_n", "_t", "_key", "runs", "n_words", "best")})
    df.write.parquet(f"file://{tmp_path}/documents.parquet")
    got = sorted((tuple(r)[:8] for r in runs.query(spark, f"file://{tmp_path}").collect()), key=str)
    want = sorted((plain_row(k, t) for k, t in rows), key=str)
    assert got == want


def test_operator_keeps_columns(spark):
    df = spark.createDataFrame([(1, "a a a a a a b", "x")], "id long, text string, `_n` string")
    r = runs.find(df).first()
    assert (r["id"], r["text"], r["_n"], r["n_words"], r["collapsed"]) == (1, "a a a a a a b", "x", 7, "a b")
    assert [tuple(x) for x in r["runs"]] == [(0, 6, 1)] and runs.find(df.where("false")).count() == 0
