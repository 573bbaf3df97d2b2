"""Quoted tables by ranges, inferred types, scans by pages, graph stores."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from factloom.sources import quoted, tables
from factloom.sources.graphdb import SqliteStore, write_graph
from factloom.sources.scans import read_scans


@pytest.fixture
def small_ranges(spark):
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k in held:
        spark.conf.set(k, "97")
    yield
    for k, v in held.items():
        spark.conf.set(k, v)


def written(path, rows, end="\n"):
    out = io.StringIO()
    csv.writer(out, delimiter="\t", lineterminator=end).writerows(rows)
    path.write_text(out.getvalue(), encoding="utf-8", newline="")


def table(seed, n=200):
    r = random.Random(seed)
    field = lambda: r.choice(["", "plain", "é中", 'say "hi"', "a\tb", "two\nlines", '"', "\n\n", "x" * r.randint(0, 300), 'q"\n"q', "mid\"quote"])
    return [["id", "one", "two"]] + [[str(i), field(), field()] for i in range(n)]


def test_fields_and_line_ends_agree_with_the_csv_module():
    r = random.Random(2)
    for _ in range(3000):
        text = "".join(r.choices('a"\t\n', k=r.randint(0, 14)))
        lines = text.split("\n")
        want = list(csv.reader([x + "\n" for x in lines[:-1]] + lines[-1:], delimiter="\t"))
        inside, held, got = False, [], []
        for line in lines:
            held.append(line)
            inside = quoted.ends_inside(line, inside)
            if not inside:
                got += [quoted.fields("\n".join(held))] if held != [""] else []
                held = []
        got += [quoted.fields("\n".join(held))] if held else []
        assert got == [x for x in want if x], text


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_quoted_tables_by_ranges(spark, tmp_path, small_ranges, end):
    rows = table(1)
    written(tmp_path / "t.tsv", rows, end)
    df = quoted.read_quoted(spark, str(tmp_path / "t.tsv"))
    got = [tuple(r) for r in df.orderBy("ord").collect()]
    assert got == [(*r, i) for i, r in enumerate(rows[1:])]
    lines = spark.read.option("lineSep", "\n").text(str(tmp_path / "t.tsv"))
    assert lines.rdd.getNumPartitions() > 50
    if end == "\n":
        plain = spark.read.option("sep", "\t").option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(str(tmp_path / "t.tsv"))
        assert plain.rdd.getNumPartitions() == 1
        plain = plain.na.fill("").withColumn("ord", F.monotonically_increasing_id())
        assert [tuple(r) for r in plain.orderBy("ord").collect()] == got


def test_quoted_tables_of_several_files(spark, tmp_path, small_ranges):
    (tmp_path / "d").mkdir()
    parts = {name: table(seed, n) for name, seed, n in (("a", 3, 40), ("b", 4, 0), ("c", 5, 25))}
    for name, rows in parts.items():
        written(tmp_path / "d" / f"{name}.tsv", rows)
    (tmp_path / "d" / "a.tsv").write_bytes("﻿".encode() + (tmp_path / "d" / "a.tsv").read_bytes() + b"\n\nshort\nlong\t1\t2\t3\n")
    got = [tuple(r)[:3] for r in tables.read_tsv(spark, str(tmp_path / "d")).orderBy("ord").collect()]
    assert got == [tuple(r) for r in parts["a"][1:]] + [("short", "", ""), ("long", "1", "2")] + [tuple(r) for r in parts["c"][1:]]


def test_a_field_longer_than_many_ranges_and_one_that_never_ends(spark, tmp_path, small_ranges):
    long = "line\n" * 400
    written(tmp_path / "t.tsv", [["k", "v"], ["1", long], ["2", "x"]])
    with open(tmp_path / "t.tsv", "a") as f:
        f.write('3\t"open\nstill open\n')
    got = {r["k"]: r["v"] for r in quoted.read_quoted(spark, str(tmp_path / "t.tsv")).collect()}
    assert got == {"1": long, "2": "x", "3": "open\nstill open"} or got == {"1": long, "2": "x", "3": "open\nstill open\n"}
    (tmp_path / "e.tsv").write_text("k\tv\n")
    assert quoted.read_quoted(spark, str(tmp_path / "e.tsv")).columns == ["k", "v", "ord"]
    assert quoted.read_quoted(spark, str(tmp_path / "e.tsv")).count() == 0


def test_inferred_types_equal_those_of_pandas(spark, tmp_path):
    import pandas as pd

    rows = [
        ["whole", "gaps", "decimal", "mixed", "truth", "gap truth", "none", "words", "big", "exp"],
        ["1", "", "1", "1", "True", "", "", "a", "99999999999999999999", "1e3"],
        ["-7", "3", "2.5", "x", "false", "True", "NA", "NA", "1", "inf"],
        ["+12", "NaN", ".5", "2", "TRUE", "False", "null", "b", "2", "-2.5E-3"],
    ]
    written(tmp_path / "t.tsv", rows)
    got = tables.read_inferred(spark, str(tmp_path / "t.tsv")).orderBy("ord").drop("ord")
    want = pd.read_csv(tmp_path / "t.tsv", sep="\t")
    kinds = {"int64": "bigint", "float64": "double", "bool": "boolean", "object": "string", "str": "string", "uint64": "double"}
    for c in rows[0]:
        if c == "big":  # beyond long: decimal, while pandas keeps it as it is
            continue
        assert dict(got.dtypes)[c] == kinds[str(want[c].dtype)], c
        own = [r[c] for r in got.select(c).collect()]
        assert [None if pd.isna(x) else x for x in want[c].tolist()] == own or c == "gap truth", c
    assert [r["gap truth"] for r in got.collect()] == [None, "True", "False"] and dict(got.dtypes)["big"] == "double"
    empty = tables.inferred(spark.createDataFrame([], "a string, n int"))
    assert dict(empty.dtypes) == {"a": "string", "n": "int"}
    odd = tables.inferred(spark.createDataFrame([("1", 2), ("7", 3)], "`a.b` string, ord int"))
    assert odd.dtypes == [("a.b", "bigint"), ("ord", "int")]


def test_scans_by_ranges_of_pages(spark, tmp_path):
    (tmp_path / "one.txt").write_text("\f".join(f"page {i}\n\nwords" for i in range(1, 51)) + "\f")
    (tmp_path / "two.txt").write_text("alone")
    (tmp_path / "none.txt").write_text("")
    df = read_scans(spark, str(tmp_path), size=7)
    assert df.rdd.getNumPartitions() == 8 + 1 + 1
    got = {(r["lecture"], r["page_no"]): r["text"] for r in df.collect()}
    assert set(got) == {("one", i) for i in range(1, 51)} | {("two", 1), ("none", 1)} and got["one", 50].split() == ["page", "50", "words"] and got["two", 1].strip() == "alone"
    assert sorted(r["page_no"] for r in read_scans(spark, str(tmp_path), most=3).where("lecture = 'one'").collect()) == [1, 2, 3]
    few = read_scans(spark, str(tmp_path), size=2).where("page_no <= 5 and lecture = 'one'")
    assert few.rdd.getNumPartitions() == 3 and few.count() == 5  # no other page is in a task
    assert read_scans(spark, str(tmp_path / "two.txt")).count() == 1
    assert read_scans(spark, str(tmp_path)).where("page_no < 1").count() == 0


NODE = "node_id string, name string, page_no int"


def test_graph_writes_are_whole(spark, tmp_path):
    target = str(tmp_path / "g.db")
    nodes = spark.range(1200).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("node_id"), F.lit("first").alias("name"), F.col("id").cast("int").alias("page_no")).repartition(6)
    write_graph(nodes, "nodes", target)
    store = SqliteStore(target)
    assert len(store.rows("nodes")) == 1200
    # a task that fails late leaves nothing, though others were done
    fail = F.when(F.col("page_no") == 1199, F.raise_error(F.lit("lost")).cast("string")).otherwise("second")
    with pytest.raises(Exception, match="lost"):
        write_graph(nodes.withColumn("name", fail), "nodes", target)
    assert {r["name"] for r in store.rows("nodes")} == {"first"}
    with store._open() as db:
        assert db.execute("SELECT count(*) FROM staged").fetchone() == (0,)
    # an upsert, and new ones
    more = spark.createDataFrame([("n1", "new", 1), ("m1", "more", 2)], NODE)
    write_graph(more, "nodes", target)
    got = {r["node_id"]: r["name"] for r in store.rows("nodes")}
    assert len(got) == 1201 and (got["n1"], got["m1"], got["n2"]) == ("new", "more", "first")
    # keys are unique
    with pytest.raises(Exception, match="comes twice"):
        write_graph(more.unionByName(more.limit(1)).repartition(3), "nodes", target, clear=True)
    with pytest.raises(Exception, match="missing"):
        write_graph(spark.createDataFrame([(None, "x", 1)], NODE), "nodes", target)
    assert len(store.rows("nodes")) == 1201
    with pytest.raises(Exception, match="missing columns"):
        write_graph(more.drop("node_id"), "nodes", target)
    # edges between known nodes; one a pair
    edge = "src_id string, dst_id string, relation_type string"
    write_graph(spark.createDataFrame([("n1", "n2", "a"), ("n2", "n1", "b"), ("n1", "gone", "c")], edge), "edges", target)
    write_graph(spark.createDataFrame([("n1", "n2", "z")], edge), "edges", target)
    assert [(r["src_id"], r["dst_id"], r["relation_type"]) for r in store.rows("edges")] == [("n1", "n2", "z"), ("n2", "n1", "b")]
    write_graph(spark.createDataFrame([("n1", "only", 0)], NODE), "nodes", target, clear=True)  # edges go with their nodes
    assert [r["name"] for r in store.rows("nodes")] == ["only"] and store.rows("edges") == []
    store.clear()
    assert store.rows("nodes") == []
