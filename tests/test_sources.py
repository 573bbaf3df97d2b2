"""Readers, writers, model-backed steps and the incremental stream."""

import pytest
from pyspark.sql import functions as F

from factloom.operators import oracle, study
from factloom.operators.mentions import word_mentions
from factloom.sources import tables
from factloom.streaming.incremental import append_mentions, new_sentences


def test_pages(spark):
    text = "before\n=== Page 3 === x\n a \n\n b\n=== Page 3 ===\n\n=== Page 4 ===\nc"
    df = spark.createDataFrame([("f", text), ("none", "no marker"), ("null", None)], "path string, text string")
    got = [(r["path"], r["page_ord"], r["page_no"], r["text"]) for r in tables.parse_pages(df).orderBy("page_ord").collect()]
    assert got == [("f", 1, 3, "before a b"), ("f", 2, 3, ""), ("f", 3, 4, "c")]


def test_tables(spark, tmp_path):
    p = tmp_path / "n.tsv"
    p.write_text('﻿id\tlabel_name\tname\n1\t"a\tb"\tNA\n2\tx\ty\n', encoding="utf-8")
    df = tables.read_tsv(spark, str(p), missing=True)
    rows = df.orderBy("ord").collect()
    assert [r["name"] for r in rows] == ["", "y"] and rows[0]["label_name"] == "a\tb"
    assert tables.as_nodes(df).columns[:3] == ["node_id", "name", "aliases"]
    edges = tables.as_edges(spark.createDataFrame([("a", "b", "c", 1)], "head string, tail string, predicate string, ord long"))
    assert edges.first()[:3] == ("a", "b", "c")
    typed = tables.typed(spark.createDataFrame([("x", "y"), ("3", "0.5")], "page_no string, c string"), {"page_no": -1}, {"c": 0.8}).collect()
    assert [tuple(r) for r in typed] == [(-1, 0.8), (3, 0.5)]
    tables.write_tsv(df, str(tmp_path / "out"), ["id", "name"])
    assert tables.read_tsv(spark, str(tmp_path / "out")).count() == 2
    ids = tables.generated_ids(spark.createDataFrame([("", 1), ("k", 2), (None, 3)], "node_id string, ord long"))
    assert sorted(r["node_id"] for r in ids.collect()) == ["k", "n000000", "n000002"]


def test_model_steps(spark):
    calls = spark.createDataFrame([(1, "alpha beta", "beta?"), (2, None, None)], "id long, context string, question string")
    assert [r["reply"] for r in oracle.asked(calls, oracle.rule_judge, ["context", "question"]).orderBy("id").collect()] == ['{"score": 60}', '{"score": 60}']

    def broken(row):
        raise RuntimeError("down")

    out = oracle.asked(calls, broken, ["context"], attempts=2, pause=0).first()
    assert out["reply"] is None and out["warning"].startswith("LLM_FAILED")
    known = spark.createDataFrame([(1, "yes")], "id long, reply string")
    assert [(r["reply"], r["warning"] == "") for r in oracle.replayed(calls, known, ["id"]).orderBy("id").collect()] == [("yes", True), (None, False)]


def test_study(spark):
    m = spark.createDataFrame([(1, "A", "f", 0.12345), (1, "B", "f", 0.5), (2, "A", "f", 1.0)], "i int, method string, metric_name string, value double")
    c = study.compare(m)
    assert {(r["i"], r["method"]): r["f"] for r in c.collect()} == {(1, "A"): 0.123, (1, "B"): 0.5, (2, "A"): 1.0}
    assert {r["method"]: r["f"] for r in study.means(c, 2).collect()} == {"A": 0.56, "B": 0.5}


def test_calls_are_in_flight_together_and_replies_stay_with_their_rows(spark):
    import threading
    import time

    def slow(row):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.02)
        with lock:
            now[0] -= 1
        return f"{row['q']}! {most[0]}"

    class Held:  # made anew in the worker
        def __call__(self, row):
            global lock, now, most
            if "lock" not in globals():
                lock, now, most = threading.Lock(), [0], [0]
            return slow(row)

    rows = spark.range(100).select(F.concat(F.lit("q"), F.col("id").cast("string")).alias("q")).coalesce(1)
    got = oracle.asked(rows, Held(), ["q"], at_once=5).collect()
    assert all(r["reply"].split("!")[0] == r["q"] for r in got) and max(int(r["reply"].split()[1]) for r in got) == 5


def test_a_lost_task_asks_no_row_twice(spark, tmp_path):
    from collections import Counter

    said, log = tmp_path / "said", str(tmp_path / "log")
    said.mkdir()

    def model(fatal):
        def ask(row):
            with open(f"{said}/{row['q']}", "a") as f:
                f.write("x")
            if row["q"] == fatal:
                raise SystemExit("the worker is gone")
            if row["q"] == "q3":
                raise ValueError("refused")
            return row["q"].upper()

        return ask

    rows = spark.range(60).select(F.concat(F.lit("q"), F.col("id").cast("string")).alias("q")).coalesce(1)
    with pytest.raises(Exception):  # noqa: B017  whatever Spark makes of it
        oracle.asked(rows, model("q40"), ["q"], attempts=1, pause=0, at_once=3, log=log).collect()
    (tmp_path / "log" / "0-torn.jsonl").write_text('["half a li')
    got = {r["q"]: (r["reply"], r["warning"]) for r in oracle.asked(rows, model(None), ["q"], attempts=1, pause=0, at_once=3, log=log).collect()}
    assert got == {f"q{i}": (f"Q{i}", "") for i in range(60) if i != 3} | {"q3": (None, "LLM_FAILED: ValueError: refused")}
    asked = Counter({p.name: len(p.read_text()) for p in said.iterdir()})
    # only the call that took the worker down and the refused one are made again
    assert {q for q, n in asked.items() if n > 1} == {"q3", "q40"} and set(asked) == {f"q{i}" for i in range(60)}
    third = {r["q"]: r["reply"] for r in oracle.asked(rows, model(None), ["q"], attempts=1, pause=0, log=log).collect()}
    assert third == {q: reply for q, (reply, _) in got.items()} and sum(len(p.read_text()) for p in said.iterdir()) == sum(asked.values()) + 1


def test_stream_remembers_what_gave_nothing_and_survives_a_restart(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    row = "sentence_id string, page_no int, text string"
    add = lambda *rows: spark.createDataFrame(list(rows), row).coalesce(1).write.mode("append").parquet(src)
    asked = tmp_path / "asked"
    asked.write_text("")

    def extract(fail):
        def run(rows):
            with open(asked, "a") as f:
                f.write("".join(f"{r['sentence_id']} " for r in rows.orderBy("sentence_id").collect()) + "\n")
            found = word_mentions(rows, ["sentence_id", "page_no"])
            return found.withColumn("page_no", F.raise_error(F.lit("lost")).cast("int")) if fail else found

        return run

    add(("s1", 1, "Something happened."), ("s2", 1, "no"), ("s2", 1, "no"), (None, 1, "Nameless"))
    append_mentions(spark, src, out, ck, extract(False)).awaitTermination()
    add(("s1", 1, "Something else"), ("s2", 2, "no"), ("s3", 2, "Another sentence"), (None, 1, "Nameless"))
    with pytest.raises(Exception, match="lost"):
        append_mentions(spark, src, out, ck, extract(True)).awaitTermination()
    add(("s4", 3, "Further words"), ("s3", 2, "Another sentence"))
    append_mentions(spark, src, out, ck, extract(False)).awaitTermination()
    got = sorted((str(r["sentence_id"]), r["mention"]) for r in spark.read.parquet(out).collect())
    assert got == sorted([("None", "Nameless"), ("s1", "Something"), ("s1", "happened"), ("s3", "Another"), ("s3", "sentence"), ("s4", "Further")])
    lines = [x.split() for x in asked.read_text().splitlines() if x.split()]
    # s2 gave nothing and is not asked again; the batch that failed is repeated as it was
    assert lines == [["None", "s1", "s2"], ["s3"], ["s3"], ["s4"]]
    # the output plays no part in what is new
    plan = new_sentences(spark.readStream.schema(row).parquet(src))
    assert plan.isStreaming and out not in plan._jdf.queryExecution().toString()


def test_streams_with_other_checkpoints_add_to_a_table(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    spark.createDataFrame([("s1", 1, "Something")], "sentence_id string, page_no int, text string").write.parquet(src)
    for x in "ab":
        append_mentions(spark, src, out, str(tmp_path / x)).awaitTermination()
    assert spark.read.parquet(out).count() == 2


def test_stream_appends_each_sentence_once(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    row = "sentence_id string, page_no int, text string"
    spark.createDataFrame([("s1", 1, "Something happened."), ("s2", 1, "short")], row).write.parquet(src)
    append_mentions(spark, src, out, ck).awaitTermination()
    spark.createDataFrame([("s1", 1, "Something happened."), ("s3", 2, "Another sentence")], row).write.mode("append").parquet(src)
    append_mentions(spark, src, out, ck).awaitTermination()
    got = sorted((r["sentence_id"], r["mention"]) for r in spark.read.parquet(out).collect())
    assert got == [("s1", "Something"), ("s1", "happened"), ("s3", "Another"), ("s3", "sentence")]
