"""Operators against published results, read in place.

The environment variable GOLDEN_INDEX names a JSON file: a list of objects with ``kind`` and the paths of its tables. Without it these tests are skipped.
alignment: b_nodes, b_edges, t_nodes, t_edges, want (metric_name, value); updates: nodes, edges, log, want_nodes, want_edges; scores: questions, nodes, edges, want (the
questions with their scores); suite: scored, want (one JSON object).
"""

import json
import os

import pytest
from pyspark.sql import functions as F

from factloom.operators import align, evolve, mcq
from factloom.sources import tables

INDEX = json.loads(open(os.environ["GOLDEN_INDEX"]).read()) if os.environ.get("GOLDEN_INDEX") else []
CASES = [pytest.param(x, id=f"{x['kind']}-{i}") for i, x in enumerate(INDEX)]


def cases(kind):
    return pytest.mark.parametrize("case", [c for c in CASES if c.values[0]["kind"] == kind] or [pytest.param(None, marks=pytest.mark.skip("no GOLDEN_INDEX"))])


def nodes(spark, path):
    return tables.as_nodes(tables.read_tsv(spark, path))


def edges(spark, path):
    return tables.as_edges(tables.read_tsv(spark, path))


@cases("alignment")
def test_alignment(spark, case):
    b, t = ((nodes(spark, case[f"{s}_nodes"]), edges(spark, case[f"{s}_edges"])) for s in "bt")
    got = {r["metric_name"]: r["value"] for r in align.report(*b, *t).collect()}
    want = {r["metric_name"]: float(r["value"]) for r in spark.read.option("header", True).csv(case["want"]).select(F.col("metric_name"), "value").collect()}
    assert set(got) == set(want)
    for name, value in want.items():
        assert got[name] == pytest.approx(value, abs=1e-12) if "precision" in name or "recall" in name or "f1" in name or "share" in name else got[name] == value, name


@cases("updates")
def test_updates(spark, case):
    log = tables.read_tsv(spark, case["log"]).drop("ord")
    n, e = evolve.apply(nodes(spark, case["nodes"]), edges(spark, case["edges"]), log)
    for got, want, columns in ((n, case["want_nodes"], ["node_id", "label", "name", "page_no", "sentence_id"]), (e, case["want_edges"], ["edge_id", "src_id", "dst_id", "relation_type", "confidence", "page_no", "sentence_id"])):
        want = tables.read_tsv(spark, want)
        assert [tuple(r) for r in got.orderBy("ord").select(columns).collect()] == [tuple(r) for r in want.orderBy("ord").select(columns).collect()]


@cases("scores")
def test_question_scores(spark, case):
    want = tables.read_tsv(spark, case["want"])
    judged = F.col("_judged").cast("double")
    asked = tables.read_tsv(spark, case["questions"]).drop("ord").join(want.select("qid", F.col("B_coherence_score").alias("_judged")), "qid")
    got = mcq.evaluate(asked, nodes(spark, case["nodes"]), edges(spark, case["edges"]), judged)
    told = {r["qid"]: (r["ent_cnt"], r["rel_cnt"], r["entities_matched"], *(f"{r[c]:.2f}" for c in _SCORES)) for r in got.collect()}
    assert told == {r["qid"]: (int(r["ent_cnt"]), int(r["rel_cnt"]), json.loads(r["entities_matched"]), *(f"{float(r[c]):.2f}" for c in _SCORES)) for r in want.collect()}


_SCORES = ("A_entity_relation_coverage_score", "B_coherence_score", "C_entity_alignment_score", "D_relation_correctness_score", "Q_total")


@cases("suite")
def test_suite(spark, case):
    scored = tables.read_inferred(spark, case["scored"])
    got = mcq.suite(scored.withColumns({c: F.col(c).cast("double") for c in _SCORES})).first().asDict()
    want = json.loads(open(case["want"], encoding="utf-8").read())
    for name, value in got.items():
        name = "suggested_suite_total_with_distribution" if name == "suite_total" else name
        assert value == pytest.approx(want[name], abs=0.0051), name
