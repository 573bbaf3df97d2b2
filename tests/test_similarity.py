"""Batched similarity against difflib, and alignment of graphs whose names differ in the middle."""

import random
import time
from difflib import SequenceMatcher

from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.functions import similarity
from factloom.operators import align
from factloom.plans import demo

TEXT = st.text(alphabet="abc中\U0001f600", max_size=24)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(TEXT, TEXT), max_size=30))
def test_ratios_equal_difflib(pairs):
    a, b = [x for x, _ in pairs], [y for _, y in pairs]
    assert similarity.ratios(a, b).tolist() == [SequenceMatcher(None, x, y).ratio() for x, y in pairs]


def test_long_strings_small_batches_and_nulls(spark, monkeypatch):
    r = random.Random(3)
    draw = lambda n: "".join(r.choices("abcdefgh ", k=n))
    pairs = [(draw(r.choice([0, 5, 60, 250, 400])), draw(r.choice([0, 5, 60, 199, 200, 400]))) for _ in range(120)]
    pairs += [(x, x[:7] + "zz" + x[9:]) for x, _ in pairs]
    want = [SequenceMatcher(None, x, y).ratio() for x, y in pairs]
    for cells in (1 << 18, 50):
        monkeypatch.setattr(similarity, "CELLS", cells)
        assert similarity.ratios(*map(list, zip(*pairs))).tolist() == want
    df = spark.createDataFrame([*pairs[:20], (None, "a"), ("a", None)], "a string, b string")
    assert [x[0] for x in df.select(similarity.ratio("a", "b")).collect()] == [*want[:20], None, None]


def test_many_pairs_take_little_time():
    r = random.Random(4)
    names = ["".join(r.choices("abcdefghij", k=r.randint(8, 24))) for _ in range(20_000)]
    a, b = names, names[1:] + names[:1]
    began = time.time()
    got = similarity.ratios(a, b)
    took = time.time() - began
    began = time.time()
    assert got[:2000].tolist() == [SequenceMatcher(None, x, y).ratio() for x, y in zip(a[:2000], b[:2000])]
    assert took < 10 * (time.time() - began)


#: The baseline graph's names with letters changed, dropped and doubled in their middle.
CHANGED = """SELECT node_id, CASE WHEN length(name) < 9 THEN name WHEN ord % 3 = 0 THEN substr(name, 1, length(name) - 5) || 'q' || substr(name, length(name) - 3)
  WHEN ord % 3 = 1 THEN substr(name, 1, 4) || substr(name, 6) ELSE substr(name, 1, 5) || substr(name, 5) END AS name, label, ord FROM bn"""


def test_names_that_differ_in_the_middle(spark):
    """Whole graphs against the plain loop: exact, then containment, then similarity."""
    from test_graph import plain_relaxed

    at = "/root/testdata/sf0.001"
    b = [" ".join(r["name"].split()) for r in demo.frame(spark, at, CHANGED).collect()]
    t = [r["name"] for r in demo.table(spark, at, "tn").collect()]
    got = {r["name"]: (r["target"], r["claimed"], r["stage"]) for r in align.relaxed_names(align.node_keys(demo.frame(spark, at, CHANGED)), align.node_keys(demo.table(spark, at, "tn"))).collect()}
    want = plain_relaxed(b, t)
    assert {k: v[:2] for k, v in got.items()} == want
    assert sum(v[2] == "similarity" for v in got.values()) > 50


def test_names_that_are_all_alike_meet_few_others(spark, monkeypatch):
    """A name that a target has with one character more meets no other names: keys against the plain loop, without a pair of grams."""
    from test_models import plain_keys

    monkeypatch.setattr(align, "_alike", lambda *_: (_ for _ in ()).throw(AssertionError("pairs of grams")))
    t = [(f"Customer#{i:09d}", "customer") for i in range(150)] + [("Customer#00000012x", "x"), ("Customer#00000012x", "y")]
    b = [(n[:-1] if i % 5 == 1 else n[:9] + n[10:] if i % 5 == 2 else n, "thing" if i % 7 == 3 else x) for i, (n, x) in enumerate(t[:150])]
    of = lambda rows: spark.createDataFrame(rows, "name string, label string")
    got = {r["key"]: r["target"] if r["claimed"] else None for r in align.relaxed_keys(of(b), of(t)).collect()}
    assert got == plain_keys(b, t)
