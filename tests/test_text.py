"""Scalar text functions on edge cases."""

import pytest
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.functions.similarity import ratio


def one(spark, expr, **values):
    kinds = ", ".join(f"{k} string" for k in values) or "x string"
    df = spark.createDataFrame([tuple(values.values()) or (None,)], kinds)
    return df.select(expr.alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("text", "parts"),
    [("丁...", ["丁.", ".", "."]), ("a. b", ["a.", "b"]), ("。！", ["。", "！"]), ("　x　", ["x"]), ("", []), (None, [])],
)
def test_sentences(spark, text, parts):
    assert one(spark, T.sentences("t"), t=text) == parts


@pytest.mark.parametrize(
    ("text", "clean"),
    [("《刑法》", "刑法"), ("的决定书", "决定书"), ("的决定", "的决定"), ("刑法修正案（八", "刑法修正案（八）"), ("刑法修正案(八", "刑法修正案(八)"), (" a b ", "ab"), (None, "")],
)
def test_clean_mention(spark, text, clean):
    assert one(spark, T.clean_mention("t"), t=text) == clean


@pytest.mark.parametrize(
    ("text", "kind", "bad"),
    [("a", "Law", True), ("ab", "Law", False), ("x" * 20, "Law", False), ("x" * 21, "Law", True), ("１２三", "Law", True), ("行为", "Law", True), ("社会治安问题", "Law", True), ("重大社会治安问题", "Law", False), ("刑法", "book", True), ("刑法典", "Book", False), ("！？", "Law", True)],
)
def test_bad_mention(spark, text, kind, bad):
    assert one(spark, T.bad_mention("t", F.col("k")), t=text, k=kind) is bad


def test_split_list(spark):
    assert one(spark, T.split_list("t"), t="甲方、乙方，甲方") == ["甲方", "乙方"]
    assert one(spark, T.split_list("t"), t="a、b") == ["a、b"]
    assert one(spark, T.split_list("t"), t="罪刑法定原则") == ["罪刑法定原则"]
    assert one(spark, T.split_list("t"), t=None) == []
    assert one(spark, T.split_list("t", "truth"), t="行为、甲方") == ["甲方"]


@pytest.mark.parametrize(
    ("text", "fact"),
    [("a|b|c|d", ("a", "b", "c")), ("x --r--> y", ("x", "r", "y")), ("a|b", None), ("", None), (None, None), ("x -- --> y", None)],
)
def test_kg_fact(spark, text, fact):
    got = one(spark, T.kg_fact("t"), t=text)
    assert (tuple(got) if got else None) == fact


@pytest.mark.parametrize(("text", "letter"), [("b", "B"), ("B.", "B"), ("答案 B", "B"), ("", ""), (None, "")])
def test_answer(spark, text, letter):
    assert one(spark, T.answer("t"), t=text) == letter


def test_replies(spark):
    assert one(spark, T.percent("t", "score"), t='x {"score": 140} y') == 100
    assert one(spark, T.percent("t", "score"), t="none") == 60
    assert one(spark, T.rubric("t", "fluency"), t="Fluency is about 4 of 5") == 4
    assert one(spark, T.rubric("t", "fluency"), t="") == 3
    assert one(spark, T.json_fallbacks("t"), t='```json\n{"a": 1}\n```') == '{"a": 1}'
    assert one(spark, T.json_array("t"), t='```json\n[1, 2]\n```') == "[1, 2]"
    assert one(spark, T.json_object("t"), t="nothing") is None


def test_numbers(spark):
    assert one(spark, T.confidence("t"), t="1.7") == 1.0
    assert one(spark, T.confidence("t"), t="bad") == 0.8
    assert one(spark, T.confidence("t"), t="-1") == 0.0
    assert one(spark, T.numbered("n", F.lit(123456))) == "n123456"
    assert one(spark, T.relation("t"), t=" causes ") == "causes"
    assert one(spark, T.relation("t"), t="likes") == "related_to"
    assert one(spark, T.relation("t", truth=True), t="likes") is None


def test_names(spark):
    assert one(spark, T.spaced("t"), t="　a \t b\n") == "a b"
    assert one(spark, T.matched("t"), t="A（b）") == "a(b)"
    assert one(spark, T.aliases("t"), t="a, b|c") == ["a, b", "c"]
    assert one(spark, T.aliases("t"), t=None) == []
    assert one(spark, T.wrapped("t"), t="abcdefghijklmnopqrst") == "abcdefgh\nijklmnop…"
    assert one(spark, ratio("a", "b"), a="abcd", b="bcde") == 0.75
    assert one(spark, ratio("a", "b"), a=None, b="x") is None


@pytest.mark.parametrize(("key", "parts"), [("a||b||c", ("a", "b||c")), ("a", ("a", "UNK_LABEL")), (None, ("", "UNK_LABEL")), ("||", ("", ""))])
def test_key_parts(spark, key, parts):
    assert tuple(one(spark, T.key_parts("k"), k=key)) == parts
