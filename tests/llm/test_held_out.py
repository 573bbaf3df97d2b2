"""Accuracy of the trained models on rows that they never saw, by the rule that the queries state."""

import zlib

from factloom.llm import language, quality

AT = "/root/testdata/sf0.01"


def held_out(key, part, rest):
    return zlib.crc32(str(key).encode()) % part == rest


def area(pairs):
    """Share of (good, bad) pairs whose good document scores higher; ties count half."""
    good, bad = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))


def test_quality_on_held_out_labels(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{AT}/labels.parquet").collect()}
    rows = [r for r in quality.query(spark, AT).collect() if r["doc_id"] in labels]
    told = [(r["score"], labels[r["doc_id"]]) for r in rows if r["held_out"]]
    assert all(r["held_out"] == held_out(r["doc_id"], 3, 1) for r in rows) and len(told) > 80
    assert area(told) > 0.97
    assert sum((s >= 0.5) == bool(y) for s, y in told) / len(told) > 0.92
    # calibrated: the mean score is near the share of good ones
    assert abs(sum(s for s, _ in told) / len(told) - sum(y for _, y in told) / len(told)) < 0.1


def test_languages_on_held_out_rows(spark):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{AT}/documents.parquet").select("doc_id", "lang").collect()}
    rows = [r for r in language.query(spark, AT).collect() if r["held_out"] and lang[r["doc_id"]] is not None and r["lang_pred"] != "und"]
    assert all(held_out(r["doc_id"], 4, 2) for r in rows) and len(rows) > 150
    right = {x: [r["lang_pred"] == x for r in rows if lang[r["doc_id"]] == x] for x in set(lang.values()) if x}
    assert sum(map(sum, right.values())) / len(rows) > 0.97
    assert all(sum(own) / len(own) > 0.9 for own in right.values() if len(own) >= 10)
