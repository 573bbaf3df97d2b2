"""Model-backed steps, reference entities and relations, alignment by label, and readers of other formats."""

import difflib
import json
import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import align, graph, mcq, mentions, models, oracle, truth
from factloom.plans import catalog
from factloom.sources import tables


def sentences(spark, texts):
    return spark.createDataFrame([(f"s{i}", i + 1, t) for i, t in enumerate(texts)], "sentence_id string, sent_ord long, text string")


def test_truth_entities_skip_the_check_of_single_candidates(spark):
    rows = sentences(spark, ["Something", "nothing of note", "Alphabet betting gammas", None, "done before", "brackets 《brackets》 、 sevenone"])
    done = spark.createDataFrame([("s4",)], "sentence_id string")
    asked = spark.sparkContext.accumulator(0)

    def check(row):
        asked.add(len(row["batch"]))
        assert all(len(s["mentions"]) > 1 for s in row["batch"])
        return models.verify(row)

    got = {(r["sentence_id"], r["mention"], r["start_char"], r["ent_type"]) for r in truth.entities(rows, done, check=check).collect()}
    assert got == {("s0", "Something", 0, "Other"), ("s1", "nothing", 0, "Other"), ("s2", "Alphabet", 0, "Org"), ("s2", "betting", 9, "Concept"), ("s5", "brackets", 0, "Org"), ("s5", "sevenone", 22, "Org")}
    assert asked.value >= 2
    assert {r["mention"] for r in truth.entities(rows, ask=lambda row: "no reply").collect()} == set()
    # what the check names is located anew whether or not it was a candidate
    extra = truth.entities(rows, check=lambda row: json.dumps([{"sentence_id": "s2", "entities": [{"mention": "betting gam"}, {"mention": "nowhere"}]}]))
    assert ("s2", "bettinggam") not in {(r["sentence_id"], r["mention"]) for r in extra.collect()}


def test_truth_entities_limits(spark):
    """Of 15 candidates, blank ones apart, the first 12 count; of those that the check names the first 6."""
    words = [f"Candidate{chr(97 + i)}" for i in range(15)]
    rows = sentences(spark, [" ".join(words), " ".join(reversed(words[:8])), "Alone here"])
    seen = spark.sparkContext.accumulator(0)
    ask = lambda row: json.dumps([{"sentence_id": s["sentence_id"], "mentions": ["", None, *s["text"].split()]} for s in row["batch"]])

    def check(row):
        for s in row["batch"]:
            seen.add(len(s["mentions"]))
        return json.dumps([{"sentence_id": s["sentence_id"], "entities": [{"mention": ""}, {"mention": None}, *({"mention": m, "ent_type": "T"} for m in s["mentions"][1:])]} for s in row["batch"]])

    got = {(r["sentence_id"], r["mention"]) for r in truth.entities(rows, ask=ask, check=check).collect()}
    want = set()
    for r in rows.collect():
        kept = r["text"].split()[:12]
        want |= {(r["sentence_id"], m) for m in (kept[1:][:6] if len(kept) > 1 else kept)}
    assert got == want and seen.value in (12 + 8 + 2, 2 * (12 + 8 + 2))


def test_truth_entities_query_keeps_every_mention(spark, tmp_path):
    """The query has no limit a sentence: of 31 candidates all are checked and all that the check names are kept, as its SQL says."""
    import duckdb

    words = [f"Candidate{chr(97 + i // 6)}{chr(97 + i % 6)}" for i in range(30)]
    long, short, late = " ".join([*words, "sixsix", words[0]]), " ".join(words[:7]), " ".join(["sixsix"] * 14 + words[:7])
    docs = spark.createDataFrame([(3, f"{long}. Single one. {short}!"), (4, "Already finished before."), (5, None), (6, late)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = [tuple(r) for r in catalog.QUERIES["truth_entities"](spark, str(tmp_path)).collect()]
    want = {("3:1", "Single", 0, "Other", 0.95)}
    for sentence, text, own in (("3:0", long, words), ("3:2", short, words[:7]), ("6:0", late, words[:7])):
        want |= {(sentence, w, text.index(w), "Law", 0.95) for w in own}
    assert set(rows) == want and len(rows) == len(want) == 45
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert sorted(con.execute(catalog.SQL["truth_entities"]).fetchall()) == sorted(rows)


def test_truth_relations_keep_candidates_that_the_check_names(spark):
    words = [(s, n, i, w, "Concept") for s, n, own in (("a", 1, ["one", "two", "three", "one"]), ("b", 2, ["single"]), ("c", 3, [f"w{i}" for i in range(14)])) for i, w in enumerate(own)]
    m = spark.createDataFrame(words, "sentence_id string, sent_ord long, ord int, mention string, ent_type string")

    def ask(row):
        pairs = {"a": [("one", "causes", "two"), ("one", "causes", "two"), ("one", "causes", "one"), ("one", "nonsense", "two"), ("one", "causes", "unknown"), ("two", "includes", "three")], "c": [(f"w{i}", "includes", f"w{i + 1}") for i in range(13)]}
        return json.dumps([{"sentence_id": s["sentence_id"], "relations": [dict(zip(("head", "relation_type", "tail"), p)) for p in pairs[s["sentence_id"]]]} for s in row["batch"]])

    same = lambda row: json.dumps([{"sentence_id": s["sentence_id"], "relations": [*s["relations"], {"head": "x", "relation_type": "causes", "tail": "y"}]} for s in row["batch"]])
    got = {(r["sentence_id"], r["head"], r["relation_type"], r["tail"]) for r in truth.relations(m, ask, same).collect()}
    assert got == {("a", "one", "causes", "two"), ("a", "two", "includes", "three"), *(("c", f"w{i}", "includes", f"w{i + 1}") for i in range(6))}
    assert truth.relations(m, ask, same, most=3).where("sentence_id = 'c'").count() == 1
    nodes = spark.createDataFrame([("n1", "one", "Concept"), ("n2", "two", "Concept")], "node_id string, name string, label string")
    assert [(r["src_id"], r["dst_id"]) for r in truth.edges(truth.relations(m, ask, same), nodes).collect()] == [("n1", "n2")]


def test_truth_entities_query_counts_words_without_ascii_letters(spark, tmp_path):
    import duckdb

    docs = spark.createDataFrame([(0, "èçèçéê. Alphabet èçèçéê. betting. Alphabet ñandúes éèéèéèéè!"), (2, "××××××. éééééééé ùùùùùùù")], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = [tuple(r) for r in catalog.QUERIES["truth_entities"](spark, str(tmp_path)).collect()]
    assert {(r[0], r[1], r[3]) for r in rows} >= {("0:0", "èçèçéê", "Other"), ("0:1", "Alphabet", "Org"), ("2:1", "ùùùùùùù", "Concept")}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert sorted(con.execute(catalog.SQL["truth_entities"]).fetchall()) == sorted(rows)


def test_rewriter_failures_keep_the_question(spark):
    q = spark.createDataFrame([("q1", "abcd", 10.0), ("q2", "abcde", 10.0), ("q3", "abcd", 90.0), ("q4", "abc", 10.0)], "qid string, question string, Q_total double")
    q = q.withColumns({f"option_{x}": F.lit(x) for x in "abcd"} | {"answer": F.lit("A")})
    got = {r["qid"]: (r["revised_question"], r["changed"], r["revision_reason"].split(":")[0]) for r in mcq.rewritten(q, attempts=2, pause=0).collect()}
    assert got == {"q1": ("Clearer: abcd", "yes", "clearer"), "q2": ("abcde", "no", "LLM_FAILED"), "q3": ("abcd", "no", ""), "q4": ("abc", "no", "clearer")}


def test_tagger_threshold_and_sentence_join(spark):
    rows = sentences(spark, ["longestword shorter tinyword"])
    assert [r["mention"] for r in mentions.tagged(rows).collect()] == ["longestword"]
    m = spark.createDataFrame([("s0", "x"), ("s9", "y")], "sentence_id string, mention string")
    assert [r["mention"] for r in mentions.with_sentences(m, rows, ["sentence_id"]).collect()] == ["x"]
    one, more = oracle.skip_verify(spark.createDataFrame([("a", "x"), ("b", "y"), ("b", "z")], "sentence_id string, mention string"))
    assert [r["ent_type"] for r in one.collect()] == ["Other"] and more.count() == 2


def plain_keys(b, t, least=0.88):
    keys = lambda rows: sorted({f"{n}||{x}" for n, x in rows}, key=lambda k: (-len(k), k))
    used, out = set(), {}
    for k in keys(b):
        name, found = k.split("||")[0], None
        if k in keys(t):
            found = k
        else:
            best = 0.0
            for other in keys(t):
                r = difflib.SequenceMatcher(None, name, other.split("||")[0]).ratio() if other.split("||")[0] else 0.0
                if r > best:
                    best, found = r, other
            found = found if best >= least else None
        out[k] = found if found not in used else None
        used |= {found}
    return out


def test_alignment_by_label_and_similarity(spark):
    r = random.Random(5)
    names = ["".join(r.choices("abc", k=r.randrange(1, 14))) for _ in range(60)] + ["", "a"]
    names += [n[:-1] + "z" for n in names if len(n) > 9] + [n + "q" for n in names if len(n) > 9]
    rows = lambda seed: [(n, random.Random(f"{n}{seed}").choice("xy")) for n in random.Random(seed).sample(names, 50)]
    b, t = rows(1), rows(2)
    df = lambda x: spark.createDataFrame(x, "name string, label string")
    got = {x["key"]: x["target"] if x["claimed"] else None for x in align.relaxed_keys(df(b), df(t)).collect()}
    assert got == plain_keys(b, t)


def test_seeds_fall_back_to_the_first_nodes(spark):
    nodes = spark.createDataFrame([(f"n{i}", i) for i in range(9)], "node_id string, ord long")
    changes = spark.createDataFrame([("n7", "n8", "kept"), ("n1", "n2", "added")], "src_id string, dst_id string, status string")
    ids = lambda d: sorted(r["node_id"] for r in d.collect())
    assert ids(graph.seeds(changes, nodes)) == ["n1", "n2"] and ids(graph.seeds(changes.where("status = 'kept'"), nodes, 3)) == ["n0", "n1", "n2"]
    assert [r["node_id"] for r in graph.repeated_ids(nodes.unionByName(nodes.limit(1))).collect()] == ["n0"]


def test_mention_ids_have_gaps(spark):
    m = spark.createDataFrame([(1, 0, "a"), (1, 1, "a"), (2, 0, "b")], "page long, ord long, mention string")
    assert [(r["entity_id"], r["mention"]) for r in graph.mention_ids(m, ["mention"], ["page", "ord"]).orderBy("entity_id").collect()] == [("e00001", "a"), ("e00003", "b")]


def test_other_formats(spark, tmp_path):
    (tmp_path / "s.tsv").write_text('﻿sentence_id\tpage_no\ttext\ns1\t2\tsay "hi"\textra\ns2\tx\tb\nshort\t1\n', encoding="utf-8")
    got = tables.read_positional(spark, str(tmp_path / "s.tsv"), ["sentence_id", "page_no", "text"]).orderBy("ord").collect()
    assert [tuple(r)[:3] for r in got] == [("s1", 2, 'say "hi"'), ("s2", None, "b")]
    one = spark.createDataFrame([("m", 0.5, None)], "metric string, value double, note string")
    tables.export_csv(one, str(tmp_path / "csv"), ["metric", "value"])
    raw = next((tmp_path / "csv").glob("part-*")).read_bytes()
    assert raw.startswith("﻿metric,value".encode())
    tables.write_object(one, str(tmp_path / "object"))
    assert json.loads(next((tmp_path / "object").glob("part-*")).read_text()) == {"metric": "m", "value": 0.5, "note": None}
    assert [(r["metric_name"], r["value"]) for r in tables.read_metrics(spark, str(tmp_path / "object")).collect()] == [("value", 0.5)]
    tables.write_json(one.withColumnRenamed("metric", "metric_name"), str(tmp_path / "records"))
    assert [(r["metric_name"], r["value"]) for r in tables.read_metrics(spark, str(tmp_path / "records")).collect()] == [("m", 0.5)]
    (tmp_path / "prompts").mkdir()
    (tmp_path / "prompts" / "bloom.txt").write_text("Write\nquestions", encoding="utf-8")
    assert tables.read_prompts(spark, str(tmp_path / "prompts")) == {"bloom": "Write\nquestions"}
    pages = spark.createDataFrame([(1, "a  b"), (2, None)], "page_no int, text string")
    pages.transform(tables.page_lines).coalesce(1).write.text(str(tmp_path / "pages"))
    back = tables.read_pages(spark, str(tmp_path / "pages")).orderBy("page_ord").collect()
    assert [(r["page_no"], r["text"]) for r in back] == [(1, "a b"), (2, "")]


def test_upserts_come_in_batches(spark):
    seen = spark.sparkContext.accumulator(0)
    tables.upsert_sink(spark.range(1201).coalesce(1), lambda batch: seen.add(len(batch) if len(batch) <= 500 else 10**6))
    assert seen.value == 1201


@pytest.mark.parametrize("writer", [models.write_questions, models.write_questions_bloom])
def test_written_questions_name_their_facts(spark, writer):
    facts = spark.createDataFrame([(0, i, f"s{i}", "causes", f"d{i}", f"f{i}", "") for i in range(5)] + [(1, 0, "s", "causes", "d", "f", "")], "chunk long, place long, src_name string, rel string, dst_name string, kg_fact string, context string")
    got = mcq.capped(mcq.generated(facts, writer)).orderBy("qid").collect()
    assert [(r["qid"], r["kg_fact"]) for r in got] == [("q0001", "f0"), ("q0002", "f1"), ("q0003", "f2"), ("q0004", "f")]
    assert all(r[f"option_{r['answer'].lower()}"] == "d" + r["kg_fact"][1:] for r in got)


def test_facts_of_a_chunk_are_gathered_once(spark):
    """Facts come back with the reply; they were gathered a second time and joined with it."""
    rows = [(i, i // 2, i % 2, f"s{i}", "r", 'd"\\ü\n', f"k{i}", None) for i in range(4)]
    chunks = spark.createDataFrame(rows, "ord long, chunk long, place long, src_name string, rel string, dst_name string, kg_fact string, context string")
    got = mcq._replies(chunks, lambda row: str(len(row["facts"])))
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    told = {r["chunk"]: r for r in got.collect()}
    assert told[1]["reply"] == "2" and told[1]["n_facts"] == 2 and tuple(told[1]["facts"][1]) == (1, "s3", "r", 'd"\\ü\n', "k3", None)


def test_truth_relations_join_nothing_before_the_check(spark, monkeypatch):
    """Types of ends were joined to the candidates, which shuffled all mentions again; they come back with the reply."""
    plans = []
    cut = truth.cut if hasattr(truth, "cut") else None
    monkeypatch.setattr(truth, "cut", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df, name), raising=False)
    rows = [("a", 1, 0, "one", "X"), ("a", 1, 1, "two", None), ("a", 1, 2, "one", "Z"), ("b", 9, 0, "one", "X"), ("b", 9, 1, "six", "Y")]
    m = spark.createDataFrame(rows, "sentence_id string, sent_ord long, ord int, mention string, ent_type string")
    r = lambda h, t: {"head": h, "relation_type": "causes", "tail": t}
    ask = lambda row: json.dumps([{"sentence_id": s["sentence_id"], "relations": [r("one", "two"), r("one", "two"), r("two", "gone"), r("one", "six")]} for s in row["batch"]])
    same = lambda row: json.dumps([{"sentence_id": s["sentence_id"], "relations": s["relations"]} for s in row["batch"]])
    got = {tuple(x) for x in truth.relations(m, ask, same).select("sentence_id", "pair", "head", "tail", "head_type", "tail_type").collect()}
    assert got == {("a", 0, "one", "two", "X", None), ("b", 3, "one", "six", "X", "Y")}
    assert len(plans) == 1 and "Join" not in plans[0]
