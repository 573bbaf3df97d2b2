"""Questions, suggestions and the application of change logs."""

import random

from factloom.operators import evolve, mcq
from factloom.plans import catalog, demo

NODE = "node_id string, label string, name string, page_no string, sentence_id string, ord long"
EDGE = "edge_id string, src_id string, dst_id string, relation_type string, confidence string, page_no string, sentence_id string, ord long"
LOG = "update_id string, qid string, action string, entity1_name string, entity2_name string, entity1_id string, entity2_id string, relation_type_old string, relation_type_new string"


def plain_apply(nodes, edges, log):
    nodes, edges = [list(n) for n in nodes], [list(e) for e in edges]
    seen = {(e[1], e[2], e[3]) for e in edges}
    n_id, e_id = max(int(n[0][1:]) for n in nodes), max(int(e[0][1:]) for e in edges)
    key = lambda s: " ".join(s.lower().split())
    rank = {"add_node": 0, "add_edge": 1, "remove_edge": 2}
    for _, _, action, a, b, ia, ib, old, new in sorted(log, key=lambda u: (u[1], rank.get(u[2], 99), u[0])):
        ids = lambda name, given: [x for x in given.split(",") if x] or [n[0] for n in nodes if key(n[2]) == key(name)]
        if action == "add_node" and key(a) and all(key(n[2]) != key(a) for n in nodes):
            n_id += 1
            nodes.append([f"n{n_id:05d}", "Concept", a])
        elif action == "add_edge":
            for s in ids(a, ia):
                for d in ids(b, ib):
                    rel = new or "related_to"
                    if (s, d, rel) not in seen and (d, s, rel) not in seen:
                        e_id += 1
                        edges.append([f"e{e_id:05d}", s, d, rel])
                        seen.add((s, d, rel))
        elif action == "remove_edge" and ia and ib:
            edges = [e for e in edges if not ({e[1], e[2]} == {ia, ib} and (not old or e[3] == old))]
    return {(n[0], n[2]) for n in nodes}, {tuple(e[:4]) for e in edges}


def test_apply_matches_the_plain_loop(spark):
    draw = random.Random(4)
    for _ in range(3):
        nodes = [(f"n{i:05d}", "L", draw.choice("ABCDEF") + str(i % 3), "1", "", i) for i in range(1, 8)]
        edges = [(f"e{i:05d}", draw.choice(nodes)[0], draw.choice(nodes)[0], draw.choice("rs"), "0.9", "1", "", i) for i in range(1, 9)]
        edges = [e for e in edges if e[1] != e[2]] or [("e00001", "n00001", "n00002", "r", "0.9", "1", "", 1)]
        names = [n[2] for n in nodes] + ["new x", "NEW  x", "y", ""]
        log = []
        for i in range(25):
            action = draw.choice(["add_node", "add_edge", "add_edge", "remove_edge", "other"])
            given = action == "remove_edge" or draw.random() < 0.2
            log.append((f"u{i:05d}", draw.choice(["q1", "q2", "q3"]), action, draw.choice(names), draw.choice(names), draw.choice(nodes)[0] if given else "", draw.choice(nodes)[0] if given else "", draw.choice(["", "r"]), draw.choice(["", "r", "s"])))
        n, e = evolve.apply(spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE), spark.createDataFrame(log, LOG))
        got = {(r["node_id"], r["name"]) for r in n.collect()}, {(r["edge_id"], r["src_id"], r["dst_id"], r["relation_type"]) for r in e.collect()}
        assert got == plain_apply([x[:5] for x in nodes], [x[:7] for x in edges], log)


def small(spark):
    n = spark.createDataFrame([("n1", "L", "Alpha", "1", "", 1), ("n2", "L", "Beta", "1", "", 2)], NODE)
    e = spark.createDataFrame([("e1", "n1", "n2", "r", "0.9", "1", "", 1)], EDGE)
    t = spark.createDataFrame([("t1", "L", "alpha", "1", "", 1), ("t2", "L", "beta", "1", "", 2), ("t3", "L", "Gamma", "1", "", 3)], NODE)
    u = spark.createDataFrame([("x1", "t1", "t3", "causes", "1", "1", "", 1), ("x2", "t2", "t1", "defines", "1", "1", "", 2)], EDGE)
    return n, e, t, u


def test_feedback_and_safety_net(spark):
    n, e, t, u = small(spark)
    rev = spark.createDataFrame([("q1", "about alpha", "about alpha and gamma", "yes", "why"), ("q2", "beta", "beta alpha", "no", "")], "qid string, original_question string, revised_question string, changed string, revision_reason string")
    got = {(r["qid"], r["action"], r["entity1_name"], r["entity2_name"], r["relation_type_new"]) for r in evolve.feedback(rev, n, e, t, u).collect()}
    assert got == {("q1", "add_node", "Gamma", "", ""), ("q1", "add_edge", "Gamma", "alpha", "causes")}
    assert [r["entity1_name"] for r in evolve.safety_nodes(n, t).collect()] == ["Gamma"]
    assert [(r["entity1_name"], r["entity2_name"], r["relation_type_new"]) for r in evolve.safety_edges(n, e, t, u).collect()] == [("beta", "alpha", "defines")]
    log = evolve.suggestions(rev, n, e, t, u).collect()
    assert [r["update_id"] for r in sorted(log, key=lambda r: r["update_id"])] == [f"u{i:05d}" for i in range(1, len(log) + 1)]
    assert not [r for r in log if r["qid"] != "q1" and r["entity1_name"] == "Gamma" and r["action"] == "add_node"]


def test_legacy_suggestions(spark):
    n, e, _, _ = small(spark)
    rev = spark.createDataFrame([("q1", "Alpha and Beta", "only Alpha"), ("q2", "x", "Alpha")], "qid string, original_question string, revised_question string")
    got = {(r["qid"], r["action"], r["entity1_id"], r["entity2_id"]) for r in evolve.legacy(rev, n, e).collect()}
    assert got == {("q1", "remove_edge", "n1", "n2")}


def test_scores(spark):
    n, e, _, _ = small(spark)
    q = spark.createDataFrame(
        [("q1", "what of alpha?", "Beta", "x", "y", "z", "a", "n1|r|n2"), ("q2", "none", "x", "y", "z", "w", "B", None), ("q3", "Alpha", "nothing", "Beta", "y", "z", "A", "Alpha|r|Beta")],
        "qid string, question string, option_a string, option_b string, option_c string, option_d string, answer string, kg_fact string",
    )
    r = {x["qid"]: x for x in mcq.evaluate(q, n, e).collect()}
    assert r["q1"]["entities_matched"] == ["alpha", "beta"]
    assert (r["q1"]["A_entity_relation_coverage_score"], r["q1"]["C_entity_alignment_score"], r["q1"]["D_relation_correctness_score"]) == (90, 100, 100)
    assert (r["q2"]["ent_cnt"], r["q2"]["rel_cnt"], r["q2"]["A_entity_relation_coverage_score"], r["q2"]["C_entity_alignment_score"]) == (0, 0, 0, 0)
    # no entity in the right option: nothing to align, but the fact itself holds
    assert (r["q3"]["C_entity_alignment_score"], r["q3"]["D_relation_correctness_score"]) == (0, 100)
    s = mcq.suite(mcq.evaluate(q, n, e)).first()
    assert s["num_questions"] == 3
    assert mcq.suite(mcq.evaluate(q.where("false"), n, e)).first()["suite_total"] == 0


def test_every_order_yields_a_revision(spark):
    at = "/root/testdata/sf0.001"
    orders = {str(r[0]) for r in spark.read.parquet(f"{at}/orders.parquet").select("o_orderkey").collect()}
    assert sorted(r["qid"] for r in demo.frame(spark, at, catalog._REV).collect()) == sorted(orders)


def test_questions_of_the_same_texts_are_looked_up_once(spark, monkeypatch):
    """The texts before and after a revision went through the dictionary one after the other, once a question."""
    seen, held = [], evolve._held
    monkeypatch.setattr(evolve, "_held", lambda texts, names: seen.append(texts) or held(texts, names))
    rows = [(f"q{i}", "about Alpha of Beta.", "about Alpha of Beta in Gamma?", "yes", f"r{i}") for i in range(50)] + [("q0", "Gamma", "Alpha", "yes", "again"), (None, "Alpha Gamma", "Alpha", "yes", "none")]
    asked = spark.createDataFrame(rows, "qid string, original_question string, revised_question string, changed string, revision_reason string")
    nodes = spark.createDataFrame([("a", "Alpha", 1), ("b", "Beta", 2), ("g", "Gamma", 3)], "node_id string, name string, ord long")
    edges = spark.createDataFrame([("e", "a", "g", "near", 1)], "edge_id string, src_id string, dst_id string, relation_type string, ord long")
    got = evolve.feedback(asked, nodes, edges, nodes, edges).collect()
    assert len(seen) == 1 and sorted(r["qid"] for r in got) == sorted(f"q{i}" for i in range(1, 50))
    assert {(r["entity1_name"], r["entity2_name"], r["relation_type_new"]) for r in got} == {("Gamma", "Alpha", "near")}
    got = evolve.legacy(asked, nodes, edges).collect()
    assert len(seen) == 2 and seen[1].distinct().count() == 4 and None not in {r["qid"] for r in got}
    assert {(r["action"], r["entity1_name"], r["entity2_name"]) for r in got if r["qid"] != "q0"} == {("add_edge", "Gamma", "Beta")}
