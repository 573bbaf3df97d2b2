"""Mentions, graphs, alignment and structure on small tables, against plain versions of the same."""

import itertools
import random

from pyspark.sql import functions as F

from factloom.operators import align, graph, mentions, structure
from factloom.operators.components import components
from factloom.operators.ids import ordinals
from factloom.plans import catalog
from factloom.plans.demo import graphs

NODE, EDGE = "node_id string, name string, label string, ord long", "edge_id string, src_id string, dst_id string, relation_type string, confidence double, ord long"


def nodes_edges(spark, names, triples):
    n = spark.createDataFrame([(i, x, "L", k) for k, (i, x) in enumerate(names)], NODE)
    e = spark.createDataFrame([(f"e{k}", s, d, r, 0.5 + k / 100, k) for k, (s, r, d) in enumerate(triples)], EDGE)
    return n, e


def test_components_match_a_plain_search(spark):
    draw = random.Random(5)
    for n, m in ((1, 0), (30, 20), (60, 70), (50, 49)):
        pairs = [(draw.randrange(n), draw.randrange(n)) for _ in range(m)] if m != 49 else [(i, i + 1) for i in range(49)]
        top = list(range(n))

        def find(x, top=top):
            while top[x] != x:
                x = top[x]
            return x

        for a, b in pairs:
            top[max(find(a), find(b))] = min(find(a), find(b))
        got = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
        assert got == {x: find(x) for p in pairs for x in p}


def test_ordinals_are_dense_for_any_number_of_partitions(spark):
    rows = [(x,) for x in random.Random(1).sample(range(10_000), 500)]
    for n in (1, 7):
        got = ordinals(spark.createDataFrame(rows, "x long").repartition(n), ["x"]).collect()
        assert {r["x"]: r["n"] for r in got} == {x: i for i, (x,) in enumerate(sorted(rows), 1)}
    assert ordinals(spark.createDataFrame([], "x long"), ["x"]).count() == 0


def plain_overlaps(ents):
    kept = []
    for e in sorted(ents, key=lambda x: (x[0], x[0] - x[1])):
        for k in kept:
            if e[1] > k[0] and e[0] < k[1]:
                if e[1] - e[0] < k[1] - k[0] or (e[1] - e[0] == k[1] - k[0] and e[2] <= k[2]):
                    break
                kept.remove(k)
                kept.append(e)
                break
        else:
            kept.append(e)
    return sorted(kept)


def test_overlaps_match_the_plain_loop(spark):
    draw, rows, want = random.Random(3), [], {}
    for s in range(60):
        ents = []
        for i in range(draw.randrange(8)):
            a = draw.randrange(12)
            ents.append((a, a + draw.randrange(1, 6), draw.choice([0.5, 0.7]), i))
            rows.append((str(s), "T", *ents[-1]))
        want[str(s)] = plain_overlaps(ents)
    df = spark.createDataFrame(rows, "sentence_id string, ent_type string, start_char int, end_char int, confidence double, ord int")
    got = {}
    for r in mentions.resolve_overlaps(df).collect():
        got.setdefault(r["sentence_id"], []).append((r["start_char"], r["end_char"], r["confidence"], r["ord"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}


def test_overlaps_of_a_hot_sentence(spark):
    """100,000 mentions of one sentence, in one group; spans without length and nulls among others."""
    import time

    draw = random.Random(4)
    spans = [(a := draw.randrange(400_000), a + draw.randrange(1, 12), draw.choice([0.5, 0.7]), i) for i in range(100_000)]
    df = spark.createDataFrame([("s", "T", *x) for x in spans], "sentence_id string, ent_type string, start_char int, end_char int, confidence double, ord int").cache()
    df.count()
    began = time.time()
    got = sorted(tuple(r)[2:] for r in mentions.resolve_overlaps(df).collect())
    assert time.time() - began < 60
    # the plain loop over stretches that no mention crosses
    want, part, end = [], [], -1
    for x in sorted(spans):
        if x[0] >= end:
            want += plain_overlaps(sorted(part, key=lambda x: (x[0], x[0] - x[1], x[3])))
            part = []
        part.append(x)
        end = max(end, x[1])
    want += plain_overlaps(sorted(part, key=lambda x: (x[0], x[0] - x[1], x[3])))
    assert got == sorted(want)
    odd = [("s", "T", None, 4, 0.5, 0), ("s", "T", 3, None, 0.5, 1), ("s", "T", 2, 6, None, 2), ("s", "T", 3, 3, 0.9, 3), ("s", "T", 2, 2, 0.9, 4), ("s", None, 2, 5, 0.9, 5), (None, None, 2, 5, 0.9, 6), ("s", "T", 2, 6, 0.5, 7)]
    odd = spark.createDataFrame(odd, df.schema)
    assert sorted(r["ord"] for r in mentions.resolve_overlaps(odd).collect()) == [0, 1, 4, 5, 6, 7]
    assert mentions.resolve_overlaps(odd.where("false")).count() == 0


def test_far_neighbours_by_frontiers(spark):
    """Six steps and more on a random graph, a path and a star, against a plain walk; the plan grows by a table a step."""
    draw = random.Random(6)
    pairs = [(f"p{i}", f"p{i + 1}") for i in range(9)] + [(f"r{draw.randrange(60)}", f"r{draw.randrange(60)}") for _ in range(70)] + [("hub", f"l{i}") for i in range(50)] + [("p2", "nowhere")]
    known = {x for p in pairs for x in p} - {"nowhere"}
    n = spark.createDataFrame([(x, i) for i, x in enumerate(sorted(known))], "node_id string, ord long")
    e = spark.createDataFrame(pairs, "src_id string, dst_id string")
    near = {x: set() for x in known}
    for a, b in pairs:
        if a != b and {a, b} <= known:
            near[a].add(b)
            near[b].add(a)

    def walk(seeds, k):
        at, front = {s: 0 for s in seeds if s in known}, [s for s in seeds if s in known]
        for i in range(1, k + 1):
            front = [v for v in sorted({v for u in front for v in near[u]}) if v not in at]
            at |= {v: i for v in front}
        return at

    for seeds, k in ((["p0"], 6), (["p0", "r1", "gone"], 12), (["hub"], 1), (["l3"], 6), (["gone"], 3), (["p5"], 0)):
        got = graph.within(n, e, spark.createDataFrame([(s,) for s in seeds], "node_id string"), k)
        assert {(r["node_id"], r["hops"]) for r in got.collect()} == set(walk(seeds, k).items()), (seeds, k)
    scans = lambda k: graph.within(n, e, n.where("node_id = 'p0'"), k)._jdf.queryExecution().optimizedPlan().toString().count("Relation [")
    assert scans(2) <= 3 and scans(6) <= 7


def plain_relaxed(b, t, least=0.88):
    from difflib import SequenceMatcher

    order = lambda xs: sorted(set(xs), key=lambda x: (-len(x), x))
    out, used = {}, set()
    for x in order(b):
        if x in t:
            c = x
        else:
            c = next((y for y in order(t) if y and (x in y or y in x)), None)
            if c is None:
                best = max(((SequenceMatcher(None, x, y).ratio(), -i, y) for i, y in enumerate(order(t))), default=None)
                c = best[2] if best and best[0] >= least else None
        out[x] = (c, c is not None and c not in used)
        if c is not None:
            used.add(c)
    return out


def test_relaxed_names_match_the_plain_loop(spark):
    draw = random.Random(9)
    word = lambda: "".join(draw.choices("abcd", k=draw.randrange(1, 12)))
    b, t = [word() for _ in range(60)], [word() for _ in range(60)]
    t += [x + draw.choice("abcd") for x in b[:10]] + [x[:5] + "z" + x[6:] for x in b[10:20] if len(x) > 8]
    got = align.relaxed_names(spark.createDataFrame([(x,) for x in b], "name string"), spark.createDataFrame([(x,) for x in t], "name string")).collect()
    want = plain_relaxed(b, t)
    assert {r["name"]: (r["target"], r["claimed"]) for r in got} == {k: ((c, u)) for k, (c, u) in want.items()}


def test_strict_counts_and_empty_tables(spark):
    b = nodes_edges(spark, [("1", "a"), ("2", " b  c"), ("3", "b c")], [("1", "r", "2"), ("1", "r", "3"), ("1", "r", "9")])
    t = nodes_edges(spark, [("x", "a"), ("y", "b c"), ("z", "d")], [("x", "r", "y"), ("x", "r", "z")])
    got = {r["metric_name"]: r["value"] for r in align.report(*b, *t).collect()}
    assert (got["strict_entity_tp"], got["strict_entity_fp"], got["strict_entity_fn"]) == (2, 0, 1)
    assert (got["strict_relation_tp"], got["strict_relation_fp"], got["strict_relation_fn"]) == (1, 0, 1)
    assert len(got) == 35
    empty = nodes_edges(spark, [], [])
    assert all(v == 0 for v in (r["value"] for r in align.report(*empty, *empty).collect()))


def test_structure_on_a_triangle_with_a_tail(spark):
    n, e = nodes_edges(spark, [(x, x) for x in "abcde"], [("a", "r", "b"), ("b", "r", "c"), ("c", "r", "a"), ("c", "r", "d"), ("c", "r", "d"), ("d", "s", "d")])
    q = {r["metric"]: r["value"] for r in structure.quality(n, e).collect()}
    assert q["avg_degree"] == 8 / 5
    assert abs(q["clustering_coefficient"] - (1 + 1 + 1 / 3) / 3) < 1e-12
    assert q["giant_component_ratio"] == 0.8
    assert abs(q["duplicate_ratio"] - 1 / 6) < 1e-12 and abs(q["self_loop_ratio"] - 1 / 6) < 1e-12
    none = {r["metric"]: r["value"] for r in structure.quality(*nodes_edges(spark, [], [])).collect()}
    assert none["consistency_score"] == 1 and none["conciseness_score"] == 0 and none["avg_degree"] == 0


def test_walks_and_merges(spark):
    n, e = nodes_edges(spark, [(x, x.upper() if x == "e" else x) for x in "abcde"], [("a", "r", "b"), ("b", "r", "c"), ("c", "r", "d")])
    seeds = spark.createDataFrame([("a",), ("none",)], "node_id string")
    assert {(r[0], r[1]) for r in graph.within(n, e, seeds, 2).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    twin = n.unionByName(spark.createDataFrame([("f", "B", "L", 9)], NODE))
    more = e.unionByName(spark.createDataFrame([("e9", "f", "b", "r", 0.1, 9), ("e8", "d", "f", "r", 0.1, 10)], EDGE))
    mapped, edges = graph.merge_names(twin, more)
    assert {r["node_id"]: r["kept_id"] for r in mapped.collect()}["f"] == "b"
    assert {tuple(r) for r in edges.collect()} == {("a", "r", "b"), ("b", "r", "c"), ("c", "r", "d"), ("d", "r", "b")}
    assert {(r["src_id"], r["status"]) for r in graph.diff(e, e.where("src_id <> 'a'"), ["src_id"]).collect()} == {("a", "removed"), ("b", "kept"), ("c", "kept")}


def test_adjacent_pairs_skip_repeats_and_stop_at_the_limit(spark):
    rows = [("s", "x" if i % 5 < 2 else f"m{i}", "T", i, i + 1, 0.8, i) for i in range(60)]
    df = spark.createDataFrame(rows, "sentence_id string, mention string, ent_type string, start_char int, end_char int, confidence double, ord int")
    got = [(r["head"], r["tail"]) for r in graph.adjacent_pairs(df).orderBy("pair").collect()]
    want = [(a[1], b[1]) for a, b in itertools.pairwise(rows) if a[1] != b[1]][:20]
    assert got == want
    assert graph.adjacent_pairs(df.where(F.lit(False))).count() == 0


def test_components_of_the_whole_graph_match_a_plain_search(spark):
    at = "/root/testdata/sf0.001"
    nodes, edges, _, _ = (x.collect() for x in graphs(spark, at))
    near = {r["node_id"]: set() for r in nodes}
    for r in edges:
        if r["src_id"] in near and r["dst_id"] in near:
            near[r["src_id"]].add(r["dst_id"])
            near[r["dst_id"]].add(r["src_id"])
    want = {}
    for n in sorted(near):
        todo = [n] if n not in want else []
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = n
                todo += near[x]
    assert {r["node_id"]: r["component"] for r in catalog.QUERIES["struct_components_whole"](spark, at).collect()} == want


def test_relaxed_queries_go_on_to_similarity(spark, monkeypatch):
    b = nodes_edges(spark, [("1", "alpha beta gamma"), ("2", "delta"), ("3", "omega")], [("1", "r", "2"), ("3", "r", "2")])
    t = nodes_edges(spark, [("1", "alpha bexa gamma"), ("2", "delta one")], [("1", "r", "2")])
    monkeypatch.setattr(catalog, "graphs", lambda *_: (*b, *t))
    got = {r["name"]: (r["target"], r["stage"], r["claimed"]) for r in catalog.QUERIES["align_relaxed_claim"](spark, "").collect()}
    assert got == {"alpha beta gamma": ("alpha bexa gamma", "similarity", True), "delta": ("delta one", "substring", True), "omega": (None, "none", False)}
    value = {r["metric_name"]: r["value"] for r in catalog.QUERIES["align_relaxed_triples"](spark, "").collect()}
    assert (value["relaxed_entity_tp"], value["relaxed_entity_fp"], value["relaxed_relation_tp"], value["relaxed_relaxed_dropped_edges_unmapped_endpoints"]) == (2, 1, 1, 1)


def test_components_need_no_distinct_neighbours(spark, monkeypatch):
    """The edges, in either direction and repeated, are united as they come; unknown ends and loops link nothing."""
    monkeypatch.setattr(structure, "neighbours", lambda *_: (_ for _ in ()).throw(AssertionError("all neighbours, both ways")))
    nodes = spark.createDataFrame([(x,) for x in "abcdefg"], "node_id string")
    edges = spark.createDataFrame([("b", "a"), ("a", "b"), ("b", "c"), ("b", "c"), ("d", "d"), ("e", "x"), ("x", "f"), ("g", None)], "src_id string, dst_id string")
    got = {tuple(r) for r in structure.component_sizes(nodes, edges).collect()}
    assert got == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "e"), ("f", "f"), ("g", "g")}


def test_merged_edges_leave_no_steps_behind(spark, monkeypatch):
    """A step's table goes when the next one is there; the surest edge of a key stays, the first of equals, numbered by the key's first."""
    gone, drop = [], graph.drop
    monkeypatch.setattr(graph, "drop", lambda *t: gone.extend(t) or drop(*t), raising=False)
    nodes = spark.createDataFrame([("x", "1", "A", "L", 1), ("x", "2", "B", "L", 2), ("y", "7", "B", "L", 1), ("y", "8", "A", "L", 2)], "kg string, node_id string, name string, label string, ord long")
    rows = [("x", "e1", "1", "2", "r", 0.5, 1), ("x", "e2", "2", "2", "r", 0.9, 2), ("y", "f1", "8", "7", "r", 0.7, 1), ("y", "f2", "8", "7", "r", 0.7, 2), ("y", "f3", "7", "8", "r", None, 3), ("y", "f4", "7", "9", "r", 0.1, 4)]
    edges = spark.createDataFrame(rows, "kg string, edge_id string, src_id string, dst_id string, relation_type string, confidence double, ord long")
    got = [tuple(r) for r in graph.merge_edges(edges, nodes, graph.merge_nodes(nodes)).orderBy("global_edge_id").collect()]
    assert got == [("ge00001", "g00001", "g00002", "r", 0.7, "f1", "y"), ("ge00002", "g00002", "g00001", "r", None, "f3", "y")]
    assert len(gone) == 2
