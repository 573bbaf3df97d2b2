"""Change logs: suggestions from revised questions and from a reference graph, and their application as set algebra.

A log row is update_id, qid, action (add_node, add_edge, remove_edge), entity1_name, entity2_name, entity1_id, entity2_id,
relation_type_old, relation_type_new, reason, revision_reason.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from factloom.config import CONFIG, GENERIC_RELATIONS
from factloom.functions import text as T
from factloom.operators.dictionary import held as _held
from factloom.operators.ids import first_by, largest_suffix, ordinals, prefix_of
from factloom.shared import cut, touching


def _rank() -> Column:
    c = F.when(F.col("action") == "add_node", 0)
    return c.when(F.col("action") == "add_edge", 1).when(F.col("action") == "remove_edge", 2).otherwise(99)


def names(nodes: DataFrame) -> DataFrame:
    """(k, name, ord): the first spelling of each matched name, in file order."""
    return first_by(nodes.select(T.matched("name").alias("k"), "name", "ord").where("k <> ''"), ["k"], ["ord"])


def named_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct (a, b, rel) over matched names."""
    n = nodes.select("node_id", T.matched("name").alias("k")).where("k <> ''")
    end = lambda c, o: n.select(F.col("node_id").alias(c), F.col("k").alias(o))
    return edges.join(end("src_id", "a"), "src_id").join(end("dst_id", "b"), "dst_id").select("a", "b", F.col("relation_type").alias("rel")).distinct()


def mentioned(texts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(id, k): vocabulary names (k) that a text (id, text) holds. Equal texts are looked at once."""
    folded = cut(texts.select("text").distinct().select("text", T.matched("text").alias("o")), "folded")
    held = folded.join(_held(folded.select("o"), vocabulary.select("k")), "o").select("text", F.col("i").alias("k"))
    return texts.join(held, "text").select("id", "k").distinct()


def _classes(revisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((qid, cls) of revised questions; (cls, before, after) of their texts): questions of the same texts, original and revised, are one class."""
    own = revisions.where("qid is not null").groupBy("qid").agg(F.array_sort(F.collect_set(F.struct(F.col("original_question").alias("before"), F.col("revised_question").alias("after")))).alias("pairs"))
    own = cut(own, "asked")
    classes = cut(own.select("pairs").distinct().withColumn("cls", F.monotonically_increasing_id()), "classes")  # numbered once
    asked = cut(own.join(classes, "pairs").select("qid", "cls"), "asked")
    return asked, classes.select("cls", F.inline("pairs"))


def _named(classes: DataFrame, find: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(cls, k, had, has): whether the texts of a class name k before and after; ``find``: names (id, k) of texts (id, text)."""
    sides = F.array(*[F.struct(F.lit(c).alias("side"), F.col(c).alias("text")) for c in ("before", "after")])
    found = find(classes.select("cls", F.explode(sides).alias("x")).select(F.struct("cls", "x.side").alias("id"), "x.text"))
    side = lambda c: F.max(F.col("id.side") == c)
    return cut(found.groupBy(F.col("id.cls").alias("cls"), "k").agg(side("before").alias("had"), side("after").alias("has")), "found")


def feedback(revisions: DataFrame, nodes: DataFrame, edges: DataFrame, t_nodes: DataFrame, t_edges: DataFrame, edges_each: int = CONFIG.feedback_edges, nodes_each: int = CONFIG.feedback_nodes, named: DataFrame | None = None) -> DataFrame:
    """Suggestions from changed questions: a pair of a newly named and a still named entity that the reference relates becomes an edge,
    with the least of its relations; a new entity of such an edge that the graph lacks and the reference has becomes a node. ``named``: the reference's ``named_edges``, if they are there."""
    mine, ref = cut(names(nodes), "names"), cut(names(t_nodes), "names")
    vocabulary = mine.select("k").unionByName(ref.select("k")).distinct()
    changed = revisions.where(F.lower("changed") == "yes")
    asked, classes = _classes(changed)
    found = _named(classes, lambda texts: mentioned(texts, vocabulary)).where("has")
    added, stayed = found.where("not had").select("cls", F.col("k").alias("a")), found.where("had").select("cls", F.col("k").alias("b"))
    # only reference edges of a name that some question adds
    new = added.select(F.col("a").alias("k")).distinct()
    if named is None:
        ids = t_nodes.select("node_id", T.matched("name").alias("k")).join(new, "k", "left_semi").select("node_id")
        te = named_edges(t_nodes, touching(t_edges, ["src_id", "dst_id"], ids))
    else:
        te = touching(named, ["a", "b"], new)
    pairs = te.select(F.least("a", "b").alias("p"), F.greatest("a", "b").alias("q"), "rel").groupBy("p", "q").agg(F.min("rel").alias("rel"))
    both = pairs.select(F.col("p").alias("a"), F.col("q").alias("b"), "rel").unionByName(pairs.select(F.col("q").alias("a"), F.col("p").alias("b"), "rel")).distinct()
    # reference edges drive the join, so a question's names are never multiplied out
    one_each = first_by(added.join(both, "a").join(stayed, ["cls", "b"]), ["cls", "a"], ["b"])
    w = Window.partitionBy("cls").orderBy("a", "b")
    chosen = one_each.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= edges_each)
    canon = lambda c, o: ref.select(F.col("k").alias(c), F.col("name").alias(f"_t{o}"))
    own = lambda c, o: mine.select(F.col("k").alias(c), F.col("name").alias(f"_m{o}"))
    chosen = chosen.join(canon("a", 1), "a", "left").join(canon("b", 2), "b", "left").join(own("a", 1), "a", "left").join(own("b", 2), "b", "left")
    chosen = cut(chosen.join(asked, "cls").drop("cls").join(changed.select("qid", "revision_reason"), "qid"), "chosen")
    blank = F.lit("")
    edge = chosen.select("qid", F.lit("add_edge").alias("action"), F.coalesce("_t1", "_m1", "a").alias("entity1_name"), F.coalesce("_t2", "_m2", "b").alias("entity2_name"), F.col("rel").alias("relation_type_new"), F.lit("feedback-driven").alias("reason"), "revision_reason")
    need = chosen.where("_m1 is null and _t1 is not null").select("qid", "a", "_t1", "revision_reason").distinct()
    need = need.withColumn("_r", F.row_number().over(Window.partitionBy("qid").orderBy("a"))).where(F.col("_r") <= nodes_each)
    node = need.select("qid", F.lit("add_node").alias("action"), F.col("_t1").alias("entity1_name"), blank.alias("entity2_name"), blank.alias("relation_type_new"), F.lit("feedback-driven").alias("reason"), "revision_reason")
    return node.unionByName(edge)


def _first_share(rows: DataFrame, order: list, ratio: float, most: int) -> DataFrame:
    """The first ``ratio`` of all rows in ``order``, which must be total, but ``most`` of them at most, numbered by _n."""
    seen = Observation()
    top = cut(rows.observe(seen, F.count("*").alias("n")).orderBy(*order).limit(most), "first")
    return top.withColumn("_n", F.row_number().over(Window.orderBy(*order))).where(F.col("_n") <= math.floor(ratio * seen.get["n"] + 0.9999))


def safety_nodes(nodes: DataFrame, t_nodes: DataFrame, planned: DataFrame | None = None, ratio: float = CONFIG.safety_ratio, most: int = CONFIG.safety_most) -> DataFrame:
    """The first part of the reference's names that neither the graph nor the plan (column k) has, in reference order."""
    gone = names(nodes).select("k") if planned is None else names(nodes).select("k").unionByName(planned.select("k"))
    return _first_share(names(t_nodes).join(gone.distinct(), "k", "left_anti"), ["ord"], ratio, most).select(F.col("name").alias("entity1_name"), F.col("_n").alias("place"))


def safety_edges(nodes: DataFrame, edges: DataFrame, t_nodes: DataFrame, t_edges: DataFrame, planned: DataFrame | None = None, ratio: float = CONFIG.safety_ratio, most: int = CONFIG.safety_most, named: DataFrame | None = None) -> DataFrame:
    """The first part of the reference's directed edges that neither the graph nor the plan (a, b, rel) has and whose ends the graph has: specific
    relations before generic ones, longer names before shorter, then by relation and names. ``named``: the reference's ``named_edges``, if they are there."""
    mine, ref = names(nodes).select("k"), names(t_nodes)
    gone = named_edges(nodes, edges)
    gone = gone if planned is None else gone.unionByName(planned.select("a", "b", "rel"))
    miss = (named_edges(t_nodes, t_edges) if named is None else named).join(gone, ["a", "b", "rel"], "left_anti")
    miss = miss.join(mine.withColumnRenamed("k", "a"), "a", "left_semi").join(mine.withColumnRenamed("k", "b"), "b", "left_semi")
    miss = miss.withColumns({"_g": T.strip(F.lower("rel")).isin(*GENERIC_RELATIONS).cast("int"), "_w": -(F.length("a") + F.length("b"))})
    top = _first_share(miss, ["_g", "_w", "rel", "a", "b"], ratio, most)
    canon = lambda c, o: ref.select(F.col("k").alias(c), F.col("name").alias(o))
    return top.join(canon("a", "entity1_name"), "a").join(canon("b", "entity2_name"), "b").select("entity1_name", "entity2_name", F.col("rel").alias("relation_type_new"), F.col("_n").alias("place"))


def suggestions(revisions: DataFrame, nodes: DataFrame, edges: DataFrame, t_nodes: DataFrame, t_edges: DataFrame, safety_id: str = "safety_truth_15pct") -> DataFrame:
    """The whole log, numbered u00001 on: feedback first, then what it leaves of the safety net; rows by action, qid, number."""
    named = cut(named_edges(t_nodes, t_edges), "named")  # read by both parts
    own = cut(feedback(revisions, nodes, edges, t_nodes, t_edges, named=named), "feedback")
    plan_n = own.where("action = 'add_node'").select(T.matched("entity1_name").alias("k"))
    plan_e = own.where("action = 'add_edge'").select(T.matched("entity1_name").alias("a"), T.matched("entity2_name").alias("b"), F.col("relation_type_new").alias("rel"))
    blank = F.lit("")
    sn = safety_nodes(nodes, t_nodes, plan_n).select(F.lit(safety_id).alias("qid"), F.lit("add_node").alias("action"), "entity1_name", blank.alias("entity2_name"), blank.alias("relation_type_new"), F.lit("safety-net").alias("reason"), blank.alias("revision_reason"), "place")
    se = safety_edges(nodes, edges, t_nodes, t_edges, plan_e, named=named).select(F.lit(safety_id).alias("qid"), F.lit("add_edge").alias("action"), "entity1_name", "entity2_name", "relation_type_new", F.lit("safety-net").alias("reason"), blank.alias("revision_reason"), "place")
    log = own.withColumn("place", F.lit(0)).withColumn("_part", F.lit(0)).unionByName(sn.withColumn("_part", F.lit(1))).unionByName(se.withColumn("_part", F.lit(1)))
    log = log.withColumn("_k", _rank())
    log = ordinals(log, ["_part", "qid", "_k", "place", "entity1_name", "entity2_name"], "_n")
    return log.select(T.numbered("u", F.col("_n")).alias("update_id"), "qid", "action", "entity1_name", "entity2_name", blank.alias("entity1_id"), blank.alias("entity2_id"), blank.alias("relation_type_old"), "relation_type_new", "reason", "revision_reason")


def action_counts(log: DataFrame) -> DataFrame:
    """(action, n): the rows of a log by action; rows without one count under null."""
    return log.groupBy("action").agg(F.count("*").alias("n"))


def sequenced(log: DataFrame) -> DataFrame:
    """The log with its order of application: qid, action, update_id."""
    kept = log.select(*[T.strip(c).alias(c) if c != "reason" else F.col(c) for c in log.columns]).withColumn("_k", _rank())
    return ordinals(kept, ["qid", "_k", "update_id"], "seq").drop("_k")


def apply(nodes: DataFrame, edges: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) after the log, as set algebra over ``seq``.

    A node is added once, at its first row, if no node has its folded name. An edge is added between all nodes of its
    names (or given ids) that exist by then, if no edge has the pair, in either direction, and relation, or had it at the start. A removal takes
    the edges of a pair, in either direction, of the given relation or of all, that were there before it."""
    seq = sequenced(log)
    key = lambda c: T.folded(c)
    had = nodes.select("node_id", key("name").alias("k"), F.lit(0).cast("long").alias("since"))
    fresh = first_by(seq.where("action = 'add_node'").select(key("entity1_name").alias("k"), F.col("entity1_name").alias("name"), "seq").where("k <> ''").join(had.select("k").distinct(), "k", "left_anti"), ["k"], ["seq"])
    p, e = prefix_of(nodes, "node_id", "n"), prefix_of(edges, "edge_id", "e")
    top = largest_suffix(nodes, "node_id", p)
    fresh = ordinals(fresh, ["seq"], "_n").withColumn("node_id", F.concat(p, F.format_string("%05d", F.col("_n") + top)))
    all_nodes = had.unionByName(fresh.select("node_id", "k", F.col("seq").alias("since")))

    adds = seq.where("action = 'add_edge'").withColumn("rel", F.coalesce(F.nullif("relation_type_new", F.lit("")), F.lit("related_to")))

    def ends(i: int, out: str) -> DataFrame:
        given = adds.where(f"entity{i}_id <> ''").select("seq", F.posexplode(F.filter(F.transform(F.split(f"entity{i}_id", ","), T.strip), lambda x: x != "")).alias(f"{out}_o", out))
        named = adds.where(f"entity{i}_id = ''").select("seq", key(f"entity{i}_name").alias("k")).join(all_nodes, "k").where("since < seq").select("seq", F.lit(0).alias(f"{out}_o"), F.col("node_id").alias(out))
        return given.unionByName(named)

    pairs = adds.select("seq", "rel").join(ends(1, "s"), "seq").join(ends(2, "d"), "seq").withColumns({"p": F.least("s", "d"), "q": F.greatest("s", "d")})
    old = edges.select(F.least("src_id", "dst_id").alias("p"), F.greatest("src_id", "dst_id").alias("q"), F.col("relation_type").alias("rel")).distinct()
    new = first_by(pairs.join(old, ["p", "q", "rel"], "left_anti"), ["p", "q", "rel"], ["seq", "s_o", "s", "d_o", "d"])
    last = largest_suffix(edges, "edge_id", e)
    new = ordinals(new, ["seq", "s_o", "s", "d_o", "d"], "_n").select(F.concat(e, F.format_string("%05d", F.col("_n") + last)).alias("edge_id"), F.col("s").alias("src_id"), F.col("d").alias("dst_id"), F.col("rel").alias("relation_type"), F.lit("0.5").alias("confidence"), F.lit("-1").alias("page_no"), F.lit("").alias("sentence_id"), "seq", (F.col("_n") + edges.agg(F.coalesce(F.max("ord"), F.lit(0)).alias("m")).scalar()).alias("ord"))
    cols = ["edge_id", "src_id", "dst_id", "relation_type", "confidence", "page_no", "sentence_id", "ord"]
    full = lambda d, names: d.select(*[F.col(c).cast("string").alias(c) if c in d.columns else F.lit("").alias(c) for c in names[:-1]], F.col("ord").cast("long").alias("ord"))
    every = full(edges, cols).withColumn("seq", F.lit(0).cast("long")).unionByName(full(new, cols).join(new.select("edge_id", "seq"), "edge_id"))
    cuts = seq.where("action = 'remove_edge' and entity1_id <> '' and entity2_id <> ''").select(F.least("entity1_id", "entity2_id").alias("p"), F.greatest("entity1_id", "entity2_id").alias("q"), F.col("relation_type_old").alias("r"), F.col("seq").alias("at"))
    gone = every.join(cuts, (F.least("src_id", "dst_id") == F.col("p")) & (F.greatest("src_id", "dst_id") == F.col("q"))).where("seq < at and (r = '' or r = relation_type)").select("edge_id", "src_id", "dst_id", "ord").distinct()
    out_e = every.join(gone, ["edge_id", "src_id", "dst_id", "ord"], "left_anti").select(*cols)
    ncols = ["node_id", "label", "name", "page_no", "sentence_id", "ord"]
    start = nodes.agg(F.coalesce(F.max("ord"), F.lit(0)).alias("m")).scalar()
    more = fresh.select("node_id", F.lit("Concept").alias("label"), "name", F.lit("-1").alias("page_no"), F.lit("").alias("sentence_id"), (F.col("_n") + start).alias("ord"))
    return full(nodes, ncols).unionByName(full(more, ncols)), out_e


def legacy(revisions: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The earlier suggestions, over exact names: removed x kept entities with an edge give remove_edge for each edge; added x kept entities without one give add_edge related_to."""
    n = nodes.select("node_id", T.strip("name").alias("name")).where("name <> ''")
    vocabulary = n.select(F.col("name").alias("i")).distinct()
    asked, classes = _classes(revisions)

    def find(texts: DataFrame) -> DataFrame:
        return texts.join(_held(texts.select("text"), vocabulary).withColumnRenamed("o", "text"), "text").select("id", F.col("i").alias("k"))

    found = _named(classes, find).withColumnRenamed("k", "name")
    both, removed, added = found.where("had and has").select("cls", "name"), found.where("had and not has").select("cls", "name"), found.where("has and not had").select("cls", "name")
    nm = lambda c, o: n.select(F.col("node_id").alias(c), F.col("name").alias(o))
    changed = n.join(found.where("had <> has").select("name").distinct(), "name", "left_semi")  # only their edges count
    e = touching(edges, ["src_id", "dst_id"], changed.select("node_id")).join(nm("src_id", "x"), "src_id").join(nm("dst_id", "y"), "dst_id").select("edge_id", "src_id", "dst_id", "relation_type", "x", "y")
    e = cut(e, "named")
    either = e.unionByName(e.select("edge_id", "src_id", "dst_id", "relation_type", F.col("y").alias("x"), F.col("x").alias("y"))).distinct()
    kept = both.withColumnRenamed("name", "y")
    gone = removed.withColumnRenamed("name", "x").join(either, "x").join(kept, ["cls", "y"]).select("cls", F.lit("remove_edge").alias("action"), F.col("x").alias("entity1_name"), F.col("y").alias("entity2_name"), F.col("src_id").alias("entity1_id"), F.col("dst_id").alias("entity2_id"), F.col("relation_type").alias("relation_type_old"), F.lit("").alias("relation_type_new"))
    # a question names few entities: its added x kept pairs are a join on the question
    pairs = added.withColumnRenamed("name", "x").join(kept, "cls").join(either.select("x", "y").distinct(), ["x", "y"], "left_anti")
    ids = n.groupBy("name").agg(F.array_join(F.sort_array(F.collect_set("node_id")), ",").alias("ids"))
    add = pairs.join(ids.select(F.col("name").alias("x"), F.col("ids").alias("entity1_id")), "x").join(ids.select(F.col("name").alias("y"), F.col("ids").alias("entity2_id")), "y")
    every = gone.unionByName(add.select("cls", F.lit("add_edge").alias("action"), F.col("x").alias("entity1_name"), F.col("y").alias("entity2_name"), "entity1_id", "entity2_id", F.lit("").alias("relation_type_old"), F.lit("related_to").alias("relation_type_new"))).distinct()
    return asked.join(every, "cls").select("qid", *[c for c in every.columns if c != "cls"])
