"""Building, merging, comparing and walking graphs of nodes (node_id, name, label, ..., ord) and edges
(edge_id, src_id, dst_id, relation_type, confidence, ..., ord); ``ord`` is file order wherever order matters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.config import CONFIG
from factloom.functions import text as T
from factloom.operators.components import counted
from factloom.operators.ids import first_by, last_by, ordinals, top_by
from factloom.shared import cut, drop


def mention_ids(mentions: DataFrame, keys: list[str], order: list, prefix: str = "e") -> DataFrame:
    """The first mention of each of ``keys`` with an identifier that counted all mentions, so that dropped ones leave gaps."""
    return first_by(ordinals(mentions, order, "_n").withColumn("entity_id", T.numbered(prefix, F.col("_n"))), keys, ["_n"]).drop("_n")


def nodes_of(mentions: DataFrame, order: list, name: str = "mention", label: str = "ent_type", prefix: str = "n") -> DataFrame:
    """Nodes from mentions: the first of each (name, label), numbered in order; columns of the mention come along."""
    firsts = first_by(mentions, [name, label], order)
    return ordinals(firsts, order, "ord").withColumn("node_id", T.numbered(prefix, F.col("ord")))


def adjacent_pairs(mentions: DataFrame, sentence: str = "sentence_id", most: int = CONFIG.pairs_kept) -> DataFrame:
    """Neighbouring mentions of a sentence by start as (sentence, pair, head, head_type, tail, tail_type, head_conf, tail_conf); pairs of one
    node with itself don't count, and at most ``most`` pairs of a sentence are kept."""
    w = Window.partitionBy(sentence).orderBy("start_char", "ord")
    nxt = lambda c: F.lead(c).over(w)
    pairs = mentions.select(sentence, F.row_number().over(w).alias("pair"), F.col("mention").alias("head"), F.col("ent_type").alias("head_type"), nxt("mention").alias("tail"), nxt("ent_type").alias("tail_type"), F.col("confidence").alias("head_conf"), nxt("confidence").alias("tail_conf"))
    pairs = pairs.where(F.col("tail").isNotNull() & ((F.col("head") != F.col("tail")) | (F.col("head_type") != F.col("tail_type"))))
    return top_by(pairs, [sentence], ["pair"], most)


def classified(pairs: DataFrame) -> DataFrame:
    """The deterministic relation classifier: by the pair's types; confidence the default."""
    rel = F.when(F.col("head_type") == F.col("tail_type"), "related_to").when(F.col("head_type") == "Law", "defines").when(F.col("tail_type") == "Law", "part_of").otherwise("includes")
    return pairs.withColumn("relation_type", rel).withColumn("rel_conf", F.lit(CONFIG.relation_confidence))


def edges_of(pairs: DataFrame, nodes: DataFrame, order: list, prefix: str = "e") -> DataFrame:
    """Edges between the nodes of classified pairs: ids joined by (name, type), loops dropped, confidence the least of the three."""
    ids = nodes.select(F.col("mention").alias("_m"), F.col("ent_type").alias("_t"), F.col("node_id").alias("_id"))
    out = pairs.join(ids, (F.col("head") == F.col("_m")) & (F.col("head_type") == F.col("_t"))).withColumnRenamed("_id", "src_id").drop("_m", "_t")
    out = out.join(ids, (F.col("tail") == F.col("_m")) & (F.col("tail_type") == F.col("_t"))).withColumnRenamed("_id", "dst_id").drop("_m", "_t")
    out = out.where("src_id <> dst_id").withColumn("relation_type", T.relation("relation_type")).withColumn("confidence", F.least("head_conf", "tail_conf", T.confidence("rel_conf")))
    return ordinals(out, order, "ord").withColumn("edge_id", T.numbered(prefix, F.col("ord")))


def merge_nodes(nodes: DataFrame, order: list = ["kg", "ord"]) -> DataFrame:  # noqa: B006
    """Nodes of many graphs (column kg) as one: the first of each (name, label) gives the example, ids g00001 on."""
    firsts = first_by(nodes, ["name", "label"], order)
    return ordinals(firsts, order, "n").select(T.numbered("g", F.col("n")).alias("global_node_id"), "name", "label", F.col("node_id").alias("example_node"), F.col("kg").alias("example_kg"))


def merge_edges(edges: DataFrame, nodes: DataFrame, merged: DataFrame, order: list = ["kg", "ord"]) -> DataFrame:  # noqa: B006
    """Edges of many graphs between merged nodes: unknown ends and loops go; of each (src, dst, relation) the surest row stays,
    the first of equals; ids ge00001 on in order of the key's first appearance."""
    local = nodes.select("kg", "node_id", "name", "label").join(merged.select("name", "label", "global_node_id"), ["name", "label"])
    local = local.groupBy("kg", "node_id").agg(F.max("global_node_id").alias("g"))
    end = lambda c, g: cut(local.select("kg", F.col("node_id").alias(c), F.col("g").alias(g)), "ids")
    # a table a step, of the columns that count: the shuffle files of a step go before the next one makes its own
    out = edges.select(*dict.fromkeys(["kg", "src_id", "dst_id", "relation_type", "confidence", "edge_id", *order]))
    from_ = cut(out.join(end("src_id", "_gs"), ["kg", "src_id"]).drop("src_id"), "merged")
    out = cut(from_.join(end("dst_id", "_gd"), ["kg", "dst_id"]).where("_gs <> _gd").drop("dst_id"), "merged")
    drop(from_)
    w = Window.partitionBy("_gs", "_gd", "relation_type")
    best = first_by(out.withColumn("_first", F.min(F.struct(*order)).over(w)), ["_gs", "_gd", "relation_type"], [F.desc("confidence"), *order])
    best = cut(best.select("_gs", "_gd", "relation_type", "confidence", "edge_id", "kg", "_first"), "merged")
    drop(out)
    return ordinals(best, ["_first"], "n").select(T.numbered("ge", F.col("n")).alias("global_edge_id"), F.col("_gs").alias("src_id"), F.col("_gd").alias("dst_id"), "relation_type", "confidence", F.col("edge_id").alias("example_edge"), F.col("kg").alias("example_kg"))


def upsert_nodes(nodes: DataFrame) -> DataFrame:
    """One node an id, the last one; a page that can't be read is -1."""
    return last_by(nodes, ["node_id"]).withColumn("page_no", F.coalesce(F.col("page_no").cast("string").try_cast("int"), F.lit(-1)))


def upsert_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One edge an ordered pair of known nodes, the last one."""
    known = nodes.select("node_id").distinct()
    out = edges.join(known.withColumnRenamed("node_id", "src_id"), "src_id", "left_semi").join(known.withColumnRenamed("node_id", "dst_id"), "dst_id", "left_semi")
    return last_by(out, ["src_id", "dst_id"])


def simple(edges: DataFrame) -> DataFrame:
    """One edge an ordered pair, the last relation, as a plain directed graph keeps it."""
    return last_by(edges, ["src_id", "dst_id"])


def repeated_ids(nodes: DataFrame) -> DataFrame:
    """Identifiers that break uniqueness, with their counts."""
    return nodes.groupBy("node_id").count().where("count > 1")


def drawn(nodes: DataFrame, edges: DataFrame, least: float = 0.0, most: int = CONFIG.drawn_edges) -> DataFrame:
    """Edges of a picture: the ``most`` surest at or above ``least`` (then ord), of which each (src, dst, relation) keeps its largest confidence, without loops."""
    top = edges.where(F.col("confidence") >= least).orderBy(F.desc("confidence"), "ord").limit(most)
    return top.where("src_id <> dst_id").groupBy("src_id", "dst_id", "relation_type").agg(F.max("confidence").alias("confidence"))


def neighbours(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct undirected (u, v) between known nodes, both ways, without loops."""
    known = nodes.select("node_id").distinct()
    e = edges.where("src_id <> dst_id").select(F.col("src_id").alias("u"), F.col("dst_id").alias("v"))
    e = e.join(known.withColumnRenamed("node_id", "u"), "u", "left_semi").join(known.withColumnRenamed("node_id", "v"), "v", "left_semi")
    return e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()


def degrees(nodes: DataFrame, edges: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """(node_id, degree) of every node: distinct neighbours. ``near``: the neighbours, if they are there."""
    d = (neighbours(nodes, edges) if near is None else near).groupBy(F.col("u").alias("node_id")).agg(F.count("*").alias("degree"))
    return nodes.select("node_id").distinct().join(d, "node_id", "left").select("node_id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def union(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both, those of ``b`` where both have a key."""
    return last_by(a.withColumn("_w", F.lit(0)).unionByName(b.withColumn("_w", F.lit(1))).withColumn("_w", F.struct("_w", "ord")), keys, "_w").drop("_w")


def diff(a: DataFrame, b: DataFrame, keys: list[str], names: tuple[str, str, str] = ("removed", "added", "kept")) -> DataFrame:
    """(keys, status) of the distinct keys of both: only in ``a``, only in ``b``, in both."""
    x = a.select(keys).distinct().withColumn("_a", F.lit(1))
    y = b.select(keys).distinct().withColumn("_b", F.lit(1))
    status = F.when(F.col("_b").isNull(), names[0]).when(F.col("_a").isNull(), names[1]).otherwise(names[2])
    return x.join(y, keys, "full_outer").select(*keys, status.alias("status"))


def changed_nodes(changes: DataFrame) -> DataFrame:
    """Ends of edges that were added or removed."""
    c = changes.where("status <> 'kept'")
    return c.select(F.col("src_id").alias("node_id")).unionByName(c.select(F.col("dst_id").alias("node_id"))).distinct()


def seeds(changes: DataFrame, nodes: DataFrame, fallback: int = 5) -> DataFrame:
    """Ends of changed edges; where nothing changed, the first ``fallback`` nodes."""
    found = changed_nodes(changes)
    none = found.agg(F.count("*").alias("n")).scalar() == 0
    return found.unionByName(nodes.orderBy("ord").limit(fallback).where(none).select("node_id"))


def within(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, k: int = 1, near: DataFrame | None = None) -> DataFrame:
    """(node_id, hops) of the nodes at most ``k`` undirected steps from a seed that is in the graph. ``near``: the neighbours, if they are there.

    A loop over the frontier: each step joins the nodes that the last one reached, stored, with their neighbours, and leaves out those seen before; it
    ends early where nothing new is reached. A step reads stored tables only, so the plan grows by one table a step."""
    n = cut(neighbours(nodes, edges), "near") if near is None else near
    start = seeds.select("node_id").distinct().join(nodes.select("node_id").distinct(), "node_id", "left_semi")
    frontier, size = counted(start.withColumn("hops", F.lit(0)), "hop")
    seen = frontier
    for i in range(1, k + 1):
        if not size:
            break
        reached = frontier.select(F.col("node_id").alias("u")).join(n, "u").select(F.col("v").alias("node_id")).distinct()
        frontier, size = counted(reached.join(seen.select("node_id"), "node_id", "left_anti").withColumn("hops", F.lit(i)), "hop")
        seen = seen.unionByName(frontier)
    return seen


def focus(nodes: DataFrame, edges: DataFrame, found: DataFrame, most: int, near: DataFrame | None = None) -> DataFrame:
    """The first ``most`` of found nodes: changed ones (hops 0) first, then by degree, then id."""
    return found.join(degrees(nodes, edges, near), "node_id").orderBy(F.expr("hops > 0"), F.desc("degree"), "node_id").limit(most)


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes``."""
    n = nodes.select("node_id").distinct()
    return edges.join(n.withColumnRenamed("node_id", "src_id"), "src_id", "left_semi").join(n.withColumnRenamed("node_id", "dst_id"), "dst_id", "left_semi")


def merge_names(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node map, edges): nodes of one folded name become the one of largest degree, the first of equals; edges follow, loops and repeats go."""
    ranked = nodes.select("node_id", "ord", T.folded("name").alias("k")).join(degrees(nodes, edges), "node_id")
    w = Window.partitionBy("k").orderBy(F.desc("degree"), "ord").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    mapped = ranked.select("node_id", F.first("node_id").over(w).alias("kept_id"))
    m = lambda c: mapped.select(F.col("node_id").alias(c), F.col("kept_id").alias(f"_{c}"))
    out = edges.join(m("src_id"), "src_id").join(m("dst_id"), "dst_id").select(F.col("_src_id").alias("src_id"), "relation_type", F.col("_dst_id").alias("dst_id"))
    return mapped, out.where("src_id <> dst_id").distinct()


def drawn_sizes(nodes: DataFrame, edges: DataFrame, base: int = 650, scale: int = 90, cap: int = 1300) -> DataFrame:
    """(node_id, degree, size) of the nodes that have a neighbour."""
    return degrees(nodes, edges).where("degree > 0").withColumn("size", F.least(F.lit(cap).cast("long"), base + scale * F.col("degree")))


def pair(a: str | Column = "src_id", b: str | Column = "dst_id") -> list[Column]:
    """The ends of an edge as an unordered pair."""
    return [F.least(a, b).alias("p"), F.greatest(a, b).alias("q")]
