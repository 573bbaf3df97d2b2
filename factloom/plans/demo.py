"""Knowledge graphs and text over the driver's tables, as common table expressions that Spark and DuckDB both read.

Reference graph: regions, nations, customers, suppliers and parts with their relations. Baseline graph: the same with nodes and edges
missing, names cut short and relations changed, by residues of keys. Text: documents, their words as mentions.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split()

_ID = "'{0}' || CAST({1} AS STRING)"


def _id(letter: str, key: str) -> str:
    return _ID.format(letter, key)


VIEWS = {
    # nodes and edges of the reference graph
    "tn": f"""SELECT {_id('r', 'r_regionkey')} AS node_id, r_name AS name, 'region' AS label, CAST(r_regionkey AS BIGINT) AS ord FROM region
      UNION ALL SELECT {_id('n', 'n_nationkey')}, n_name, 'nation', 1000 + CAST(n_nationkey AS BIGINT) FROM nation
      UNION ALL SELECT {_id('c', 'c_custkey')}, c_name, 'customer', 1000000 + CAST(c_custkey AS BIGINT) FROM customer
      UNION ALL SELECT {_id('s', 's_suppkey')}, s_name, 'supplier', 1000000000 + CAST(s_suppkey AS BIGINT) FROM supplier
      UNION ALL SELECT {_id('p', 'p_partkey')}, p_name, 'part', 2000000000 + CAST(p_partkey AS BIGINT) FROM part""",
    "te0": f"""SELECT {_id('n', 'n_nationkey')} AS src_id, {_id('r', 'n_regionkey')} AS dst_id, 'part_of' AS relation_type, CAST(0.9 AS DOUBLE) AS confidence, CAST(n_nationkey AS BIGINT) AS s, CAST(n_regionkey AS BIGINT) AS d, CAST(0 AS BIGINT) AS g FROM nation
      UNION ALL SELECT {_id('c', 'c_custkey')}, {_id('n', 'c_nationkey')}, 'located_in', CAST(0.8 AS DOUBLE), CAST(c_custkey AS BIGINT), CAST(c_nationkey AS BIGINT), 1 FROM customer
      UNION ALL SELECT {_id('s', 's_suppkey')}, {_id('n', 's_nationkey')}, 'located_in', CAST(0.8 AS DOUBLE), CAST(s_suppkey AS BIGINT), CAST(s_nationkey AS BIGINT), 2 FROM supplier
      UNION ALL SELECT {_id('s', 'l_suppkey')}, {_id('p', 'l_partkey')}, 'supplies', floor(CAST(1000000 * count(*) - 10000 * sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) / (100 * count(*))) / 10000, l_suppkey, l_partkey, 3 FROM lineitem GROUP BY l_suppkey, l_partkey
      UNION ALL SELECT DISTINCT {_id('c', 'o_custkey')}, {_id('p', 'l_partkey')}, 'related_to', CAST(0.5 AS DOUBLE), o_custkey, l_partkey, 4 FROM orders JOIN lineitem ON o_orderkey = l_orderkey""",
    "te": "SELECT relation_type || ':' || src_id || '>' || dst_id AS edge_id, src_id, dst_id, relation_type, confidence, s, d, g * 100000000000000 + s * 10000000 + d AS ord FROM te0",
    # the baseline graph
    "bn": "SELECT node_id, CASE WHEN ord % 13 = 5 AND length(name) > 4 THEN substr(name, 1, length(name) - 1) ELSE name END AS name, CASE WHEN ord % 17 = 4 THEN 'thing' ELSE label END AS label, ord FROM tn WHERE ord % 5 <> 3",
    "be": "SELECT edge_id, src_id, dst_id, CASE WHEN (7 * s + d) % 11 = 0 THEN 'causes' ELSE relation_type END AS relation_type, confidence, s, d, ord FROM te WHERE (s + d) % 5 <> 2",
    # strings for the mention functions
    "ms": """SELECT c_custkey AS id, CASE c_custkey % 7 WHEN 0 THEN '《' || c_name || '》' WHEN 1 THEN '的' || c_mktsegment || ' ' WHEN 2 THEN '刑法修正案（' || CAST(c_custkey % 9 AS STRING)
      WHEN 3 THEN '一二' || CAST(c_custkey AS STRING) WHEN 4 THEN c_mktsegment || '问题' WHEN 5 THEN '行为' ELSE c_mktsegment || '、' || c_name || '，规定；' || c_mktsegment || '/x' END AS mention,
      CASE WHEN c_custkey % 2 = 0 THEN 'Book' ELSE 'Law' END AS ent_type FROM customer""",
    # turns as questions with answers, facts and marks
    "qs": """SELECT q.conv_id * 1000 + q.turn AS id, 'q' || CAST(q.conv_id * 1000 + q.turn AS STRING) AS qid, q.text AS question, q.role, q.turn, length(q.text) AS n,
      CASE q.turn % 4 WHEN 0 THEN 'b' WHEN 1 THEN 'The answer is C.' WHEN 2 THEN 'A' ELSE 'none' END AS answer FROM conversations q""",
}


def closure(sql: str) -> list[str]:
    """Names of the views that ``sql`` needs, in order."""
    need: set[str] = set()
    todo = [sql]
    while todo:
        text = todo.pop()
        for name in VIEWS:
            if name not in need and re.search(rf"\b(?:FROM|JOIN|,)\s+{name}\b", text):
                need.add(name)
                todo.append(VIEWS[name])
    return [n for n in VIEWS if n in need]


def with_views(sql: str) -> str:
    """``sql`` with the views that it needs before it."""
    names = closure(sql)
    body = sql.strip()
    if not names:
        return body
    views = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names)
    return f"WITH {views},\n{body[5:]}" if body.upper().startswith("WITH ") else f"WITH {views}\n{body}"


def frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The rows of ``sql`` over the tables of ``sf_dir``."""
    full = with_views(sql).replace("{", "{{").replace("}", "}}")
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if re.search(rf"\b{t}\b", full)}
    return spark.sql(re.sub(r"\b(FROM|JOIN) (" + "|".join(TABLES) + r")\b", r"\1 {\2}", full), **tables)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return frame(spark, sf_dir, f"SELECT * FROM {name}")


def graphs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(baseline nodes, baseline edges, reference nodes, reference edges)."""
    return tuple(table(spark, sf_dir, n) for n in ("bn", "be", "tn", "te"))
