"""Mixing sources to target weights by hash-threshold histograms, in DataFrame functions only.

Every document gets a hash from its key, as hexadecimal digits. For a source that is to give less than a whole number of its
sizes, the wanted rest is the sum over documents whose hash lies under a threshold. The threshold is found without
sorting: sizes are summed by source and the first digits of the hash, running sums over the (at most 4096) buckets of a
source find the bucket in which the budget ends, and only that bucket is looked at again, by its next digits, until it holds one hash.
The documents of that hash are taken if the sum is then nearer to the budget than without them. Smaller budgets have smaller thresholds, so their mixes are nested. Thresholds are one row a source and budget.

Sources are strings compared by code point, null last; a null or wordless text has size 0. Rows that share a key are taken
or left together. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.shared import cut, fresh

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE, CAP = 1.5, 2.0
#: Hexadecimal digits of the hash that each pass reads: 16 in all.
DIGITS, LEVELS = 3, 5


def hashed(key: Column, salt: str = "mix") -> Column:
    """The first digits of a salted MD5 of the key as text."""
    return F.substring(F.md5(F.concat(F.lit(salt), F.coalesce(key.cast("string"), F.lit("")))), 1, DIGITS * LEVELS)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size, target) from (source, source_size): weights repeat by code point of the source, and each target is
    min(cap * size, level * weight) with the one level at which they make up ``share`` of all sizes (or all are capped).

    The level is found by filling: sources in order of the level at which they reach their cap, with running sums."""
    every = Window.partitionBy()
    order = Window.orderBy(F.col("source").isNull(), "source")
    ranked = sizes.withColumn("i", F.row_number().over(order) - 1).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("i") % len(weights) + 1).cast("int")).cast("double"))
    ranked = ranked.withColumn("full", cap * F.col("source_size")).withColumn("at", F.col("full") / F.col("weight"))
    below = Window.orderBy("at", "i").rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumn("capped", F.coalesce(F.sum("full").over(below), F.lit(0.0))).withColumn("open", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(below), F.lit(0.0)))
    level = (share * F.sum("source_size").over(every) - F.col("capped")) / F.col("open")
    # the first source, in this order, whose own level leaves it open: all before it are capped, none after it
    first = F.min(F.when(F.col("level") <= F.col("at"), F.struct("at", "i", "level"))).over(every)
    ranked = ranked.withColumn("level", level).withColumn("level", first["level"])
    return ranked.select("source", "source_size", F.least("full", F.coalesce(F.col("level") * F.col("weight"), F.col("full"))).alias("target"))


def thresholds(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, budget, threshold): documents of the source with hash below the threshold come as near to the budget as a threshold can, from
    below where two are as near. sized: source, size, hash; budgets: source, budget. A null threshold takes all."""
    found = budgets.withColumn("threshold", F.lit("")).withColumn("left", F.col("budget").cast("double")).withColumn("open", F.lit(True))
    for level in range(LEVELS):
        n = DIGITS * level
        # the buckets of all sources at the first pass, afterwards only those in which a budget ends
        edge = found.where("open").select(F.col("source").alias("s"), F.col("threshold").alias("t"), "budget", "left")
        part = sized.join(edge, sized["source"].eqNullSafe(F.col("s")) & (F.substring("hash", 1, n) == F.col("t")))
        cells = part.groupBy("source", "budget", "t", "left", F.substring("hash", n + 1, DIGITS).alias("cell")).agg(F.sum("size").alias("size"), (F.min("hash") == F.max("hash")).alias("one"))
        run = Window.partitionBy("source", "budget").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
        cells = cells.withColumn("sum", F.sum("size").over(run))
        over = cells.where(F.col("sum") > F.col("left")).groupBy("source", "budget").agg(F.min_by(F.struct("cell", (F.col("sum") - F.col("size")).alias("under"), "size", "one"), "cell").alias("o"))
        step = over.select(F.col("source").alias("s"), F.col("budget").alias("b"), "o")
        new = found.join(step, found["source"].eqNullSafe(F.col("s")) & (F.col("budget") == F.col("b")), "left")
        # the sign behind all digits lets the boundary hash in
        nearer = F.col("o.one") & (F.col("o.size") < 2 * (F.col("left") - F.col("o.under")))
        beyond = F.concat("threshold", "o.cell", F.when(nearer, "~").otherwise(""))
        found = cut(new.select("source", "budget", F.when(F.col("open") & F.col("o").isNotNull(), beyond).otherwise(F.col("threshold")).alias("threshold"), F.when(F.col("o").isNotNull(), F.col("left") - F.col("o.under")).otherwise(F.col("left")).alias("left"), (F.col("open") & F.col("o").isNotNull() & ~F.coalesce("o.one", F.lit(True))).alias("open"), *(["all"] if level else [F.col("o").isNull().alias("all")])), "mix")
        if found.where("open").isEmpty():  # a boundary bucket of one hash can't be split: its digits so far are the threshold
            break
    return found.select("source", "budget", F.when(~F.col("all"), F.col("threshold")).alias("threshold"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, whole: bool = False) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of ``docs``; taken is a whole number of times the size. With
    ``whole``, all columns of ``docs`` and these four (a column of such a name is replaced).

    A source with target T and size S is taken floor(T / S) times whole, and once more where the hash is under the threshold of the rest."""
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    sized = cut(docs.select(F.col(key).alias("doc_id"), F.col(source).cast("string").alias("source"), size.alias("size"), hashed(F.col(key)).alias("hash")), "sized")
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    aim = cut(targets(sums, weights, share, cap), "aim")
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    aim = aim.withColumn("times", times).withColumn("budget", F.col("target") - F.col("times") * F.col("source_size"))
    under = thresholds(sized, aim.select("source", "budget"))
    plan = aim.alias("a").join(under.alias("u"), F.col("a.source").eqNullSafe(F.col("u.source"))).select(F.col("a.source").alias("s"), "source_size", "target", "times", "threshold")
    # a table with a known size: Spark broadcasts it below its threshold and otherwise splits the skewed join
    plan = cut(plan, "plan")
    s, z, a, n, t = (fresh(docs, c) for c in ("_s", "_z", "_a", "_n", "_t"))
    again = lambda h: F.when(F.col(t).isNull() | (h < F.col(t)), 1).otherwise(0)
    plan = plan.select(F.col("s").alias(s), F.col("source_size").alias(z), F.col("target").alias(a), F.col("times").alias(n), F.col("threshold").alias(t))
    if whole:
        made = {"size": size, "source_size": F.col(z), "target": F.col(a), "taken": (size * F.least(F.lit(int(cap)), F.col(n) + again(hashed(F.col(key))))).cast("long")}
        out = docs.join(plan, F.col(source).cast("string").eqNullSafe(F.col(s)))
        return out.select(*(c for c in docs.columns if c.lower() not in made), *(v.alias(k) for k, v in made.items()))
    out = sized.join(plan, sized["source"].eqNullSafe(F.col(s)))
    return out.select("doc_id", "size", F.col(z).alias("source_size"), F.col(a).alias("target"), (F.col("size") * F.least(F.lit(int(cap)), F.col(n) + again(F.col("hash")))).cast("long").alias("taken"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: the mix of all documents."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))


SQL = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
    left(md5('mix' || coalesce(doc_id::VARCHAR, '')), {DIGITS * LEVELS}) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][i % 3 + 1]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
r AS (SELECT *, cap / weight AS brim,
    coalesce(sum(cap) OVER (ORDER BY cap / weight, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
    sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS opened FROM w),
l AS (SELECT arg_min(level, (brim, i)) AS level FROM (SELECT i, brim, (1.5::DOUBLE * (SELECT sum(source_size) FROM s) - capped) / opened AS level FROM r) WHERE level <= brim),
t AS (SELECT source, source_size, least(cap, coalesce(level * weight, cap)) AS target FROM r, l),
b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS times FROM t),
x AS (SELECT source, h, sum(size) AS own, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS upto FROM d GROUP BY source, h),
y AS (SELECT x.*, upto - (b.target - b.times * b.source_size) AS over FROM x JOIN b ON x.source IS NOT DISTINCT FROM b.source)
SELECT d.doc_id, d.size, b.source_size, b.target,
  (d.size * least(2, b.times + CASE WHEN y.over <= 0 OR y.own >= y.over AND y.over < y.own - y.over THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source JOIN y ON d.h = y.h AND d.source IS NOT DISTINCT FROM y.source
"""
