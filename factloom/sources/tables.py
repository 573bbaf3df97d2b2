"""Text tables: readers that never fail on a value, and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.config import EDGE_COLUMNS, NODE_COLUMNS
from factloom.functions import text as T
from factloom.sources.quoted import read_quoted

#: Words that count as missing for readers that treat them so; fixed values.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def read_tsv(spark: SparkSession, path: str, quoted: bool = True, missing: bool = False) -> DataFrame:
    """A table with a header, all columns strings, null as "", with ``ord`` in file order; with ``missing``, words for missing values as ""."""
    if quoted:
        df = read_quoted(spark, path)
    else:
        df = spark.read.option("sep", "\t").option("header", True).option("inferSchema", False).option("mode", "PERMISSIVE").option("quote", "").csv(path)
        df = df.toDF(*[c.lstrip("﻿") for c in df.columns]).na.fill("").withColumn("ord", F.monotonically_increasing_id())
    if missing:
        df = df.select(*[F.when(F.col(f"`{c}`").isin(*MISSING), "").otherwise(F.col(f"`{c}`")).alias(c) for c in df.columns if c != "ord"], "ord")
    return df


def inferred(df: DataFrame, missing: tuple[str, ...] = MISSING) -> DataFrame:
    """String columns with the least type that holds all their values, words for missing values being null; ``ord`` and other columns stay.

    One pass counts, for every column, the values that are there and those that each type can hold. The types are ordered: whole numbers are below decimal ones, these and
    truth values below strings. A gap makes whole numbers decimal and truth values strings; a column of gaps alone is decimal, one of no rows a string."""
    own = [f.name for f in df.schema.fields if f.dataType.typeName() == "string"]
    if not own:
        return df
    value = {c: F.when(~F.col(f"`{c}`").isin(*missing), F.trim(F.col(f"`{c}`"))) for c in own}
    number = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$|^(?i)[+-]?inf(inity)?$"
    tests = {
        "there": lambda v: v.isNotNull(),
        "bigint": lambda v: v.rlike("^[+-]?[0-9]+$") & v.try_cast("bigint").isNotNull(),
        "double": lambda v: v.rlike(number),
        "boolean": lambda v: v.isin("True", "TRUE", "true", "False", "FALSE", "false"),
    }
    counts = [F.struct(*[F.count_if(test(value[c])).alias(t) for t, test in tests.items()]).alias(f"c{i}") for i, c in enumerate(own)]
    told = df.agg(F.count("*").alias("rows"), *counts).first()
    kinds = {}
    for i, c in enumerate(own):
        n, gaps = told[f"c{i}"], told["rows"] > told[f"c{i}"]["there"]
        holds = [t for t in ("bigint", "boolean", "double") if n[t] == n["there"] and not (gaps and t != "double")]
        kinds[c] = holds[0] if holds and told["rows"] else "string"
    return df.select(*[(value[c].cast(kinds[c]) if kinds[c] != "string" else F.when(value[c].isNotNull(), F.col(f"`{c}`"))).alias(c) if c in kinds else F.col(f"`{c}`") for c in df.columns])


def read_inferred(spark: SparkSession, path: str) -> DataFrame:
    """A table with a header and quoted fields whose columns have the types of their values."""
    return inferred(read_quoted(spark, path))


def read_positional(spark: SparkSession, path: str, names: list[str], ints: tuple[str, ...] = ("page_no",)) -> DataFrame:
    """Lines of tab-separated fields by place, quotes being plain characters: the header goes, and lines with fewer fields than ``names``; more fields are
    ignored. Named ``ints`` are whole numbers, null where they can't be read; ``ord`` is file order."""
    lines = spark.read.text(path).withColumn("ord", F.monotonically_increasing_id()).withColumn("_at", F.col("_metadata.file_block_start"))
    lines = lines.withColumn("_f", F.split(F.regexp_replace("value", "^\ufeff|[\r\n]+$", ""), "\t", -1))
    first = lines.where("_at = 0").groupBy(F.input_file_name().alias("_file")).agg(F.min("ord").alias("ord"))
    rows = lines.join(F.broadcast(first.select("ord")), "ord", "left_anti").where(F.size("_f") >= len(names))  # a line a file
    fields = [F.get("_f", F.lit(i)).alias(n) for i, n in enumerate(names)]
    return rows.select(*[f.try_cast("int").alias(n) if n in ints else f for f, n in zip(fields, names)], "ord")


def typed(df: DataFrame, ints: dict[str, int] = {}, doubles: dict[str, float] = {}) -> DataFrame:  # noqa: B006
    """Columns as numbers, with defaults where they can't be read."""
    made = {c: F.coalesce(F.col(c).cast("string").try_cast("int"), F.lit(d)) for c, d in ints.items()}
    return df.withColumns(made | {c: F.coalesce(F.col(c).cast("string").try_cast("double"), F.lit(d)) for c, d in doubles.items()})


def _pick(df: DataFrame, names: tuple[str, ...], place: int | None) -> str | None:
    lower = {c.lower(): c for c in df.columns}
    found = next((lower[n] for n in names if n in lower), None)
    return found if found or place is None or place >= len(df.columns) else df.columns[place]


def as_nodes(df: DataFrame) -> DataFrame:
    """node_id, name, aliases, label, ord and the rest, from any of the known column names or, failing these, by place."""
    i, n, a = _pick(df, NODE_COLUMNS["id"], 0), _pick(df, NODE_COLUMNS["name"], 1), _pick(df, NODE_COLUMNS["alias"], None)
    label = _pick(df, ("label", "ent_type"), None)
    made = [F.col(i).alias("node_id"), F.col(n).alias("name"), (F.col(a) if a else F.lit("")).alias("aliases"), (F.col(label) if label else F.lit("")).alias("label")]
    return df.select(*made, *[c for c in df.columns if c not in ("node_id", "name", "aliases", "label")])


def as_edges(df: DataFrame) -> DataFrame:
    """src_id, dst_id, relation_type, ord and the rest, from any of the known column names or, failing these, by place."""
    s, d, r = (_pick(df, EDGE_COLUMNS[k], p) for k, p in (("src", 0), ("dst", 1), ("rel", 2)))
    return df.select(F.col(s).alias("src_id"), F.col(d).alias("dst_id"), F.col(r).alias("relation_type"), *[c for c in df.columns if c not in ("src_id", "dst_id", "relation_type")])


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df``, or an error that names the columns it lacks."""
    lack = [c for c in columns if c not in df.columns]
    if lack:
        raise ValueError(f"missing columns: {', '.join(lack)}")
    return df


def generated_ids(nodes: DataFrame, width: int = 6) -> DataFrame:
    """Nodes with n000000 on, in file order, where the identifier is blank."""
    blank = F.col("node_id").isNull() | (F.col("node_id") == "")
    from factloom.operators.ids import ordinals

    return ordinals(nodes, ["ord"], "_n").withColumn("node_id", F.when(blank, F.format_string(f"n%0{width}d", F.col("_n") - 1)).otherwise(F.col("node_id"))).drop("_n")


def parse_pages(files: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """(key, page_ord, page_no, text) from whole files of pages behind marker lines ``=== Page N ===``.

    Lines are stripped and joined by spaces; lines before the first marker belong to the first page; a file without markers has no pages; a
    repeated number is a page of its own."""
    lines = files.select(F.col(key).alias("key"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\r\n|\r|\n")).alias("pos", "line"))
    mark = F.regexp_extract(T.strip("line"), r"^=== Page\s+(\d+) ===", 1)
    lines = lines.withColumn("no", F.nullif(mark, F.lit("")).try_cast("int"))
    w = Window.partitionBy("key").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("page_ord", F.greatest(F.lit(1).cast("long"), F.count("no").over(w)))
    body = F.when(F.col("no").isNull() & (T.strip("line") != ""), F.struct("pos", T.strip("line").alias("l")))
    pages = lines.groupBy("key", "page_ord").agg(F.max("no").alias("page_no"), F.array_sort(F.collect_list(body)).alias("b"))
    return pages.where("page_no is not null").select(F.col("key").alias(key), "page_ord", "page_no", T.spaced(F.array_join(F.transform("b", lambda x: x["l"]), " ")).alias("text"))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages of every file under ``path``, in one job; lecture is the file's name."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]*)?$", 1).alias("lecture"), F.col("value").alias("text"))
    return parse_pages(files, "lecture")


def page_lines(pages: DataFrame) -> DataFrame:
    """One text column in the page format, for a text writer."""
    return pages.select(F.concat(F.lit("=== Page "), F.col("page_no").cast("string"), F.lit(" ===\n"), F.coalesce("text", F.lit("")), F.lit("\n")).alias("value"))


def write_tsv(df: DataFrame, path: str, columns: list[str], one: bool = True, mode: str = "overwrite") -> None:
    """The named columns with a header; ``one`` file for small tables; mode append adds files."""
    out = df.select(columns)
    (out.coalesce(1) if one else out).write.mode(mode).option("sep", "\t").option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str, one: bool = True) -> None:
    (df.coalesce(1) if one else df).write.mode("overwrite").json(path)


def export_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """A table as CSV whose files begin with a byte order mark, for spreadsheets: the mark is part of the first column's name."""
    first, *rest = columns
    df.select(F.col(first).alias("\ufeff" + first), *rest).coalesce(1).write.mode("overwrite").option("header", True).option("quoteAll", False).csv(path)


def write_object(row: DataFrame, path: str) -> None:
    """The first row as one JSON object, nulls kept."""
    row.limit(1).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_prompts(spark: SparkSession, path: str) -> dict[str, str]:
    """Prompt texts by file name without its ending: configuration, so on the driver."""
    rows = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]*)?$", 1).alias("n"), "value")
    return {r["n"]: r["value"] for r in rows.collect()}


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """(metric_name, value) of a file with metric records or with one object of numbers."""
    df = spark.read.option("multiLine", True).json(path)
    if "metric_name" in df.columns:
        return df.select("metric_name", F.col("value").cast("double").alias("value"))
    nums = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "long", "integer", "float")]
    return df.select(*[F.col(c).cast("double").alias(c) for c in nums]).unpivot([], nums, "metric_name", "value")


def upsert_sink(df: DataFrame, write, size: int = 500) -> None:
    """Hand rows to ``write`` (a list of dicts, in a worker) in batches of ``size``; retried tasks repeat batches, so writes must be upserts."""

    def send(rows) -> None:
        batch = []
        for r in rows:
            batch.append(r.asDict(True))
            if len(batch) >= size:
                write(batch)
                batch = []
        if batch:
            write(batch)

    df.foreachPartition(send)
