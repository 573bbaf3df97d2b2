"""Tables in the folder that driver and executors share, used to cut lineage.

A long plan is cut by writing it as Parquet under ``spark.checkpoint.dir`` and reading it back: the files
survive lost executors, and later stages see a plain scan. Shuffle files of a plan that ends in such a table go with it, as nothing reads
them again. The folder is only chosen here when a session on one machine names none.
"""

from __future__ import annotations

import ctypes
import itertools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Whether Spark deletes the shuffle files of a command when it ends.
_CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The session's shared folder, or one of our own where a local session sets none; an error on a cluster without one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isEmpty():
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))  # one machine: a folder of this session's own
            held = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = held.get()
    return f"{base}/factloom/{spark.sparkContext.applicationId}"


#: Spark lets go of broadcasts, shuffles and compiled code of plans that are gone when the driver collects garbage, and the heap shrinks with them; a long job of
#: small plans seldom does.
_EVERY, _cuts = 3, itertools.count(1)


def cut(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of what was written. Every third table the driver collects garbage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    held = spark.conf.get(_CLEANED, "false")
    spark.conf.set(_CLEANED, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANED, held)
    if next(_cuts) % _EVERY == 0:
        spark._jvm.System.gc()
    table = spark.read.schema(df.schema).parquet(path)
    table._stored = path
    return table


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function for mapInArrow after whose end the worker, which waits for its next task, gives back the memory that it no longer uses."""

    def then(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's; other libraries need none
        if trim is not None:
            trim(0)

    return then


def drop(*tables: DataFrame) -> None:
    """Delete the files of tables of ``cut`` that nothing reads again."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table._stored)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bits of a key filter: 8 MB at most, whatever the number of keys.
_BITS = 1 << 26
_PAGE = 1 << 15


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a longer one where ``df`` has a column of that name."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def _tested(df: DataFrame, key: str, ids: DataFrame) -> tuple[DataFrame, Column]:
    """``df`` beside the pages of a bit for each hash of ``ids`` (one column), and whether a row's key may be among them.

    The pages, at most 2048 of 4 KB, are broadcast, so the rows of ``df`` stay where they are."""
    s, page, bits = (fresh(df, c) for c in ("_s", "_page", "_bits"))
    spot = lambda c: F.pmod(F.xxhash64(F.col(c).cast("string")), F.lit(_BITS))
    own = ids.select(F.col(ids.columns[0]).alias("i")).where("i is not null").select(spot("i").alias("t"))
    pages = own.groupBy(F.expr(f"t div {_PAGE}").alias(page)).agg(F.bitmap_construct_agg(F.col("t") % _PAGE).alias(bits))
    beside = df.withColumn(s, F.when(F.col(key).isNotNull(), spot(key)))
    beside = beside.join(F.broadcast(pages), F.expr(f"{s} div {_PAGE}") == F.col(page), "left")
    bit = F.expr(f"{bits} is not null and (shiftright(cast(conv(hex(substring({bits}, cast(({s} % {_PAGE}) div 8 as int) + 1, 1)), 16, 10) as int), cast({s} % 8 as int)) & 1) = 1")
    return beside, bit


def among(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows of ``df`` whose key may be among ``ids``; few others where ids are few against the filter's bits. Exact joins follow."""
    beside, bit = _tested(df, key, ids)
    return beside.where(bit).select(df.columns)


def touching(df: DataFrame, keys: list[str], ids: DataFrame) -> DataFrame:
    """The rows of ``df`` of which some key may be among ``ids``, in one pass; few others where ids are few. Exact joins follow."""
    beside, bits = df, []
    for key in keys:
        beside, bit = _tested(beside, key, ids)
        bits.append(bit)
    return beside.where(reduce(Column.__or__, bits)).select(df.columns)


def without(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows of ``df`` whose key is not among ``ids`` (exactly). Only rows that the filter can't clear are shuffled."""
    beside, bit = _tested(df, key, ids)
    name, mark = fresh(beside, "_i"), fresh(beside, "_in")
    ids = ids.select(F.col(ids.columns[0]).alias(name)).distinct().withColumn(mark, F.lit(1))
    # an anti join would be moved below the filter, to all rows
    left = beside.where(bit).join(ids, F.col(key) == F.col(name), "left").where(F.col(mark).isNull())
    return beside.where(~bit).select(df.columns).unionByName(left.select(df.columns))
