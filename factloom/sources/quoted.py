"""Tables with quoted fields that may hold line ends, read by many tasks a file.

A file is cut into byte ranges at line ends, as any text is, and a range does not know whether it begins inside a quoted field. So each range is read twice. First it tells,
for both cases, whether it ends inside one and how many records begin in it; ranges are few, and what each is told by the ones before it follows from these
answers. Then each range, told how it begins and how many records came before, cuts its own records; only those that cross ranges are put together from their pieces.

A quote opens a field at its beginning only, doubled quotes inside are one quote, and what follows a closing quote belongs to the field. Empty lines outside quotes are no
records.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ends_inside(line: str, inside: bool, sep: str = "\t") -> bool:
    """Whether a line that begins inside a quoted field or not ends inside one."""
    if '"' not in line:
        return inside
    i = 0
    while True:
        if inside:
            j = line.find('"', i)
            if j < 0:
                return True
            if line.startswith('"', j + 1):
                i = j + 2
                continue
            inside, i = False, j + 1
        elif line.startswith('"', i):
            inside, i = True, i + 1
            continue
        j = line.find(sep, i)
        if j < 0:
            return False
        i = j + 1


def fields(text: str, sep: str = "\t") -> list[str]:
    """The fields of a record; an open quote at its end closes there."""
    if '"' not in text:
        return text.removesuffix("\r").split(sep)
    out, i = [], 0
    while True:
        own = []
        if text.startswith('"', i):
            i += 1
            while True:
                j = text.find('"', i)
                own.append(text[i:] if j < 0 else text[i:j])
                i = len(text) if j < 0 else j + 1
                if j < 0 or not text.startswith('"', i):
                    break
                own.append('"')
                i += 1
        j = text.find(sep, i)
        out.append("".join(own) + (text[i:].removesuffix("\r") if j < 0 else text[i:j]))
        if j < 0:
            return out
        i = j + 1


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], str]]:
    for batch in batches:
        for file, start, line in zip(*(batch.column(i).to_pylist() for i in range(3))):
            yield (file, start), line


def _tell(sep: str):
    """Lines of ranges to a row a range: (file, start, and for both beginnings, outside and inside, the end and the number of records that begin)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: dict[tuple[str, int], list] = {}
        for key, line in _rows(batches):
            state = told.setdefault(key, [False, 0, True, 0])
            for k in (0, 2):
                state[k + 1] += not state[k] and line.strip("\r") != ""
                state[k] = ends_inside(line, state[k], sep)
        if told:
            keys, values = zip(*told.items())
            columns = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64())]
            columns += [pa.array([v[i] for v in values], pa.int64() if i % 2 else pa.bool_()) for i in range(4)]
            yield pa.RecordBatch.from_arrays(columns, ["file", "start", "out_end", "out_n", "in_end", "in_n"])

    return run


def _cut(begin, sep: str):
    """Lines of ranges to (file, record, start, whole, text): records that lie in one range, and pieces of those that don't."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        now, inside, number, held, whole = None, False, 0, [], True

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string()))], ["file", "record", "start", "whole", "text"])
            out.clear()
            return made

        for key, line in _rows(batches):
            if key != now:
                if held:
                    out.append((*(now[0], number - 1, now[1]), False, "\n".join(held)))
                now, (inside, number), held = key, begin.value[key], []
                whole = not inside
            if not inside and line.strip("\r") == "":
                continue
            if not inside:
                number, whole = number + 1, True
            held.append(line)
            inside = ends_inside(line, inside, sep)
            if not inside:
                out.append((now[0], number - 1, now[1], whole, "\n".join(held)))
                held = []
                if len(out) >= 5000:
                    yield batch()
        if held:
            out.append((now[0], number - 1, now[1], False, "\n".join(held)))
        if out:
            yield batch()

    return run


def _fields(sep: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [fields(t, sep) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(told, pa.list_(pa.string()))], ["file", "record", "fields"])

    return run


def read_records(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """(file, record, fields) of every record under ``path``, the headers too; records are numbered from 0 in each file."""
    lines = spark.read.option("lineSep", "\n").text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    told = lines.mapInArrow(_tell(sep), "file string, start long, out_end boolean, out_n long, in_end boolean, in_n long").collect()  # a row a range
    begin: dict[tuple[str, int], tuple[bool, int]] = {}
    file, inside, number = None, False, 0
    for r in sorted(told):
        if r["file"] != file:
            file, inside, number = r["file"], False, 0
        begin[r["file"], r["start"]] = inside, number
        number += r["in_n"] if inside else r["out_n"]
        inside = r["in_end"] if inside else r["out_end"]
    pieces = lines.mapInArrow(_cut(spark.sparkContext.broadcast(begin), sep), "file string, record long, start long, whole boolean, text string")
    split = pieces.where("not whole").groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("start", "text"))).alias("p"))
    split = split.select("file", "record", F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"))
    records = pieces.where("whole").select("file", "record", "text").unionByName(split)
    return records.mapInArrow(_fields(sep), "file string, record long, fields array<string>")


def read_quoted(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """A table with a header in every file, all columns strings, missing fields "", with ``ord`` in file order: the place in the file, files in order of
    their paths. Fields beyond the header's go."""
    records = read_records(spark, path, sep)
    heads = sorted((r["file"], r["fields"]) for r in records.where("record = 0").collect())  # a row a file
    names = [c.lstrip("﻿") for c in heads[0][1]] if heads else []
    files = {f: i for i, (f, _) in enumerate(heads)}
    place = F.create_map(*[F.lit(x) for f, i in files.items() for x in (f, i)])[F.col("file")] if len(files) > 1 else F.lit(0)
    rows = records.where("record > 0")
    own = [F.coalesce(F.get("fields", F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names)]
    return rows.select(*own, (F.shiftleft(place.cast("long"), 33) + F.col("record") - 1).alias("ord"))
