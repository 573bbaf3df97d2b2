"""Scanned documents as a data source whose input partitions are ranges of pages.

The driver asks each file for its number of pages only; every range of pages is a task of its own, so a file of many pages is read by many tasks.
Conditions on the page number and on the name of the file, and the limit of pages, are applied before ranges are made: pages beyond are never recognised.

What a file is, is told by an opener, ``module:function``: a function from a path to an object with ``pages``, their number, and ``page(i)``, the text of page i (from 1
on), made anew in every task; a recogniser of images goes there. ``FormFeeds`` reads texts whose pages end in form feeds.
"""

from __future__ import annotations

import importlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition, LessThan, LessThanOrEqual

from factloom.functions import text as T

#: Pages of a task.
RANGE = 16


class FormFeeds:
    """Pages of a UTF-8 text, each ended by a form feed but for the last."""

    def __init__(self, path: str):
        where, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        with where.open_input_stream(name) as f:
            self._pages = f.read().decode("utf-8", "replace").split("\f")
        if len(self._pages) > 1 and not self._pages[-1].strip():
            self._pages.pop()
        self.pages = len(self._pages)

    def page(self, i: int) -> str:
        return self._pages[i - 1]


def _files(path: str) -> list[str]:
    """The files of a path, itself if it is one, in order."""
    prefix = path.split("://")[0] + "://" if "://" in path else ""
    where, name = fs.FileSystem.from_uri(path) if prefix else (fs.LocalFileSystem(), path)
    if where.get_file_info(name).type == fs.FileType.File:
        return [path]
    found = where.get_file_info(fs.FileSelector(name, recursive=True))
    return sorted(prefix + x.path for x in found if x.type == fs.FileType.File and not x.base_name.startswith(("_", ".")))


def _name(path: str) -> str:
    return path.rsplit("/", 1)[-1].rsplit(".", 1)[0]


@dataclass
class Pages(InputPartition):
    path: str
    first: int
    last: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, opener: str, most: int | None, size: int):
        self.path, self.opener, self.most, self.size, self.only = path, opener, most, size, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes the conditions that ranges can follow; Spark applies the rest."""
        for f in filters:
            if isinstance(f, (LessThan, LessThanOrEqual)) and f.attribute == ("page_no",):
                limit = f.value - isinstance(f, LessThan)
                self.most = limit if self.most is None else min(self.most, limit)
            elif isinstance(f, EqualTo) and f.attribute == ("lecture",) and self.only in (None, f.value):
                self.only = f.value
            else:
                yield f

    def _open(self, path: str):
        module, made = self.opener.split(":")
        return getattr(importlib.import_module(module), made)(path)

    def partitions(self) -> list[Pages]:
        found = []
        for path in _files(self.path):
            if self.only is None or _name(path) == self.only:
                last = self._open(path).pages
                last = last if self.most is None else min(last, self.most)
                found += [Pages(path, i, min(last, i + self.size - 1)) for i in range(1, last + 1, self.size)]
        return found

    def read(self, part: Pages) -> Iterator[tuple[str, int, str]]:
        if part is None:  # no page at all
            return
        document = self._open(part.path)
        for i in range(part.first, part.last + 1):
            yield _name(part.path), i, document.page(i)


class ScanSource(DataSource):
    """Options: ``path``, ``opener`` (module:function), ``most`` (pages of a file), ``range`` (pages of a task)."""

    @classmethod
    def name(cls) -> str:
        return "factloom_scans"

    def schema(self) -> str:
        return "lecture string, page_no int, text string"

    def reader(self, schema) -> DataSourceReader:
        most = self.options.get("most")
        return _Reader(self.options["path"], self.options.get("opener", f"{__name__}:FormFeeds"), None if most is None else int(most), int(self.options.get("range", RANGE)))


def read_scans(spark: SparkSession, path: str, opener: str = f"{__name__}:FormFeeds", most: int | None = None, size: int = RANGE) -> DataFrame:
    """(lecture, page_no, text) of the scanned files under ``path``, the first ``most`` pages of each; texts as pages are written."""
    spark.dataSource.register(ScanSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("factloom_scans").option("path", path).option("opener", opener).option("range", size)
    return (reader if most is None else reader.option("most", most)).load().withColumn("text", T.page_text("text"))
