"""XLSX workbooks as a data source: ``spark.read.format("xlsx").load(path)``, one partition a file.

The format is a zip of XML parts; a sheet is streamed row by row. Files are opened through Arrow's file systems, so any store that Arrow
knows can hold them; where only Spark reaches a store, ``workbook_rows`` reads the same from Spark's own binary files.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Mapping, Sequence
from xml.etree import ElementTree

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file string, sheet string, row int, cells array<string>"
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Rows from the top among which a header is looked for.
HEADER_ROWS = 30


class LayoutError(ValueError):
    """A workbook whose layout isn't the declared one: nothing is guessed."""


def _column(place: str) -> int:
    """The number of the column of ``AB12``, from 0."""
    n = 0
    for c in re.match("[A-Z]+", place)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _texts(node: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_MAIN}t"))


def _target(target: str) -> str:
    """A part's name from the link to it: absolute, or beside the workbook part."""
    return target.lstrip("/") if target.startswith("/") else f"xl/{target}"


def read_sheets(content: bytes, sheet: str | None = None) -> Iterator[tuple[str, int, list[str | None]]]:
    """(sheet, row number from 1, cells as text) of the named sheet, or of all; empty cells are null, rows end with their last cell."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            for _, node in ElementTree.iterparse(z.open("xl/sharedStrings.xml")):
                if node.tag == f"{_MAIN}si":
                    shared.append(_texts(node))
                    node.clear()
        links = {r.get("Id"): r.get("Target") for r in ElementTree.parse(z.open("xl/_rels/workbook.xml.rels")).getroot()}
        for s in ElementTree.parse(z.open("xl/workbook.xml")).getroot().iter(f"{_MAIN}sheet"):
            if sheet is not None and s.get("name") != sheet:
                continue
            last = 0
            for _, node in ElementTree.iterparse(z.open(_target(links[s.get(_LINK)]))):
                if node.tag != f"{_MAIN}row":
                    continue
                last = int(node.get("r") or last + 1)
                cells: list[str | None] = []
                for c in node.iter(f"{_MAIN}c"):
                    at = _column(c.get("r")) if c.get("r") else len(cells)
                    cells += [None] * (at + 1 - len(cells))
                    value, kind = c.find(f"{_MAIN}v"), c.get("t")
                    if kind == "inlineStr":
                        cells[at] = _texts(c)
                    elif value is not None and value.text is not None:
                        cells[at] = shared[int(value.text)] if kind == "s" else value.text
                yield s.get("name"), last, cells
                node.clear()


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, path: str, sheet: str | None):
        self.path, self.sheet = path, sheet

    def partitions(self) -> Sequence[InputPartition]:
        files, root = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        info = files.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.is_file else files.get_file_info(fs.FileSelector(root, recursive=True))
        return [_File(f.path) for f in found if f.is_file and f.extension == "xlsx" and not f.base_name.startswith(("~", "."))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        files = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path or self.path.startswith("file:") else fs.LocalFileSystem()
        with files.open_input_stream(partition.path) as f:
            content = f.read()
        for name, row, cells in read_sheets(content, self.sheet):
            yield partition.path, name, row, cells


class Workbook(DataSource):
    """Rows ``(file, sheet, row, cells)``. Option ``sheet``: one sheet by name, else all. Files elsewhere than ``*.xlsx`` under a folder are skipped."""

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ARG002
        if not self.options.get("path"):
            raise ValueError("a path is needed")
        return _Reader(self.options["path"], self.options.get("sheet"))


def register(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(Workbook)
    return spark


def workbook_rows(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """The same rows through Spark's binary files, from any store that Spark reads."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = list(read_sheets(content, sheet))
                columns = list(zip(*found, strict=True)) or [[], [], []]
                kinds = (pa.string(), pa.int32(), pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], ["file", "sheet", "row", "cells"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path)
    return files.select("path", "content").mapInArrow(rows, SCHEMA)


def series_by_header(rows: DataFrame, prefixes: Mapping[str, str]) -> DataFrame:
    """``(file, sheet, code, date, value)``: for each code the column whose header begins with its prefix, dated by the first column, at the month's start.

    The header is the first of a sheet's first 30 rows with such a cell. A prefix that no or several headers begin with, and a column without a number, is refused.
    Dates are day numbers or ISO text; rows without a date or a number are left out. The check takes a job over the headers.
    """
    keys, key = ["file", "sheet"], F.col("cells")
    starts = lambda p: F.filter(F.sequence(F.lit(0), F.size(key) - 1), lambda i: F.coalesce(F.get(key, i).startswith(p), F.lit(False)))
    top = rows.where((F.col("row") <= HEADER_ROWS) & (F.size(key) > 0)).select(*keys, "row", *[starts(p).alias(f"_{i}") for i, p in enumerate(prefixes.values())])
    some = top.where(" OR ".join(f"size(_{i}) > 0" for i in range(len(prefixes))))
    heads = some.groupBy(*keys).agg(F.min_by(F.struct("row", *[f"_{i}" for i in range(len(prefixes))]), "row").alias("h"))
    sheets = rows.select(*keys).distinct().join(heads, keys, "left").collect()  # a row a sheet
    for s in sheets:
        for i, (code, prefix) in enumerate(prefixes.items()):
            n = len(s.h[f"_{i}"]) if s.h else 0
            if n != 1:
                raise LayoutError(f"{s.file}, {s.sheet}: {n} headers begin with {prefix!r} ({code})")
    told = heads.select(*keys, F.col("h.row").alias("_head"), F.explode(F.array(*[F.struct(F.lit(c).alias("code"), F.get(F.col(f"h._{i}"), F.lit(0)).alias("at")) for i, c in enumerate(prefixes)])).alias("e"))
    body = rows.join(F.broadcast(told), keys).where(F.col("row") > F.col("_head"))  # as many rows as sheets and codes
    first = F.get(key, F.lit(0))
    days = first.try_cast("double")
    date = F.when(days.isNotNull(), F.date_add(F.lit("1899-12-30").cast("date"), F.floor(days).cast("int"))).otherwise(F.substring(first, 1, 10).try_cast("date"))
    out = body.select(*keys, "e.code", F.trunc(date, "MM").alias("date"), F.get(key, F.col("e.at")).try_cast("double").alias("value")).where("date IS NOT NULL AND value IS NOT NULL")
    found = {(r.file, r.sheet, r.code) for r in out.select(*keys, "code").distinct().collect()}
    for s in sheets:
        for code in prefixes:
            if (s.file, s.sheet, code) not in found:
                raise LayoutError(f"{s.file}, {s.sheet}: no numbers for {code}")
    return out
