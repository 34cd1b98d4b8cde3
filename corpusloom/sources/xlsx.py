"""Workbooks as a Spark data source: ``spark.read.format("xlsx").load(path)``.

All cells of the first sheet are strings; missing cells of a row are empty.
Options: ``path`` (a file or a comma-separated list, on a path that executors
can open), ``header`` (default true). Every file is one input partition.
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from xml.etree.ElementTree import fromstring, iterparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def column_number(reference: str) -> int:
    """``A1`` is 0, ``AB7`` is 27."""
    n = 0
    for letter in re.match("[A-Z]+", reference).group():
        n = n * 26 + ord(letter) - 64
    return n - 1


def _text(element) -> str:
    return "".join(t.text or "" for t in element.iter(f"{MAIN}t"))


def rows(path: str) -> Iterator[list[str]]:
    """Rows of the first sheet, read as a stream."""
    with zipfile.ZipFile(path) as book:
        names = book.namelist()
        shared = [_text(s) for s in fromstring(book.read("xl/sharedStrings.xml")).iter(f"{MAIN}si")] if "xl/sharedStrings.xml" in names else []
        sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
        with book.open(sheets[0]) as sheet:
            for _, element in iterparse(sheet):
                if element.tag != f"{MAIN}row":
                    continue
                row: list[str] = []
                for cell in element.iter(f"{MAIN}c"):
                    at = column_number(cell.get("r")) if cell.get("r") else len(row)
                    row.extend([""] * (at - len(row)))
                    if cell.get("t") == "inlineStr":
                        row.append(_text(cell))
                    else:
                        value = cell.find(f"{MAIN}v")
                        value = "" if value is None else value.text or ""
                        row.append(shared[int(value)] if cell.get("t") == "s" and value else value)
                yield row
                element.clear()


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str], header: bool, width: int):
        self.paths, self.header, self.width = paths, header, width

    def partitions(self):
        return [InputPartition(p) for p in self.paths]

    def read(self, partition):
        for number, row in enumerate(rows(partition.value)):
            if number or not self.header:
                yield tuple((row + [""] * self.width)[: self.width])


class XlsxSource(DataSource):
    @classmethod
    def name(cls):
        return "xlsx"

    def _paths(self) -> list[str]:
        return [p.strip() for p in self.options["path"].split(",")]

    def _header(self) -> bool:
        return self.options.get("header", "true").lower() == "true"

    def schema(self):
        first = next(rows(self._paths()[0]), [])
        names = first if self._header() else [f"c{i}" for i in range(len(first))]
        return StructType([StructField(n or f"c{i}", StringType()) for i, n in enumerate(names)])

    def reader(self, schema):
        return _Reader(self._paths(), self._header(), len(schema.fields))


def read_xlsx(spark: SparkSession, *paths: str, header: bool = True) -> DataFrame:
    spark.dataSource.register(XlsxSource)
    return spark.read.format("xlsx").option("header", str(header).lower()).load(",".join(paths))
