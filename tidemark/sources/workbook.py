"""Workbooks as a Spark data source: every sheet's cells as rows (book, sheet, row, col, value), read from the files' own XML.

    spark.dataSource.register(WorkbookSource)
    spark.read.format("workbook").load("file:///books")
"""

from __future__ import annotations

import glob
import io
import os
import re
import zipfile
from collections.abc import Iterator
from urllib.parse import urlparse
from xml.etree import ElementTree

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

CELLS = "book string, sheet string, row int, col int, value string"
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref).group():  # type: ignore[union-attr]
        n = 26 * n + ord(c) - 64
    return n


def cells(name: str, data: bytes) -> Iterator[tuple[str, str, int, int, str]]:
    """All cells of a workbook that hold something."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        there = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in there:
            shared = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
        targets = {r.get("Id"): r.get("Target", "").lstrip("/") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
            path = targets.get(sheet.get(_REL), "")
            path = path if path.startswith("xl/") else f"xl/{path}"
            if path not in there:
                continue
            for c in ElementTree.fromstring(z.read(path)).iter(f"{_MAIN}c"):
                kind, v = c.get("t"), c.find(f"{_MAIN}v")
                if kind == "inlineStr":
                    value = "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
                elif v is None or v.text is None:
                    continue
                else:
                    value = shared[int(v.text)] if kind == "s" else v.text
                ref = c.get("r", "")
                if value.strip():
                    yield name, sheet.get("name", ""), int(re.sub("[^0-9]", "", ref)), _column(ref), value


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class WorkbookReader(DataSourceReader):
    def __init__(self, folder: str) -> None:
        url = urlparse(folder)
        self.folder = url.path if url.scheme in ("", "file") else folder

    def partitions(self) -> list[InputPartition]:
        found = [self.folder] if self.folder.endswith(".xlsx") else sorted(glob.glob(f"{self.folder}/*.xlsx"))
        return [_File(p) for p in found]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:  # type: ignore[attr-defined]
            yield from cells(os.path.basename(partition.path), f.read())  # type: ignore[attr-defined]


class WorkbookSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return CELLS

    def reader(self, schema: StructType) -> WorkbookReader:
        return WorkbookReader(self.options.get("path", ""))


def from_binary(files):
    """The same cells from a DataFrame of spark.read.format('binaryFile'), for stores that only Spark reads."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = list(cells(path.rsplit("/", 1)[-1], data))
                if rows:
                    kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in CELLS.split(", ")])

    return files.select("path", "content").mapInArrow(run, CELLS)
