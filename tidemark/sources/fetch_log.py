"""The log of what was fetched, as a streaming source: fetchers append to it, and the engine reads each fetch once.

    spark.dataSource.register(FetchLog)
    spark.readStream.format("fetches").load(root)      # or spark.read for all of it

A log is a folder of numbered entries, ``<root>/<number>/host=<host>/part-*.json``, each written by one Spark job (``appended``). An entry
counts once Spark has marked its folder with ``_SUCCESS`` and all before it count too, so a fetcher that dies leaves nothing that is read.
The offset is the number of entries that count; a batch is the entries between two offsets, a partition for each entry and host, so a
slow or large host is a task of its own. Offsets are in the stream's checkpoint: a restart goes on with the next entry.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from urllib.parse import unquote

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

FETCHES = "host string, url string, status int, final_url string, error string, body string, at string"
_FIELDS = [c.split()[0] for c in FETCHES.split(", ")]


def _store(root: str):  # noqa: ANN202
    from pyarrow import fs  # its threads belong to the processes that read, not to those that fork them

    return fs.FileSystem.from_uri(root if "://" in root else "file://" + root.removeprefix("file:"))


def _children(store, path: str) -> list:  # noqa: ANN001
    from pyarrow import fs

    return store.get_file_info(fs.FileSelector(path, allow_not_found=True))


def entries(root: str) -> int:
    """How many entries count."""
    store, path = _store(root)
    n = 0
    while store.get_file_info(f"{path}/{n}/_SUCCESS").is_file:
        n += 1
    return n


def appended(fetches: DataFrame, root: str, number: int) -> None:
    """Write an entry of the log. Writing a number again replaces what a writer that died has left of it."""
    fetches.select(*_FIELDS).write.mode("overwrite").partitionBy("host").json(f"{root}/{number}")


class _HostOfEntry(InputPartition):
    def __init__(self, folder: str, host: str) -> None:
        self.folder, self.host = folder, host


def _partitions(root: str, start: int, end: int) -> list[_HostOfEntry]:
    store, path = _store(root)
    return [_HostOfEntry(f.path, unquote(f.base_name.removeprefix("host="))) for n in range(start, end) for f in _children(store, f"{path}/{n}") if not f.is_file and f.base_name.startswith("host=")]


def _rows(root: str, part: _HostOfEntry) -> Iterator[tuple]:
    store, _ = _store(root)
    host = None if part.host == "__HIVE_DEFAULT_PARTITION__" else part.host
    for f in sorted(_children(store, part.folder), key=lambda f: f.path):
        if f.is_file and f.base_name.startswith("part-"):
            with store.open_input_stream(f.path) as stream:
                rest = b""
                while block := stream.read(1 << 20):  # a line at a time, whatever the file's size
                    *lines, rest = (rest + block).split(b"\n")
                    for line in lines:
                        if line:
                            yield _row(line, host)
                if rest:
                    yield _row(rest, host)


def _row(line: bytes, host: str | None) -> tuple:
    value = json.loads(line)
    return (host, *(value.get(c) for c in _FIELDS[1:]))


class _Batch(DataSourceReader):
    def __init__(self, root: str) -> None:
        self.root = root

    def partitions(self) -> list[_HostOfEntry]:
        return _partitions(self.root, 0, entries(self.root))

    def read(self, partition: _HostOfEntry) -> Iterator[tuple]:
        return _rows(self.root, partition)


class _Stream(DataSourceStreamReader):
    def __init__(self, root: str) -> None:
        self.root = root

    def initialOffset(self) -> dict:  # noqa: N802
        return {"entries": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"entries": entries(self.root)}

    def partitions(self, start: dict, end: dict) -> list[_HostOfEntry]:
        return _partitions(self.root, start["entries"], end["entries"])

    def read(self, partition: _HostOfEntry) -> Iterator[tuple]:
        return _rows(self.root, partition)


class FetchLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fetches"

    def schema(self) -> str:
        return FETCHES

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Batch(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: ANN001, N802
        return _Stream(self.options["path"])
