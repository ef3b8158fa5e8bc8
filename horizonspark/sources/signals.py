"""Signal records as a data source: spark.read.format("signal_records").load(path), and its stream.

One partition a file; files are tab-separated lines with or without a byte-order mark. Records that cannot be read come with the column
`corrupt` holding the line, so that none is lost silently; a file that is not UTF-8 or takes longer than the option
`timeout` (seconds) fails its task with its name.
"""

from __future__ import annotations

import datetime as dt
import io
import os
import time
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "start date, end date, signal int, name string, file string, corrupt string"
#: Fields of a record at least, and where its signal, name, first and last day stand.
FIELDS, NAME, SIGNAL, FIRST, LAST = 16, 2, 3, 6, 11


def parse_record(line: str) -> tuple | None:
    """(start, end, signal, name) of a line, or None if it is no record."""
    f = line.strip().split("\t")
    if len(f) < FIELDS:
        return None
    try:
        days = [dt.date(int(f[at + 2]), int(f[at + 1]), int(f[at])) for at in (FIRST, LAST)]
        return *days, int(f[SIGNAL]), f[NAME]
    except ValueError:
        return None


def read_file(path: str, timeout: float) -> Iterator[tuple]:
    """Rows of a file, one at a time; blank lines are none."""
    began = time.monotonic()
    store, inner = fs.FileSystem.from_uri(path)
    with io.TextIOWrapper(store.open_input_stream(inner), encoding="utf-8-sig") as lines:
        try:
            for line in lines:
                if time.monotonic() - began > timeout:
                    raise TimeoutError(f"{path}: longer than {timeout} seconds")
                if line.strip():
                    found = parse_record(line)
                    yield (*found, path, None) if found else (None, None, None, None, path, line.rstrip("\r\n"))
        except UnicodeDecodeError as e:
            raise ValueError(f"{path}: not UTF-8") from e


class _Partition(InputPartition):
    def __init__(self, path: str):
        self.path = path


def _files(options: dict) -> list[str]:
    """The files of a folder (or one file) in any store that pyarrow opens, by name; those that begin with . or _ are not data."""
    path = options["path"]
    path = path if ":/" in path else os.path.abspath(path)
    store, inner = fs.FileSystem.from_uri(path)
    info = store.get_file_info(inner)
    found = store.get_file_info(fs.FileSelector(inner, recursive=True)) if info.type == fs.FileType.Directory else [info]
    prefix = path[: path.index(inner)] if inner in path else ""
    return sorted(prefix + f.path for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._")


class SignalReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        found = _files(self.options)
        if not found:
            raise FileNotFoundError(self.options["path"])
        return [_Partition(f) for f in found]

    def read(self, partition: _Partition) -> Iterator[tuple]:
        return read_file(partition.path, float(self.options.get("timeout", 30)))


class SignalStream(DataSourceStreamReader):
    """New files in order of their names, a partition each; a file should be there whole when its name appears, after those read before."""

    def __init__(self, options: dict):
        self.options = options

    def initialOffset(self) -> dict:  # noqa: N802
        return {"file": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"file": max(_files(self.options), default="")}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Partition(f) for f in _files(self.options) if start["file"] < f <= end["file"]]

    def read(self, partition: _Partition) -> Iterator[tuple]:
        return read_file(partition.path, float(self.options.get("timeout", 30)))


class SignalRecords(DataSource):
    @classmethod
    def name(cls) -> str:
        return "signal_records"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return SignalReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return SignalStream(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SignalRecords)
