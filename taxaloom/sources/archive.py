"""Members of zip and tar archives as tables of lines, a partition to each member; nothing is unpacked to disk."""

from __future__ import annotations

import tarfile
import zipfile
from collections.abc import Iterator
from fnmatch import fnmatch

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "member string, line bigint, value string"
#: Lines in an Arrow batch.
BATCH = 50_000
SUFFIXES = (".zip", ".tar", ".tgz", ".tar.gz", ".tar.bz2", ".tar.xz")


def is_archive(path: str) -> bool:
    return path.lower().endswith(SUFFIXES)


def _opened(path: str):
    """The archive's bytes: of a plain path or file: URI this machine's, else those of the file system of the URI."""
    if "://" in path and not path.startswith("file:"):
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(path)
        return store.open_input_file(inner)
    return open(path.removeprefix("file://").removeprefix("file:"), "rb")


def members(path: str) -> list[str]:
    """The names of an archive's files, in its order."""
    with _opened(path) as raw:
        if path.lower().endswith(".zip"):
            with zipfile.ZipFile(raw) as z:
                return [i.filename for i in z.infolist() if not i.is_dir()]
        with tarfile.open(fileobj=raw, mode="r:*") as t:
            return [m.name for m in t if m.isfile()]


def _text(f) -> Iterator[str]:
    return (x.decode("utf-8", "replace").rstrip("\r\n") for x in f)


def _lines(path: str, member: str) -> Iterator[str]:
    """A member's lines, without their ends; bytes that are no UTF-8 are replaced."""
    with _opened(path) as raw:
        if path.lower().endswith(".zip"):
            with zipfile.ZipFile(raw) as z, z.open(member) as f:
                yield from _text(f)
            return
        with tarfile.open(fileobj=raw, mode="r:*") as t:
            found = next((m for m in t if m.isfile() and m.name == member), None)
            if found is not None:
                yield from _text(t.extractfile(found))


class Member(InputPartition):
    def __init__(self, name: str) -> None:
        super().__init__(name)


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, pattern: str) -> None:
        self.path, self.pattern = path, pattern

    def partitions(self) -> list[Member]:
        return [Member(m) for m in members(self.path) if fnmatch(m, self.pattern) or fnmatch(m.rpartition("/")[2], self.pattern)]

    def read(self, partition: Member) -> Iterator[pa.RecordBatch]:
        held, at = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([partition.value] * len(held)), pa.array(range(at, at + len(held)), pa.int64()), pa.array(held, pa.string())], ["member", "line", "value"])

        for line in _lines(self.path, partition.value):
            held.append(line)
            if len(held) == BATCH:
                yield batch()
                held, at = [], at + BATCH
        if held:
            yield batch()


class ArchiveSource(DataSource):
    """spark.read.format("archive").option("members", "*.dmp").load(path): member, line, value."""

    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"], self.options.get("members", "*"))


def read_archive(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """member, line (its place, from 0) and value of the text files in an archive whose path or name fits the pattern."""
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("archive").option("members", pattern).load(path)
