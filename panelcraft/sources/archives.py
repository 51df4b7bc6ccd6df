"""Zip archives of text as a Spark source and sink: one task per member when reading, one per archive when writing."""

from __future__ import annotations

import fnmatch
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Bytes of text inflated at once.
CHUNK = 1 << 20


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The store of a path or URI, and the path in it."""
    return pafs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)


def list_files(path: str, pattern: str) -> list[tuple[str, int]]:
    """Files at or below a path whose names fit, with their sizes, in order."""
    store, root = opened(path)
    if (only := store.get_file_info(root)).type == pafs.FileType.File:
        return [(root, only.size)]
    found = store.get_file_info(pafs.FileSelector(root, recursive=True))
    return sorted((f.path, f.size) for f in found if f.type == pafs.FileType.File and fnmatch.fnmatch(f.base_name, pattern))


@dataclass
class Member(InputPartition):
    """One text file inside an archive."""

    path: str
    name: str


class LineReader(DataSourceReader):
    """Plans from the archives' directories alone, which lie at their ends; no archive is read whole."""

    def __init__(self, path: str, pattern: str) -> None:
        self.path, self.pattern = path, pattern

    def partitions(self) -> list[Member]:
        store, _ = opened(self.path)
        out = []
        for path, _ in list_files(self.path, self.pattern):
            with store.open_input_file(path) as handle, zipfile.ZipFile(handle) as archive:
                out += [Member(path, m.filename) for m in archive.infolist() if not m.is_dir()]
        return out

    def read(self, partition: Member) -> Iterator[pa.RecordBatch]:
        store, _ = opened(self.path)
        with store.open_input_file(partition.path) as handle, zipfile.ZipFile(handle) as archive, archive.open(partition.name) as text:
            archive_name = partition.path.rsplit("/", 1)[-1]
            for lines in iter(lambda: text.readlines(CHUNK), []):
                values = pa.array([x.rstrip(b"\r\n").decode("utf-8") for x in lines], pa.string())
                names = pa.array([archive_name] * len(lines)), pa.array([partition.name] * len(lines))
                yield pa.RecordBatch.from_arrays([*names, values], names=["archive", "member", "value"])


@dataclass
class Written(WriterCommitMessage):
    """Archives that a task has written under temporary names."""

    names: list[str]


class LineWriter(DataSourceArrowWriter):
    """Writes the lines of each archive as they come, members one after the other; names are given when all tasks are done."""

    def __init__(self, path: str) -> None:
        self.path = path
        self.job = f"_writing-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = opened(self.path)
        mine, names, archive, sink, at, text = uuid.uuid4().hex, [], None, None, (None, None), None
        store.create_dir(f"{root}/{self.job}/{mine}", recursive=True)
        for batch in iterator:
            for name, member, value in zip(*(batch.column(c).to_pylist() for c in ("archive", "member", "value"))):
                if (name, member) != at:
                    if text:
                        text.close()
                    if name != at[0]:
                        if archive:
                            archive.close()
                            sink.close()
                        if f"{mine}/{name}" in names:
                            raise ValueError("rows of an archive must come one after the other")
                        sink = store.open_output_stream(f"{root}/{self.job}/{mine}/{name}")
                        archive = zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED)
                        names.append(f"{mine}/{name}")
                    info = zipfile.ZipInfo(member)  # a fixed time stamp: equal rows give equal bytes
                    info.compress_type = zipfile.ZIP_DEFLATED
                    text, at = archive.open(info, "w", force_zip64=True), (name, member)
                text.write(value.encode() + b"\n")
        if archive:
            text.close()
            archive.close()
            sink.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = opened(self.path)
        names = [n for m in messages if m for n in m.names]
        if len({n.split("/", 1)[1] for n in names}) < len(names):
            self.abort(messages)
            raise ValueError("an archive came out of several tasks")
        for name in names:
            store.move(f"{root}/{self.job}/{name}", f"{root}/{name.split('/', 1)[1]}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        store, root = opened(self.path)
        if store.get_file_info(f"{root}/{self.job}").type != pafs.FileType.NotFound:
            store.delete_dir(f"{root}/{self.job}")


class ZippedLines(DataSource):
    """Rows of (archive, member, value): the lines of text files in zip archives.

    Option `pattern` (default `*.zip`) chooses the archives below the path. Paths are those that Arrow's file systems
    open: local ones and URIs of object stores.
    """

    @classmethod
    def name(cls) -> str:
        return "zipped_lines"

    def schema(self) -> str:
        return "archive STRING, member STRING, value STRING"

    def reader(self, schema) -> LineReader:
        return LineReader(self.options["path"], self.options.get("pattern", "*.zip"))

    def writer(self, schema, overwrite: bool) -> LineWriter:
        return LineWriter(self.options["path"])


def read_zipped_lines(spark: SparkSession, path: str, pattern: str = "*.zip") -> DataFrame:
    """Text lines of the zip archives below a path, one task per member, inflated a piece at a time."""
    spark.dataSource.register(ZippedLines)
    return spark.read.format("zipped_lines").option("pattern", pattern).load(path)


def write_zipped_lines(df: DataFrame, path: str) -> None:
    """Rows of (archive, member, value) as archives; the rows of an archive must stand together in one partition."""
    df.sparkSession.dataSource.register(ZippedLines)
    df.select("archive", "member", "value").write.format("zipped_lines").mode("append").save(path)
