"""Sequences of readings as a data source: folders of files with lines "value minutes valid", read and written, at rest or as they come.

    spark.dataSource.register(SequenceSource)
    spark.readStream.format("sequence").load(folder)     # key, seq, value, ts_min
    decisions.writeStream.format("sequence").option("path", folder)

A file in a folder key=<key> belongs to that key, any other to a key of its own name. Files are taken in the order of
their names, so a new one must be named behind those already there. seq orders all lines: the file's place times 2^32, and
the line's place in it, from 0. A reading that isn't valid, or no number, is missing.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pa_fs
from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "key string, seq long, value double, ts_min double"
#: Lines that are handed on at once.
LINES = 1 << 14
NUMBER = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?")


def store(path: str) -> tuple[pa_fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    return pa_fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", path)) if "://" in path or path.startswith("file:") else (pa_fs.LocalFileSystem(), path)


def listed(path: str) -> list[str]:
    """Names of the files below a folder, in order; names that begin with _ or . are none of the sequences'."""
    fs, root = store(path)
    found = fs.get_file_info(pa_fs.FileSelector(root, recursive=True, allow_not_found=True))
    names = [f.path[len(root.rstrip("/")) + 1 :] for f in found if f.type == pa_fs.FileType.File]
    return sorted((n for n in names if not any(p[0] in "_." for p in n.split("/"))), key=lambda n: (n.rsplit("/", 1)[-1], n))


def key_of(name: str) -> str:
    folder = next((p for p in name.split("/")[:-1] if p.startswith("key=")), None)
    return unquote(folder[4:]) if folder else name.rsplit("/", 1)[-1].removesuffix(".txt")


@dataclass
class Part(InputPartition):
    path: str
    name: str
    place: int


def lines_of(part: Part) -> Iterator[pa.RecordBatch]:
    """(key, seq, value, ts_min) of a file's lines, so many at a time."""
    fs, root = store(part.path)
    at, held, key = part.place << 32, [], key_of(part.name)

    def batch() -> pa.RecordBatch:
        columns = zip(*held)
        kinds = (pa.string(), pa.int64(), pa.float64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["key", "seq", "value", "ts_min"])

    with fs.open_input_stream(f"{root.rstrip('/')}/{part.name}") as f:
        rest = b""
        while True:
            piece = f.read(1 << 20)
            *whole, rest = (rest + piece).split(b"\n") if piece else ([rest, b""] if rest else [b""])
            for line in whole:
                value, t, ok = [*line.decode().split(), "", "", ""][:3]
                held.append((key, at, float(value) if ok == "1" and NUMBER.fullmatch(value) else None, float(t) if NUMBER.fullmatch(t) else None))
                at += 1
                if len(held) == LINES:
                    yield batch()
                    held.clear()
            if not piece:
                break
    if held:
        yield batch()


class SequenceSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sequence"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return SequenceReader(self.options["path"])

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return SequenceStreamReader(self.options["path"])

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamWriter:
        return SequenceStreamWriter(self.options["path"])


class SequenceReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Part]:
        return [Part(self.path, n, k) for k, n in enumerate(listed(self.path))]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if partition is not None:  # an empty folder has none
            yield from lines_of(partition)


class SequenceStreamReader(DataSourceStreamReader):
    """An offset is the number of files, in their order, that have been taken."""

    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {"files": 0}

    def latestOffset(self) -> dict:
        return {"files": len(listed(self.path))}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        names = listed(self.path)
        return [Part(self.path, names[k], k) for k in range(start["files"], end["files"])]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        yield from lines_of(partition)

    def commit(self, end: dict) -> None:
        """Files stay where they are."""


@dataclass
class Written(WriterCommitMessage):
    """A task's pending files: (key, name)."""

    files: list[tuple[str, str]]


class SequenceStreamWriter(DataSourceStreamWriter):
    """Rows key, seq, value, ts_min to a file for each key and batch; a key's rows of a batch must come to one task, as they do behind groupBy("key").

    Tasks write pending files. A commit first drops what an attempt at the same batch has left, then moves the files to their
    names, which tell the batch, and last leaves a mark; a batch that has its mark is not written again.
    """

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[Row]) -> Written:
        held: dict[str, list[tuple]] = {}
        for r in iterator:
            held.setdefault(r["key"], []).append((r["seq"], r["value"], r["ts_min"]))
        fs, root = store(self.path)
        fs.create_dir(f"{root}/_pending", recursive=True)
        files = []
        for key, rows in held.items():
            name = f"_pending/{uuid.uuid4().hex}"
            with fs.open_output_stream(f"{root}/{name}") as f:
                for _, value, t in sorted(rows, key=lambda r: r[0]):
                    missing = value is None or math.isnan(value)
                    f.write(f"{'nan' if missing else repr(value)} {t!r} {int(not missing)}\n".encode())
            files.append((key, name))
        return Written(files)

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        fs, root = store(self.path)
        pending = [x for m in messages if m is not None for x in m.files]
        mark, batch = f"{root}/_done/{batchId:012d}", f"{batchId:012d}-"
        if fs.get_file_info(mark).type == pa_fs.FileType.File:
            self._drop(fs, root, [name for _, name in pending])
            return
        self._drop(fs, root, [n for n in listed(self.path) if n.rsplit("/", 1)[-1].startswith(batch)])
        for k, (key, name) in enumerate(sorted(pending)):
            folder = f"{root}/key={quote(key, safe='')}"
            fs.create_dir(folder, recursive=True)
            fs.move(f"{root}/{name}", f"{folder}/{batch}{k:06d}.txt")
        fs.create_dir(f"{root}/_done", recursive=True)
        with fs.open_output_stream(mark):
            pass

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        fs, root = store(self.path)
        self._drop(fs, root, [name for m in messages if m is not None for _, name in m.files])

    @staticmethod
    def _drop(fs: pa_fs.FileSystem, root: str, names: list[str]) -> None:
        for n in names:
            if fs.get_file_info(f"{root}/{n}").type == pa_fs.FileType.File:
                fs.delete_file(f"{root}/{n}")
