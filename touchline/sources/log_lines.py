"""A data source of text log lines by byte range, for batch jobs and for logs that are still being written.

``spark.read.format("log_lines")`` and ``spark.readStream.format("log_lines")`` give ``path, pos, line``: a line is read by
the partition whose byte range it begins in, and ``pos`` is the byte it begins at, so the order of a log's lines does not
hang on how it was split. Options: ``path`` (a file or a folder) or ``paths`` (a JSON list of them), ``partition_bytes``, and for batch jobs ``task_bytes``: a task reads
as many ranges, of the same file or of several, as come to so many bytes (``partition_bytes`` if not given).
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..session import ship_package

SCHEMA = "path string, pos bigint, line string"
PARTITION_BYTES = 32 << 20
BLOCK = 1 << 20


@dataclass
class Range(InputPartition):
    """The lines of ``path`` that begin in bytes ``first`` to ``last`` (exclusive)."""

    place: str
    path: str
    first: int
    last: int


@dataclass
class Ranges(InputPartition):
    """What one task reads."""

    parts: list[Range]


def _dealt(parts: Iterable[Range], task_bytes: int) -> Iterator[Ranges]:
    """Ranges in order, several to a task while they come to no more than ``task_bytes``: many small logs are few tasks."""
    held, size = [], 0
    for part in parts:
        if held and size + part.last - part.first > task_bytes:
            yield Ranges(held)
            held, size = [], 0
        held.append(part)
        size += part.last - part.first
    if held:
        yield Ranges(held)


def _files(places: Sequence[str]) -> Iterator[tuple[str, str, int]]:
    """Where it was looked for, path and size of every file, in folders below too; names with ``_`` or ``.`` first are passed over."""
    for place in places:
        system, path = fs.FileSystem.from_uri(place)
        found = system.get_file_info(path)
        if found.type == fs.FileType.NotFound:
            raise FileNotFoundError(place)
        below = [found] if found.is_file else system.get_file_info(fs.FileSelector(path, recursive=True))
        for info in sorted((i for i in below if i.is_file), key=lambda i: i.path):
            inner = info.path[len(path):].strip("/").split("/")
            if found.is_file or not any(part[:1] in ("_", ".") for part in inner):
                yield place, info.path, info.size


def lines_between(source, first: int, last: int, block_bytes: int = BLOCK) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Beginnings and bytes of the lines that begin in ``first`` to ``last``, a block of the file at a time.

    A line begins at byte 0 or behind a line feed; the last line may lack its own. Memory holds a block and a line.
    """
    at = max(first - 1, 0)  # the byte before tells whether a line begins at ``first``
    source.seek(at)
    begun, held = first == 0, bytearray()
    while at < last:
        block = source.read(block_bytes)
        over = not block
        if not begun:
            end = block.find(b"\n") + 1
            if over:
                return
            if not end:
                at += len(block)
                continue
            begun, at, block = True, at + end, block[end:]
        whole = block.rfind(b"\n") + 1
        if whole or over:
            lines = bytes(held + block[:whole]).split(b"\n")
            if whole or not lines[-1]:
                lines.pop()
            if lines:
                begins = at + np.concatenate([[0], np.cumsum([len(x) + 1 for x in lines])])
                count = int(np.searchsorted(begins[:-1], last))
                yield begins[:count], lines[:count]
                at = int(begins[-1])
            held = bytearray(block[whole:])
        else:
            held += block
        if over:
            return


def _read(part: Range) -> Iterator[pa.RecordBatch]:
    system, _ = fs.FileSystem.from_uri(part.place)
    with system.open_input_file(part.path) as source:
        for begins, lines in lines_between(source, part.first, part.last):
            texts = [x.removesuffix(b"\r").decode("utf-8", "replace") for x in lines]
            yield pa.RecordBatch.from_arrays([pa.array([part.path] * len(texts), pa.string()), pa.array(begins, pa.int64()),
                                              pa.array(texts, pa.string())], names=["path", "pos", "line"])


def _whole(place: str, path: str, size: int, known: int) -> int:
    """The end of the last whole line of a file that is still growing; ``known`` was such an end before."""
    system, _ = fs.FileSystem.from_uri(place)
    with system.open_input_file(path) as source:
        end = size
        while end > known:
            begin = max(known, end - BLOCK)
            source.seek(begin)
            found = source.read(end - begin).rfind(b"\n") + 1
            if found:
                return begin + found
            end = begin
    return known


class _Places:
    def __init__(self, options):
        if "path" not in options and "paths" not in options:
            raise ValueError("log_lines needs the option path or paths")
        given = json.loads(options["paths"]) if "paths" in options else [options["path"]]
        self.options = options
        self.places = [place if "://" in place else os.path.abspath(place) for place in given]
        self.step = int(options.get("partition_bytes", PARTITION_BYTES))

    def ranges(self, place: str, path: str, first: int, last: int) -> list[Range]:
        return [Range(place, path, at, min(at + self.step, last)) for at in range(first, last, self.step)]


class LogReader(_Places, DataSourceReader):
    def partitions(self) -> list[Ranges]:
        parts = (part for place, path, size in _files(self.places) for part in self.ranges(place, path, 0, size))
        return list(_dealt(parts, int(self.options.get("task_bytes", self.step))))

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        for part in partition.parts:
            yield from _read(part)


class LogStream(_Places, DataSourceStreamReader):
    """Offsets are the bytes of each file that were read, always whole lines; a file may grow but not become shorter."""

    def __init__(self, options):
        super().__init__(options)
        self.known: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        for place, path, size in _files(self.places):
            known = self.known.get(path, 0)
            self.known[path] = _whole(place, path, size, known) if size > known else known
        return dict(self.known)

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for place, path, size in _files(self.places):
            if size < start.get(path, 0):
                raise ValueError(f"{path} became shorter: {size} bytes, of which {start[path]} were read")
            out += self.ranges(place, path, start.get(path, 0), end.get(path, 0))
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return _read(partition)


class LogLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "log_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LogReader:
        return LogReader(self.options)

    def streamReader(self, schema) -> LogStream:
        return LogStream(self.options)


def register(spark: SparkSession) -> None:
    ship_package(spark)
    spark.dataSource.register(LogLines)


def read_lines(spark: SparkSession, paths: str | Sequence[str], partition_bytes: int = PARTITION_BYTES,
               task_bytes: int | None = None) -> DataFrame:
    """Lines of text logs as ``path, pos, line``. The store has to be one that ``pyarrow.fs`` opens (local, HDFS, S3, GCS)."""
    register(spark)
    listed = [paths] if isinstance(paths, str) else list(paths)
    return spark.read.format("log_lines").option("paths", json.dumps(listed)).option("partition_bytes", partition_bytes).option(
        "task_bytes", task_bytes or partition_bytes).load()


def follow_lines(spark: SparkSession, paths: str | Sequence[str], partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """The stream of lines of logs that are being written; a line comes once its line feed is there."""
    register(spark)
    listed = [paths] if isinstance(paths, str) else list(paths)
    return spark.readStream.format("log_lines").option("paths", json.dumps(listed)).option("partition_bytes", partition_bytes).load()
