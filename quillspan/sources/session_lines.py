"""The data source `session_lines`: text files of sessions by byte blocks, for spark.read.format().

A file of any length is cut into blocks of bytes, a block a task at most, and a task holds a chunk and the line it is in.
A line belongs to the block in which its first byte lies. Its number in the file follows from the lines of the blocks
before, which only files of several blocks need: `numbered` counts them in a pass of its own and adds up the counts.

Tables (option `table`): `lines` (file, block, nth, byte_start, value), `blocks` (file, block, n_lines; files of several
blocks only), `listing` (file, size_bytes, modified) and `files` (listing with content_hash, the SHA-256 of the raw bytes,
read as a stream). Other options: `glob` of names, `blockbytes`, `first` (only each file's first so many lines that aren't
blank, and blank ones before them), and `paths`, a JSON list of files instead of a folder. Lines end with \n, \r\n or \r, as in
Python's text files; bytes that aren't UTF-8 become replacement characters. Files are read by pyarrow's file systems: local
ones, and those that it knows by their scheme.
"""

from __future__ import annotations

import fnmatch
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.window import Window as W

FORMAT = "session_lines"
BLOCK_BYTES = 32 << 20
CHUNK = 4 << 20
SCHEMAS = {
    "lines": "file string, block long, nth long, byte_start long, value string",
    "blocks": "file string, block long, n_lines long",
    "listing": "file string, size_bytes long, modified timestamp",
    "files": "file string, size_bytes long, modified timestamp, content_hash string",
}


def opened(uri: str) -> tuple[fs.FileSystem, str, str]:
    """(file system, prefix of its names, path in it) of a local path or a URI."""
    if re.match(r"^(file:|/)", uri):
        return fs.LocalFileSystem(), "file://", "/" + re.sub(r"^(file:)?/+", "", uri)
    system, inner = fs.FileSystem.from_uri(uri)
    return system, uri[: len(uri) - len(inner)] if uri.endswith(inner) else "", inner


def line_starts(before: int, data: bytes) -> np.ndarray:
    """Where lines start in data; `before` is the byte in front of it, -1 at the start of a file."""
    b = np.frombuffer(data, np.uint8)
    prior = np.empty(len(b), np.int16)
    prior[0], prior[1:] = before, b[:-1]
    return np.flatnonzero((prior == -1) | (prior == 10) | ((prior == 13) & (b != 10)))


def _chunks(stream, start: int, end: int) -> Iterator[tuple[int, bytes, np.ndarray]]:
    """(place, bytes, starts of lines in them) of the bytes from start to end."""
    before = -1
    if start:
        stream.seek(start - 1)
        before = stream.read(1)[0]
    else:
        stream.seek(0)
    while start < end and (data := stream.read(min(CHUNK, end - start))):
        yield start, data, line_starts(before, data)
        before, start = data[-1], start + len(data)


def block_lines(stream, start: int, end: int, size: int) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """(places, raw lines with their ends) of the lines that start in a block, some at a time."""
    open_line: list[bytes] = []
    opened_at = 0
    for at, data, starts in _chunks(stream, start, end):
        if not len(starts):
            if open_line:
                open_line.append(data)
            continue
        whole = pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int32)), pa.py_buffer(data)])
        places = at + starts[:-1]
        if open_line:
            whole = pa.concat_arrays([pa.array([b"".join([*open_line, data[: starts[0]]])], pa.binary()), whole])
            places = np.concatenate([[opened_at], places])
        if len(whole):
            yield places, whole
        open_line, opened_at = [data[starts[-1] :]], at + int(starts[-1])
    if open_line:
        for _, data, starts in _chunks(stream, end, size):
            open_line.append(data[: starts[0]] if len(starts) else data)
            if len(starts):
                break
        yield np.array([opened_at]), pa.array([b"".join(open_line)], pa.binary())


def as_text(lines: pa.Array) -> pa.Array:
    try:
        text = lines.cast(pa.string())
    except pa.ArrowInvalid:
        text = pa.array([x.decode("utf-8", "replace") for x in lines.to_pylist()], pa.string())
    return pc.ascii_rtrim(text, characters="\r\n")


class Blocks(InputPartition):
    """Blocks (path, start, end, size, modified) of one task."""

    def __init__(self, blocks: list[tuple]):
        self.blocks = blocks


class SessionLinesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.table = options.get("table", "lines")
        self.uri, self.paths = options.get("path"), options.get("paths")
        self.glob, self.first = options.get("glob", "*.jsonl"), int(options.get("first", "0"))
        self.block_bytes = int(options.get("blockbytes", str(BLOCK_BYTES)))
        if self.table not in SCHEMAS or self.block_bytes < 1 or not (self.uri or self.paths):
            raise ValueError(f"{FORMAT} needs a path or paths, a table of {sorted(SCHEMAS)} and positive blockbytes")

    def _listed(self) -> list[fs.FileInfo]:
        if self.paths:
            names = json.loads(self.paths)
            by_system: dict[str, list[str]] = {}
            for name in names:
                by_system.setdefault(opened(name)[1], []).append(name)
            found = []
            for prefix, group in by_system.items():
                system = opened(group[0])[0]
                found += [(prefix, x) for x in system.get_file_info([opened(n)[2] for n in group])]
        else:
            system, prefix, inner = opened(self.uri)
            at = system.get_file_info(inner)
            if at.type == fs.FileType.NotFound:
                raise FileNotFoundError(self.uri)
            infos = [at] if at.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inner, recursive=True))
            found = [(prefix, x) for x in infos if fnmatch.fnmatchcase(x.base_name, self.glob)]
        # Names that start with _ or . are other writers' marks, as for Spark's own readers.
        return sorted(((prefix + x.path, x) for prefix, x in found if x.type == fs.FileType.File and x.base_name[0] not in "_."), key=lambda p: p[0])

    def partitions(self) -> list[Blocks]:
        by_block = self.table in ("lines", "blocks") and not self.first
        tasks: list[list[tuple]] = [[]]
        room = self.block_bytes
        for name, info in self._listed():
            size, stamp = info.size, info.mtime
            if self.table == "blocks" and size <= self.block_bytes:
                continue
            step = self.block_bytes if by_block else max(size, 1)
            for start in range(0, max(size, 1), step):
                end = min(start + step, size)
                # A listing or a look costs its opening, so small things share a task by number too.
                weight = max(end - start if not self.first else 0, self.block_bytes // 256)
                if room < weight and tasks[-1]:
                    tasks.append([])
                    room = self.block_bytes
                tasks[-1].append((name, start, end, size, stamp))
                room -= weight
        return [Blocks(t) for t in tasks]

    def read(self, partition: Blocks) -> Iterator[pa.RecordBatch]:
        for name, start, end, size, stamp in partition.blocks:
            if self.table == "listing":
                yield self._row([name, size, stamp], ["file", "size_bytes", "modified"])
                continue
            system, _, inner = opened(name)
            with system.open_input_file(inner) as stream:
                if self.table == "files":
                    digest = hashlib.sha256()
                    while piece := stream.read(1 << 20):
                        digest.update(piece)
                    yield self._row([name, size, stamp, digest.hexdigest()], ["file", "size_bytes", "modified", "content_hash"])
                elif self.table == "blocks":
                    yield self._row([name, start, sum(len(s) for _, _, s in _chunks(stream, start, end))], ["file", "block", "n_lines"])
                else:
                    yield from self._lines(stream, name, start, end, size)

    def _lines(self, stream, name: str, start: int, end: int, size: int) -> Iterator[pa.RecordBatch]:
        nth, left = 0, self.first
        for places, raw in block_lines(stream, start, end, size):
            text, n = as_text(raw), len(raw)
            if self.first:
                told = np.cumsum(pc.match_substring_regex(text, r"\S").to_numpy(zero_copy_only=False))
                n = min(n, int(np.searchsorted(told, left)) + 1)
                left -= int(told[n - 1])
            columns = [pa.array([name] * n, pa.string()), pa.array(np.full(n, start)), pa.array(np.arange(nth, nth + n)), pa.array(places[:n]), text.slice(0, n)]
            yield pa.RecordBatch.from_arrays(columns, names=["file", "block", "nth", "byte_start", "value"])
            nth += n
            if self.first and left <= 0:
                return

    @staticmethod
    def _row(values: list, names: list[str]) -> pa.RecordBatch:
        kinds = {"modified": pa.timestamp("us", "UTC")}
        return pa.RecordBatch.from_arrays([pa.array([v], kinds.get(n)) for n, v in zip(names, values)], names=names)


class SessionLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMAS[self.options.get("table", "lines")]

    def reader(self, schema) -> SessionLinesReader:
        return SessionLinesReader(dict(self.options))


def read(spark: SparkSession, path: str | None = None, table: str = "lines", **options) -> DataFrame:
    """One of the source's tables; the source is registered with the session."""
    spark.dataSource.register(SessionLines)
    reader = spark.read.format(FORMAT).options(table=table, **options)
    return reader.load(path) if path else reader.load()


def numbered(spark: SparkSession, path: str | None = None, **options) -> DataFrame:
    """(file, line, byte_start, value): lines count from 1 in their file, blank ones too.

    Blocks' counts are added up in a window over blocks, not lines, and the few sums are joined to lines by file and block.
    """
    counts = read(spark, path, "blocks", **options)
    before = F.sum("n_lines").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    offsets = counts.withColumn("before", before).where("block > 0").select("file", "block", "before")
    lines = read(spark, path, **options).join(offsets, ["file", "block"], "left")
    return lines.select("file", (F.coalesce("before", F.lit(0)) + F.col("nth") + 1).cast("int").alias("line"), "byte_start", "value")
