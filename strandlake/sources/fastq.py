"""FASTQ files of any size, split into byte ranges: a Python data source.

A range owns the records whose header follows a line end inside it; the first record of a file belongs to the first range. A line is a header if it
begins with @ and the next but one with +, which no quality line is, as a header and a sequence follow it. Files in blocked gzip are split at their blocks,
which are found by their own header; what a range owns is then told by the block in which the line end is. Other gzip files are read whole by one
task, as a stream. Paths must be in a store that pyarrow reads on driver and executors.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_READ = 1 << 18
_TASK = 64 << 20
_MAGIC = b"\x1f\x8b\x08\x04"
_SCHEMA = "source string, start bigint, header string, seq string, quality string"


def _open(path: str):
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        path = f"file://{path}"
    return fs.FileSystem.from_uri(path.replace("file:/", "file:///") if path.startswith("file:/") and not path.startswith("file://") else path)


@dataclass
class _Range(InputPartition):
    path: str
    begin: int
    end: int
    kind: str

    def __init__(self, path: str, begin: int, end: int, kind: str):
        self.path, self.begin, self.end, self.kind = path, begin, end, kind


def _block_size(data: bytes) -> int:
    """Of the gzip member that data begins with, by its BC field; 0 if it has none."""
    if len(data) < 18 or not data.startswith(_MAGIC):
        return 0
    extra, at = struct.unpack_from("<H", data, 10)[0], 12
    while at + 4 <= min(12 + extra, len(data)):
        name, size = data[at : at + 2], struct.unpack_from("<H", data, at + 2)[0]
        if name == b"BC" and size == 2 and at + 6 <= len(data):
            return struct.unpack_from("<H", data, at + 4)[0] + 1
        at += 4 + size
    return 0


def _blocks(file, begin: int) -> Iterator[tuple[int, bytes]]:
    """(offset, decompressed bytes) of the blocks from the first one that begins at ``begin`` or later. What looks like a block counts if its size leads to another, or to the end."""
    size = file.size()
    file.seek(begin)
    window, at = file.read(1 << 17), 0
    while begin:
        at = window.find(_MAGIC, at)
        if at < 0:
            return  # blocks are shorter than the window
        n = _block_size(window[at : at + 512])
        if n and (begin + at + n == size or _block_size(window[at + n : at + n + 512])):
            break
        at += 1
    offset = begin + at
    while offset < size:
        file.seek(offset)
        head = file.read(1 << 16)
        n = _block_size(head[:512])
        if not n:
            raise ValueError(f"no block at byte {offset}")
        yield offset, zlib.decompress(head[:n], 31)
        offset += n


def _pieces(part: _Range) -> Iterator[tuple[int, bytes]]:
    """(offset that tells who owns a line end, bytes); plain bytes have an offset each, those of a block its own."""
    fs, path = _open(part.path)
    if part.kind == "gzip":
        with fs.open_input_stream(path, compression=None) as stream:
            unpack = zlib.decompressobj(31)
            while data := stream.read(_READ):
                while data:
                    yield 0, unpack.decompress(data)
                    data = unpack.unused_data
                    if unpack.eof:
                        unpack = zlib.decompressobj(31)
        return
    with fs.open_input_file(path) as file:
        if part.kind == "blocks":
            yield from _blocks(file, part.begin)
            return
        file.seek(part.begin)
        at = part.begin
        # no further than the range at first, then in small steps, as the last record ends soon
        while data := file.read(min(_READ, part.end - at if at < part.end else 1 << 14)):
            yield at, data
            at += len(data)


def _lines(part: _Range) -> Iterator[tuple[int, int, bytes]]:
    """(owner offset of the line end before it, place, line); a range that does not begin its file leaves out what stands before its first line end."""
    rest, owner, place, known = b"", -1, 0, part.begin == 0
    for offset, data in _pieces(part):
        at = 0
        while (end := data.find(b"\n", at)) >= 0:
            if known:
                yield owner, place, (rest + data[at:end]).rstrip(b"\r")
            own = offset + end if part.kind == "plain" else offset
            rest, known, owner, at = b"", True, own, end + 1
            place = own + 1 if part.kind == "plain" else offset
        rest += data[at:] if known else b""
    if known and rest:
        yield owner, place, rest.rstrip(b"\r")


def records(part: _Range) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """(place, header, sequence, quality) of the records of a range. Blank lines between records are left out; a record that is cut off at the end is an error."""
    held: list[tuple[int, int, bytes]] = []
    synced = part.begin == 0
    for line in _lines(part):
        if not held and not line[2]:
            continue
        held.append(line)
        if not synced:
            if len(held) == 3 and not (held[0][2].startswith(b"@") and held[2][2].startswith(b"+")):
                held.pop(0)
                continue
            synced = len(held) == 3
        if len(held) == 1 and line[0] >= part.end:
            return
        if len(held) == 4:
            owner, place, head = held[0]
            if owner >= part.end:
                return
            if not head.startswith(b"@") or not held[2][2].startswith(b"+"):
                raise ValueError(f"no FASTQ record at byte {place} of {part.path}")
            yield place, head[1:], held[1][2], held[3][2]
            held = []
    if held and synced:
        raise ValueError(f"a record of {part.path} is cut off")


@dataclass
class _Task(InputPartition):
    """Ranges that one task reads one after the other."""

    ranges: list[_Range]

    def __init__(self, ranges: list[_Range]):
        self.ranges = ranges


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str], size: int, tasks: int = 0):
        self.paths, self.size, self.tasks = paths, size, tasks

    def partitions(self) -> list[InputPartition]:
        out = []
        for path in self.paths:
            fs, at = _open(path)
            with fs.open_input_file(at) as file:
                n, head = file.size(), file.read(512)
            kind = "blocks" if _block_size(head) else "gzip" if head.startswith(b"\x1f\x8b") else "plain"
            step = n if kind == "gzip" else self.size
            out += [_Range(path, b, min(n, b + step), kind) for b in range(0, n, max(1, step))]
        # small ranges share a task, up to _TASK bytes where that leaves work for all cores: a task costs more than a range
        if not self.tasks:
            return out or [_Range("", 0, 0, "none")]
        most = min(_TASK, -(-sum(r.end - r.begin for r in out) // self.tasks))
        tasks, held = [], _TASK
        for r in out:
            if held + r.end - r.begin > most:
                tasks.append(_Task([]))
                held = 0
            tasks[-1].ranges.append(r)
            held += r.end - r.begin
        return tasks or [_Task([])]

    def read(self, partition: _Range | _Task) -> Iterator[pa.RecordBatch]:
        ranges = partition.ranges if isinstance(partition, _Task) else [partition] if partition.kind != "none" else []
        rows, size = [], 0
        names = ["source", "start", "header", "seq", "quality"]
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i == 1 else pa.string()) for i, c in enumerate(zip(*rows))], names=names)
        for part in ranges:
            for place, *texts in records(part):
                rows.append((part.path, place, *(t.decode("utf-8", "replace") for t in texts)))
                size += len(texts[1])
                if size > 1 << 22 or len(rows) >= 8192:
                    yield batch()
                    rows, size = [], 0
        if rows:
            yield batch()


class FastqSource(DataSource):
    """Format ``fastq-ranges``; options: paths, one a line, bytes, the size of a range, and tasks, how many there should be at least where small ranges share a task (0: one a range)."""

    @classmethod
    def name(cls) -> str:
        return "fastq-ranges"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader([p for p in self.options.get("paths", "").split("\n") if p], int(self.options.get("bytes", 64 << 20)), int(self.options.get("tasks", 0)))


def read(spark: SparkSession, paths: list[str], size: int = 64 << 20) -> DataFrame:
    """(source, start, header, seq, quality) of FASTQ files, plain or compressed, in ranges of ``size`` bytes; start is the place of the record, in blocked gzip that of its block."""
    spark.dataSource.register(FastqSource)
    return spark.read.format("fastq-ranges").option("paths", "\n".join(paths)).option("bytes", size).option("tasks", 4 * spark.sparkContext.defaultParallelism).load()
