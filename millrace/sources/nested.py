"""Large JSON files of one object {key: value, ...}, read by many tasks: the Python data source `json_entries`.

A file is looked at in blocks of bytes. What a block does to the reader's state - within a string or not, how deep in braces - is
worked out for either start by a task of its own; strung together, these few numbers give the state at each block's start. Then
every block's task reads the entries that begin in it, the last one beyond the block's end. No task reads a whole file, and the driver
sees a row for each block.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BLOCK = 32 << 20
#: Bytes that are scanned at once, and texts that go to Spark at once.
SCANNED, SENT = 1 << 20, 4 << 20
_QUOTE, _BACKSLASH, _COMMA, _OPEN, _CLOSE = (ord(c) for c in '"\\,{}')
_STEP = np.zeros(256, np.int64)
_STEP[[_OPEN, ord("[")]], _STEP[[_CLOSE, ord("]")]] = 1, -1


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else f"file:{path}")


def _escaped_before(f: pa.NativeFile, at: int) -> bool:
    """Whether the byte at this place is escaped: an odd number of backslashes stands before it."""
    n = 0
    while at - n > 0:
        size = min(64, at - n)
        part = f.read_at(size, at - n - size)
        here = len(part) - len(part.rstrip(b"\\"))
        n += here
        if here < size:
            break
    return n % 2 == 1


class Scan:
    """Reads bytes in order and tells strings from what is outside; valid JSON has backslashes in strings only."""

    def __init__(self, inside: bool, escaped: bool = False, depth: int = 0):
        self.inside, self.escaped, self.depth = inside, escaped, depth

    def step(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, places outside of strings that open, close or are commas, depth after each)."""
        b = np.frombuffer(data, np.uint8)
        quotes = np.flatnonzero(b == _QUOTE)
        slashes = np.flatnonzero(b == _BACKSLASH)
        if len(slashes) or self.escaped:
            starts = slashes[np.r_[True, np.diff(slashes) != 1]] if len(slashes) else slashes
            run = np.zeros(len(b) + 1, bool)  # escaped: after an odd number of backslashes
            lengths = np.diff(np.r_[np.searchsorted(slashes, starts), len(slashes)])
            odd = lengths % 2 == 1
            if self.escaped and len(starts) and starts[0] == 0:
                odd[0] = ~odd[0]
            elif self.escaped:
                run[0] = True
            run[(starts + lengths)[odd]] = True
            quotes = quotes[~run[quotes]]
            self.escaped = bool(run[len(b)])
        marks = np.flatnonzero((_STEP[b] != 0) | (b == _COMMA))
        marks = marks[(np.searchsorted(quotes, marks) + self.inside) % 2 == 0]
        depths = self.depth + np.cumsum(_STEP[b[marks]])
        self.inside = bool((self.inside + len(quotes)) % 2)
        self.depth = int(depths[-1]) if len(depths) else self.depth
        return b, marks, depths


def _summary(path: str, at: int, size: int) -> tuple[bool, int, int]:
    """(whether a block has an odd number of quotes, change of depth if it begins outside of a string, and inside)."""
    store, name = _open(path)
    with store.open_input_file(name) as f:
        escaped = _escaped_before(f, at)
        scans, done = [Scan(False, escaped), Scan(True, escaped)], 0
        while done < size:
            data = f.read_at(min(SCANNED, size - done), at + done)
            if not data:
                break
            done += len(data)
            for s in scans:
                s.step(data)
        return scans[0].inside, scans[0].depth, scans[1].depth


@dataclass
class Block(InputPartition):
    path: str
    at: int
    size: int
    inside: bool
    depth: int

    def entries(self) -> Iterator[tuple[int, bytes]]:
        """(place, text) of the entries of the outer object whose separator - its brace or a comma - is in this block."""
        store, name = _open(self.path)
        with store.open_input_file(name) as f:
            scan, done, open_, parts = Scan(self.inside, _escaped_before(f, self.at), self.depth), 0, None, []
            while done < self.size or open_ is not None:
                data = f.read_at(SCANNED if done >= self.size else min(SCANNED, self.size - done), self.at + done)
                if not data:
                    raise ValueError(f"{self.path} is not JSON: it ends within its object")
                before = scan.depth
                b, marks, depths = scan.step(data)
                kind = b[marks]
                was = np.r_[before, depths[:-1]]
                cuts = ((kind == _COMMA) & (depths == 1)) | ((kind == _OPEN) & (was == 0)) | ((kind == _CLOSE) & (depths == 0))
                begin = 0
                for at, k in zip(marks[cuts].tolist(), kind[cuts].tolist(), strict=True):
                    if open_ is not None:
                        parts.append(data[begin:at])
                        yield open_, b"".join(parts)
                        open_, parts = None, []
                    if k != _CLOSE and done + at < self.size:
                        open_, begin = self.at + done + at, at + 1
                    elif done + at >= self.size:
                        return
                if open_ is not None:
                    parts.append(data[begin:])
                done += len(data)


class _Reader(DataSourceReader):
    def __init__(self, blocks: list[list]):
        self.blocks = blocks

    def partitions(self) -> list[InputPartition]:
        return [Block(*b) for b in self.blocks]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.string(), pa.string()), strict=True)], ["path", "at", "key", "value"])

        for at, data in partition.entries():
            text = data.decode().strip()
            if not text:
                continue
            key, end = json.JSONDecoder().raw_decode(text)
            rest = text[end:].lstrip()
            if not isinstance(key, str) or not rest.startswith(":"):
                raise ValueError(f"{partition.path} is not JSON at byte {at}")
            rows.append((partition.path, at, key, rest[1:].strip()))
            size += len(text)
            if size > SENT:
                yield out()
                rows, size = [], 0
        if rows:
            yield out()


class JsonEntries(DataSource):
    """Format `json_entries` with option `blocks`, as block_states() gives them: a row for each entry of each file's outer object."""

    @classmethod
    def name(cls) -> str:
        return "json_entries"

    def schema(self) -> str:
        return "path string, at long, key string, value string"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(json.loads(self.options["blocks"]))


def _files(path: str) -> list[tuple[str, int]]:
    """(URI, bytes) of a file, or of all files below a folder but hidden ones."""
    store, name = _open(path)
    info = store.get_file_info(name)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    root = path.rstrip("/")
    below = [i for i in store.get_file_info(fs.FileSelector(name, recursive=True, allow_not_found=True)) if i.type == fs.FileType.File and not i.base_name.startswith((".", "_"))]
    return sorted((f"{root}{i.path.removeprefix(name.rstrip('/'))}", i.size) for i in below)


def _first_byte(path: str, size: int) -> bytes:
    store, name = _open(path)
    with store.open_input_file(name) as f:
        at = 0
        while at < size:
            part = f.read_at(4096, at).lstrip(b" \t\r\n")
            if part:
                return part[:1]
            at += 4096
    return b""


def block_states(spark: SparkSession, path: str, block: int = BLOCK) -> list[list]:
    """[path, at, size, inside a string, depth] of each block of the files that hold an object; an error for a file that holds no JSON."""
    there = _files(path)
    kinds = {p: _first_byte(p, n) for p, n in there}
    others = [p for p in kinds if kinds[p] != b"{"]
    for p in others:
        if spark.read.text(p, wholetext=True).where(F.try_parse_json("value").isNull()).limit(1).count() or not kinds[p]:
            raise ValueError(f"{p} is not JSON")
    blocks = [(p, at, min(block, n - at)) for p, n in there if p not in others for at in range(0, n, block)]
    if not blocks:
        return []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(k, *_summary(*blocks[k])) for k in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True) if found else [[]] * 4, (pa.int64(), pa.bool_(), pa.int64(), pa.int64()), strict=True)], ["k", "odd", "out", "within"])

    rows = spark.range(0, len(blocks), 1, min(len(blocks), 4096)).mapInArrow(run, "k long, odd boolean, out long, within long").collect()  # a row a block
    states, inside, depth, last = [], False, 0, None
    for k, odd, out, within in sorted(tuple(r) for r in rows):
        name = blocks[k][0]
        if name != last and (inside or depth):
            raise ValueError(f"{last} is not JSON: it ends within its object")
        last = name
        states.append([*blocks[k], inside, depth])
        depth += within if inside else out
        inside ^= odd
    if inside or depth:
        raise ValueError(f"{last} is not JSON: it ends within its object")
    return states


def json_entries(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """(key, value) of the outer object of a JSON file, or of each file below a folder: value is the entry's JSON text.

    Of a key that one file repeats the last entry counts. A file of another JSON value has no rows; one that isn't JSON is an error, at
    once if its strings or braces don't end, else when the entry is read. An entry is held whole by a task. path is a
    URI or an absolute path that driver and executors reach.
    """
    spark.dataSource.register(JsonEntries)
    rows = spark.read.format("json_entries").option("blocks", json.dumps(block_states(spark, path, block))).load()
    whole = F.when(F.try_parse_json("value").isNull(), F.raise_error(F.concat(F.col("path"), F.lit(" is not JSON at byte "), F.col("at")))).otherwise(F.col("value"))
    return rows.groupBy("path", "key").agg(F.max_by(whole, "at").alias("value")).select("key", "value")
