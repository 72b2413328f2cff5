"""A count-min sketch over hashes in a distributed table: partition sketches, merged cell by cell.

All that is kept of a cell is whether it was counted twice or more, so a hash that is said to be single is so for certain.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .scan import mixed
from .shared import slices

ROWS = 2
SHARD_BITS = 20
#: Cells that are sorted at once.
HELD = 1 << 21


def _cells(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (mixed(hashes + np.uint64(row + 1)) >> np.uint64(64 - bits)).astype(np.int64) + (row << bits)


def _coded(cells: np.ndarray, twice: np.ndarray) -> bytes:
    """Ascending cells of one shard and whether each was counted twice: gaps as Rice codes - high parts unary, low bits, flags, one after the other."""
    gaps = np.diff(cells, prepend=cells[0] >> SHARD_BITS << SHARD_BITS)
    k = max(0, int(math.log2(0.69 * (1 << SHARD_BITS) / len(cells))))
    unary = np.zeros(int((gaps >> k).sum()) + len(cells), np.uint8)
    unary[np.cumsum((gaps >> k) + 1) - 1] = 1
    low = (gaps[:, None] >> np.arange(k) & 1).astype(np.uint8)
    return np.array([len(cells), k, len(unary)], "<u4").tobytes() + b"".join(np.packbits(x).tobytes() for x in (unary, low.ravel(), twice))


def _decoded(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, k, unary = np.frombuffer(data, "<u4", 3).tolist()
    sizes = [-(-x // 8) for x in (unary, n * k, n)]
    at = np.cumsum([12, *sizes])
    high, low, twice = (np.unpackbits(np.frombuffer(data, np.uint8, size, a), count=x) for a, size, x in zip(at, sizes, (unary, n * k, n), strict=False))
    gaps = (np.diff(np.flatnonzero(high), prepend=-1) - 1 << k) + low.reshape(n, k).astype(np.int64) @ (1 << np.arange(k))
    return np.cumsum(gaps), twice.astype(bool)


def sketch(table: DataFrame, hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int, at_once: int = HELD) -> np.ndarray:
    """A bit for each of ROWS * 2**bits cells: counted twice or more. hashes gives those of a batch of the table's rows; a task sorts some `at_once` cells at a time."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            cells = np.sort(np.concatenate(held))
            new = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
            twice = np.diff(np.r_[new, len(cells)]) > 1
            cells = cells[new]
            cuts = np.flatnonzero(np.r_[True, (cells[1:] >> SHARD_BITS) != (cells[:-1] >> SHARD_BITS)])
            blobs = [_coded(cells[a:b], twice[a:b]) for a, b in zip(cuts, np.r_[cuts[1:], len(cells)], strict=True)]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array((cells[cuts] >> SHARD_BITS).astype(np.int32)), pa.array(blobs, pa.binary())], ["shard", "cells"])

        for b in slices(batches):
            for h in hashes(b):
                if len(h):
                    held.extend(_cells(h, row, bits) for row in range(ROWS))
                if sum(map(len, held)) > at_once:
                    yield out()
        if held:
            yield out()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, there = None, np.zeros(0, np.uint8)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([np.packbits(there > 1, bitorder="little").tobytes()], pa.binary())], ["shard", "bits"])

        for b in batches:  # in order of shard
            for new, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if new != shard:
                    if shard is not None:
                        yield out()
                    shard, there = new, np.zeros(1 << SHARD_BITS, np.uint8)
                cells, twice = _decoded(data)
                there[cells] = np.minimum(there[cells] + twice + np.uint8(1), 2)
        if shard is not None:
            yield out()

    shards = ROWS << (bits - SHARD_BITS)
    tasks = min(shards, int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    merged = table.mapInArrow(count, "shard int, cells binary").repartition(tasks, "shard").sortWithinPartitions("shard").mapInArrow(merge, "shard int, bits binary")
    out = np.zeros((shards << SHARD_BITS) // 8, np.uint8)
    size = (1 << SHARD_BITS) // 8
    for r in merged.toLocalIterator():  # ROWS * 2**bits bits at most, one part at a time
        out[r["shard"] * size : (r["shard"] + 1) * size] = np.frombuffer(r["bits"], np.uint8)
    return out


def bits_for(expected: float, most_bits: int) -> int:
    """Four cells a row for each hash expected, between one shard and the bound on what workers hold."""
    return min(most_bits, max(SHARD_BITS, math.ceil(math.log2(1 + 4 * expected))))


def counted_twice(hashes: np.ndarray, merged: np.ndarray, bits: int) -> np.ndarray:
    """Indices of the hashes that the merged sketch estimates to occur twice or more."""
    index = np.arange(len(hashes))
    for row in range(ROWS):
        cells = _cells(hashes[index], row, bits)
        index = index[(merged[cells >> 3] >> (cells & 7).astype(np.uint8)) & 1 == 1]
    return index
