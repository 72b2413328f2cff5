"""Exact substring dedup of word windows behind a count-min prefilter.

First pass: every partition counts its windows in a sketch of two rows; the partitions' sketches are merged cell by cell, each
shard of cells by one task. An estimate never falls short of a window's count. Second pass: only windows estimated to occur
twice or more are grouped, exactly, by two hashes of 96 bits together; none is lost. The sketch follows the input up to `most_bits`, a
bound on what is sent to every worker; beyond it estimates grow and more windows are grouped, with the same result. A task
reports a window at most twice, so one that a third of all documents share makes no large group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .countmin import bits_for, counted_twice, sketch
from .scan import Table, mixed, runs_hash, word_hashes, word_slices
from .shared import broadcast_if_small, slices, small_batches, stored

#: Windows that a task remembers to report once, and words that are looked at together.
REMEMBERED, AT_ONCE = 2_000_000, 1 << 18


class Windows:
    """The windows of some texts: unit i is (its text's row, place of its first word in the text, word hashes)."""

    def __init__(self, units: list[tuple[int, int, np.ndarray]], width: int):
        self.words, sizes = np.concatenate([u[2] for u in units]), np.array([len(u[2]) for u in units])
        unit = np.repeat(np.arange(len(units)), sizes)
        first = np.cumsum(sizes) - sizes
        n = max(0, len(self.words) - width + 1)
        self.at = np.flatnonzero(unit[:n] == unit[width - 1 :])
        self.width, self.hashes, unit = width, runs_hash(self.words, width)[self.at], unit[self.at]
        self.row = np.array([u[0] for u in units])[unit]
        self.place = self.at - first[unit] + np.array([u[1] for u in units])[unit]

    def second(self, index: np.ndarray) -> np.ndarray:
        """31 further bits of the windows at these places in `at`."""
        return (runs_hash(self.words, self.width, 1)[self.at[index]] >> np.uint64(33)).astype(np.int32)


def windows(texts: pa.Array, width: int) -> Iterator[Windows]:
    """All windows of a batch of texts, about AT_ONCE at a time; a longer text comes in parts that overlap by width - 1 words."""
    units, size = [], 0
    for row, text in enumerate(texts.to_pylist()):
        words = word_hashes((text or "").encode())
        for at in range(0, max(1, len(words) - width + 1), AT_ONCE):
            part = words[at : at + AT_ONCE + width - 1]
            units.append((row, at, part))
            size += len(part)
            if size >= AT_ONCE:
                yield Windows(units, width)
                units, size = [], 0
    if units:
        yield Windows(units, width)


def _reports(texts: DataFrame, width: int, bits: int, merged) -> DataFrame:
    """(h1, h2, n, doc_id, digest, place, length): n counts occurrences of a window; rows with a length cover so many windows from place."""
    kinds = {"h1": pa.int64(), "h2": pa.int32(), "n": pa.int32(), "doc_id": pa.int64(), "digest": pa.int64(), "place": pa.int32(), "length": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeated = merged.value
        seen, second, told = Table(), np.zeros(0, np.int32), np.zeros(0, bool)
        for b in slices(batches):
            ids, digests = b.column(0).to_numpy(), b.column(1).to_numpy()
            for w in windows(b.column(2), width):
                index = counted_twice(w.hashes, repeated, bits)
                if not len(index):
                    continue
                if seen.size > REMEMBERED:
                    seen, second, told = Table(), second[:0], told[:0]
                h1, h2 = np.maximum(w.hashes[index], np.uint64(1)), w.second(index)
                key, first, group, count = np.unique(h1, return_index=True, return_inverse=True, return_counts=True)
                known = seen.find(key)
                fits = (known < 0) | (np.r_[second, np.int32(0)][known] == h2[first])
                local = (h2 == h2[first][group]) & fits[group] & ((count > 1) | (known >= 0))[group]  # seen twice by this task: covered for certain
                again, twice = fits & (known >= 0) & ~np.r_[told, True][known], (known < 0) & (count > 1)
                told[known[again]] = True
                fresh = known < 0
                seen.add(key[fresh])
                second, told = np.r_[second, h2[first][fresh]], np.r_[told, (count > 1)[fresh]]
                alone, spread = np.flatnonzero(~local), np.flatnonzero(local)
                starts = np.r_[True, np.diff(w.at[index[spread]]) != 1] if len(spread) else np.zeros(0, bool)  # runs of adjacent windows
                lengths = np.diff(np.r_[np.flatnonzero(starts), len(spread)]) if len(spread) else np.zeros(0, np.int64)
                spread = spread[starts]
                of = lambda i: (ids[w.row[index[i]]], digests[w.row[index[i]]], w.place[index[i]])  # noqa: E731, B023
                none, ones = np.zeros(int(again.sum() + twice.sum()), np.int64), np.ones
                columns = (
                    np.r_[h1[alone], key[again], key[twice], mixed(h1[spread] + w.place[index[spread]].astype(np.uint64))].view(np.int64),
                    np.r_[h2[alone], h2[first][again], h2[first][twice], np.full(len(spread), -1)],
                    np.r_[ones(len(alone)), ones(again.sum()), 2 * ones(twice.sum()), 2 * ones(len(spread))],
                    *(np.r_[x, none, y] for x, y in zip(of(alone), of(spread), strict=True)), np.r_[ones(len(alone)), none, lengths],
                )
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(t.to_pandas_dtype())) for c, t in zip(columns, kinds.values(), strict=True)], list(kinds))

    return texts.mapInArrow(run, "h1 long, h2 int, n int, doc_id long, digest long, place int, length int")


def _removal(width: int):
    """From batches of (doc_id, text, places, lengths) to doc_id, numbers of words and the text without the covered ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = []
            for doc, text, places, lengths in zip(*(c.to_pylist() for c in b.columns[:2]), b.column(2), b.column(3), strict=True):
                data, n, kept, gone = (text or "").encode(), 0, [], None
                if places.is_valid:
                    at, to = places.values.to_numpy(), places.values.to_numpy() + lengths.values.to_numpy() + width - 1
                    gone = np.cumsum(np.bincount(at, minlength=to.max() + 1) - np.bincount(to, minlength=to.max() + 1)) > 0
                for words in map(bytes.split, word_slices(data)):
                    drop = np.zeros(len(words), bool)
                    if gone is not None:
                        part = gone[n : n + len(words)]
                        drop[: len(part)] = part
                    kept += [b" ".join([w for w, g in zip(words, drop.tolist(), strict=True) if not g])] if not drop.all() else []
                    n += len(words)
                rows.append((doc, n, 0 if gone is None else int(gone.sum()), b" ".join(kept).decode()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["doc_id", "n_words", "n_removed", "kept_text"])

    return run


def drop_repeats(docs: DataFrame, width: int = 35, most_bits: int = 30) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text): words covered by a window of `width` words that also starts elsewhere go.

    docs(doc_id, text): words are runs without ASCII white space. Null, empty and shorter texts lose nothing; rows without
    doc_id are left out; a repeated row is a repeat of all its windows, and rows of one doc_id with other texts are texts of
    their own; texts of any length are read a part at a time; an empty table gives an empty result. kept_text joins the kept
    words by one space.
    """
    spark = docs.sparkSession
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    again = stored(texts.groupBy("doc_id").count().where("count > 1").select("doc_id", F.lit(True).alias("again")), "again")
    digest = F.when(F.col("again"), F.xxhash64("text")).otherwise(0)  # where doc_id alone doesn't tell rows apart
    texts = texts.join(broadcast_if_small(again), "doc_id", "left").select("doc_id", digest.alias("digest"), "text")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    with small_batches(spark):
        bits = bits_for(size / 6.5, most_bits)
        merged = spark.sparkContext.broadcast(sketch(texts, lambda b: (w.hashes for w in windows(b.column(2), width)), bits))
        reports = _reports(texts, width, bits, merged)
        total = F.sum("n").over(Window.partitionBy("h1", "h2"))
        covered = reports.withColumn("total", total).where("total > 1 and length > 0").groupBy("doc_id", "digest").agg(F.collect_list(F.struct("place", "length")).alias("runs"))
        covered = stored(covered.select("doc_id", "digest", F.col("runs.place").alias("places"), F.col("runs.length").alias("lengths")), "covered")
        merged.destroy()
    keys = broadcast_if_small(covered.select("doc_id", "digest"))  # texts that lose nothing aren't shuffled
    hit = texts.join(keys, ["doc_id", "digest"], "left_semi").join(covered, ["doc_id", "digest"]).select("doc_id", "text", "places", "lengths")
    rest = texts.join(keys, ["doc_id", "digest"], "left_anti").select("doc_id", "text", F.lit(None).cast("array<int>").alias("places"), F.lit(None).cast("array<int>").alias("lengths"))
    out = "doc_id long, n_words long, n_removed long, kept_text string"
    return hit.mapInArrow(_removal(width), out).union(rest.mapInArrow(_removal(width), out))
