"""Phrase collocations by direct-address tiling.

Words that are frequent enough get ids by falling frequency, language by language. Pairs of ids are counted in tiles: bands of
ids that double in width, so that each band has about equal shares of all words. Where a tile is small enough, its cells are addressed
directly and counted by bincount; in larger, sparse tiles pairs are kept as sorted coordinates with counts. A task counts
before the shuffle and sends a row for each tile; a tile's rows are merged one after the other. Frequent pairs then get ids by
falling frequency themselves, and triples are counted as pairs of such a pair and a word, in the same way.

Workers hold the ids of the `listed` most frequent words or pairs. Should there be more frequent ones, the rest go by their hashes, in
tiles of sorted coordinates: more is counted then, and nothing lost.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import Table, mixed, word_hashes
from .shared import new_path, slices, small_batches, stored



@dataclass(frozen=True)
class Tiles:
    """Ids in the first band; cells of a tile that are addressed directly; pairs that a task counts at once; pairs of a tile's part; parts that a tile is cut into by one shuffle."""

    band: int = 1024
    cells: int = 1 << 22
    held: int = 1 << 20
    part: int = 1 << 20
    fan: int = 64

    def start(self, band: int) -> int:
        """First id of a band."""
        return self.band << (band - 1) if band else 0

    def width(self, band: int) -> int:
        """Ids of a band."""
        return self.band << max(0, band - 1)


#: Ids of words that workers don't hold.
TAIL = 1 << 62
_END = re.compile(rb"[.,;:!?\x0A-\x0D]")
_PLAIN = bytes.maketrans(b".,;:!?\x0B\x0C\x0D\x09", b"\n" * 9 + b" ")
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _chunks(batch: pa.RecordBatch, at_once: int = 1 << 20) -> Iterator[tuple[str, bytes]]:
    """(lang, data) of rows (lang, text): texts of one language together, lower-cased, words parted by blanks and pieces by LF; cut between pieces only."""
    held: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        data, at = (text or "").encode().lower(), 0  # bytes: A-Z only
        while at < len(data):
            cut = _END.search(data, at + at_once) if len(data) - at > at_once else None
            to = cut.end() if cut else len(data)
            held.setdefault(lang, []).append(data[at:to])
            sizes[lang] = sizes.get(lang, 0) + to - at
            at = to
            if sizes[lang] >= at_once:
                yield lang, b"\n".join(held.pop(lang)).translate(_PLAIN)
                sizes[lang] = 0
    for lang, parts in held.items():
        yield lang, b"\n".join(parts).translate(_PLAIN)


def _seed(lang: str) -> int:
    return xxhash.xxh3_64_intdigest(lang.encode())


def _follows(data: bytes) -> np.ndarray:
    """For each word but the last whether the next one is in the same piece."""
    letters = np.frombuffer(data, np.uint8)
    gap = (letters == 32) | (letters == 10)
    starts = np.flatnonzero(~gap & np.r_[True, gap[:-1]])
    piece = np.cumsum(letters == 10, dtype=np.int32)[starts]
    return piece[1:] == piece[:-1]


def _vocabulary(texts: DataFrame, held: int) -> DataFrame:
    """(lang, word, h, f) of texts(lang, text): occurrences of each word; of a null word: of all words."""
    fields = [("lang", pa.string()), ("word", pa.string()), ("h", pa.int64()), ("f", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, langs, words, hashes, counts, totals = Table(), [], [], [], np.zeros(1 << 16, np.int64), {}

        def out() -> pa.RecordBatch:
            columns = [*langs, *totals], [*words, *[None] * len(totals)], np.r_[np.concatenate(hashes or [np.zeros(0, np.uint64)]).view(np.int64), np.zeros(len(totals), np.int64)], np.r_[counts[: len(words)], np.array([*totals.values()], np.int64)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])

        for b in slices(batches):
            for lang, data in _chunks(b):
                found = data.split()
                h = word_hashes(data, _seed(lang))
                totals[lang] = totals.get(lang, 0) + len(h)
                key, first, n = np.unique(h, return_index=True, return_counts=True)
                at = known.find(key)
                new = at < 0
                if new.any():
                    known.add(key[new])
                    at[new] = np.arange(len(words), len(words) + int(new.sum()))
                    words += [found[i].decode() for i in first[new].tolist()]
                    langs += [lang] * int(new.sum())
                    hashes.append(key[new])
                    if len(words) > len(counts):
                        counts = np.r_[counts, np.zeros(max(len(counts), len(words) - len(counts)), np.int64)]
                counts[at] += n
                if len(words) > held // 2:
                    yield out()
                    known, langs, words, hashes, counts, totals = Table(), [], [], [], np.zeros(1 << 16, np.int64), {}
        yield out()

    return texts.mapInArrow(run, "lang string, word string, h long, f long").groupBy("lang", "word", "h").agg(F.sum("f").alias("f"))


def _ranked(rows: DataFrame, by: str, ties: list[str], name: str) -> DataFrame:
    """rows with `rank`, from 0 by falling `by` in each lang: sorted in ranges, and numbered by the sizes of the ranges before."""
    order = ["lang", F.desc(by), *ties]
    path = new_path(rows.sparkSession, name)
    rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()).write.parquet(path)
    rows = rows.sparkSession.read.parquet(path).withColumn("part", F.shiftright("at", 33))
    parts = rows.groupBy("lang", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))  # a row for each range
    before = F.coalesce(F.sum("n").over(Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("lang", "part", (before - F.col("first")).alias("shift"))
    return stored(rows.join(F.broadcast(parts), ["lang", "part"]).withColumn("rank", F.col("at") + F.col("shift")).drop("at", "part", "shift"), name)


class _Ids:
    """Ids of the listed words or pairs: their ranks, found by 64-bit keys. In a worker's memory."""

    def __init__(self, keys: np.ndarray, ranks: np.ndarray, complete: bool):
        self.table, self.ranks, self.complete = Table(max(16, int(2 * len(keys) + 2).bit_length())), np.r_[ranks, np.int64(-1)], complete
        self.table.add(np.maximum(keys, np.uint64(1)))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Ranks; of others -1 if all frequent ones are listed, else a number from their keys."""
        keys = np.maximum(keys, np.uint64(1))
        out = self.ranks[self.table.find(keys)]
        if not self.complete:
            out[out < 0] = _tail(keys[out < 0])
        return out


def _tail(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys) >> np.uint64(2)).view(np.int64) | np.int64(TAIL)


def _pair_keys(x: np.ndarray, y: np.ndarray, lang: str) -> np.ndarray:
    return mixed(mixed(x.view(np.uint64) + np.uint64(_seed(lang))) ^ (y.view(np.uint64) * _ODD))


def _band(ids: np.ndarray, first: int) -> np.ndarray:
    """0 for the `first` ids, then 1 for as many, 2 for twice as many and so on; 63 for the tail."""
    return np.where(ids >= TAIL, 63, np.frexp(ids.clip(0, 1 << 50) // first)[1])


def _summed(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted coordinates, each once, with the sums of n."""
    if not len(x):
        return x, y, n
    if max(int(x.max()), int(y.max())) < 1 << 31:
        key = (x << 32) | y
        if (n == 1).all():
            key, n = np.unique(key, return_counts=True)
            return key >> 32, key & 0xFFFFFFFF, n
        order = np.argsort(key, kind="stable")
    elif not y.any():
        order = np.argsort(x, kind="stable")
    else:
        order = np.lexsort((y, x))
    x, y, n = x[order], y[order], n[order]
    new = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
    return x[new], y[new], np.add.reduceat(n, new)


def _planes(v: np.ndarray) -> bytes:
    """Numbers from 0 as their lowest bytes, then their next ones and so on: high bytes, mostly zero, compress to next to nothing."""
    k = max(1, (int(v.max()).bit_length() + 7) // 8)
    return v.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :k].T.tobytes()


def _numbers(data: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, : len(data) // n] = np.frombuffer(data, np.uint8).reshape(-1, n).T
    return out.reshape(-1).view("<i8")


class _Buffer:
    """Pairs of one language that a task counts: of the most frequent ids by bincount, others as coordinates."""

    def __init__(self, side: int) -> None:
        self.side, self.cells, self.x, self.y, self.size = side, [], [], [], 0

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        head = (x < self.side) & (y < self.side)
        self.cells.append((x[head] * self.side + y[head]).astype(np.int32))
        small = np.int32 if max(int(x.max()), int(y.max())) < 1 << 31 else np.int64
        self.x.append(x[~head].astype(small)), self.y.append(y[~head].astype(small))
        self.size += len(x)

    def counted(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cells = np.bincount(np.concatenate(self.cells), minlength=1)
        there = np.flatnonzero(cells)
        x, y = np.concatenate(self.x).astype(np.int64), np.concatenate(self.y).astype(np.int64)
        self.x = self.y = self.cells = []
        x, y, n = _summed(x, y, np.broadcast_to(np.int64(1), len(x)))
        return np.r_[there // self.side, x], np.r_[there % self.side, y], np.r_[cells[there], n]


_KINDS = {"lang": pa.string(), "tile": pa.int64(), "size": pa.int32(), "x": pa.binary(), "y": pa.binary(), "n": pa.binary()}


def _tile_rows(lang: str, x: np.ndarray, y: np.ndarray, n: np.ndarray, tiles: Tiles, parts: int) -> pa.RecordBatch:
    """Counted pairs in order, as a row for each part of a tile."""
    tile = (_band(x, tiles.band) * 64 + _band(y, tiles.band)) * parts + np.where(x >= TAIL, x >> 7, x) % parts
    order = np.argsort(tile, kind="stable")
    tile, x, y, n = tile[order], x[order], y[order], n[order]
    cuts = np.flatnonzero(np.r_[True, tile[1:] != tile[:-1]]) if len(tile) else np.zeros(0, np.int64)
    rows = []
    for a, b in zip(cuts.tolist(), np.r_[cuts[1:], len(tile)].tolist(), strict=False):
        bx, by = divmod(int(tile[a]) // parts, 64)
        if 63 in (bx, by):
            rows.append((lang, int(tile[a]), b - a, _planes(x[a:b]), _planes(y[a:b]), _planes(n[a:b])))
            continue
        cell = (x[a:b] - tiles.start(bx)) // parts * tiles.width(by) + y[a:b] - tiles.start(by)  # ascending, as pairs are
        rows.append((lang, int(tile[a]), b - a, _planes(np.diff(cell, prepend=0)), None, _planes(n[a:b])))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, _KINDS.values(), strict=True)], list(_KINDS))


def _ids_of(cell: np.ndarray, tile: int, tiles: Tiles, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Both ids of the pairs with these cells in a part of a tile."""
    bx, by = divmod(tile // parts, 64)
    return cell // tiles.width(by) * parts + tiles.start(bx) + (tile - tiles.start(bx)) % parts, cell % tiles.width(by) + tiles.start(by)


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(lang, tile, cells or x, y or None, n) of rows of tiles."""
    for b in slices(batches, 16):
        for lang, tile, n, x, y, k in zip(*(c.to_pylist() for c in b.columns), strict=True):
            x = _numbers(x, n)
            yield (lang, tile, np.cumsum(x), None, _numbers(k, n)) if y is None else (lang, tile, x, _numbers(y, n), _numbers(k, n))


def _cut(rows: DataFrame, tiles: Tiles, parts: int, finer: int) -> DataFrame:
    """Rows of tiles in `parts` parts as rows of tiles in more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size = None, [], 0
        for lang, tile, x, y, n in _in_order(batches):
            if now is not None and (lang != now or size > tiles.held):
                yield _tile_rows(now, *_summed(*(np.concatenate(v) for v in zip(*held, strict=True))), tiles, finer)
                held, size = [], 0
            x, y = _ids_of(x, tile, tiles, parts) if y is None else (x, y)
            now, size = lang, size + len(n)
            held.append((x, y, n))
        if held:
            yield _tile_rows(now, *_summed(*(np.concatenate(v) for v in zip(*held, strict=True))), tiles, finer)

    return _by_tile(rows).mapInArrow(run, _TILE_ROWS)


_TILE_ROWS = "lang string, tile long, size int, x binary, y binary, n binary"


def _by_tile(rows: DataFrame) -> DataFrame:
    return rows.repartition("lang", "tile").sortWithinPartitions("lang", "tile")


def _count(texts: DataFrame, ids: Callable[[str, bytes], tuple[np.ndarray, np.ndarray]], least: int, total: int, tiles: Tiles) -> DataFrame:
    """(lang, x, y, a) of the pairs that ids(lang, data) gives at least `least` times in all texts(lang, text), stored.

    total: words of all texts, which decides the number of parts a tile is cut into, by x. One shuffle cuts each part into `fan`
    at most, so that rows don't become too many and small; if more are needed, counts so far are cut again.
    """
    parts = 1 << max(0, int(np.ceil(np.log2(max(1, total / (tiles.part * 64))))))  # bands of both sides have equal shares: some 64 tiles hold most

    first = min(parts, tiles.fan)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, _Buffer] = {}
        for b in slices(batches):
            for lang, data in _chunks(b):
                x, y = ids(lang, data)
                if len(x):
                    held.setdefault(lang, _Buffer(2 * tiles.band)).add(x, y)
                if sum(v.size for v in held.values()) > tiles.held:
                    fullest = max(held, key=lambda k: held[k].size)
                    yield _tile_rows(fullest, *held.pop(fullest).counted(), tiles, first)
        for lang, buffer in held.items():
            yield _tile_rows(lang, *buffer.counted(), tiles, first)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, dense, held, size, limit = None, None, [], 0, tiles.held

        def out() -> Iterator[pa.RecordBatch]:
            lang, tile = now
            if dense is not None:
                cell = np.flatnonzero(dense >= least)
                n = dense[cell]
            else:
                x, y, n = (v[held[0][2] >= least] for v in held[0])
                cell = x
            if 63 not in divmod(tile // parts, 64):
                x, y = _ids_of(cell, tile, tiles, parts)
            for at in range(0, len(x), 1 << 16):
                cut = slice(at, at + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(x[cut]), pa.string()), *(pa.array(v[cut].astype(np.int64)) for v in (x, y, n))], ["lang", "x", "y", "a"])

        def squeeze() -> None:
            nonlocal held, size
            held = [_summed(*(np.concatenate(v) for v in zip(*held, strict=True)))]
            size = len(held[0][0])

        for lang, tile, x, y, k in _in_order(batches):
            if (lang, tile) != now:
                if now:
                    if dense is None:
                        squeeze()
                    yield from out()
                now, held, size, limit = (lang, tile), [], 0, tiles.held
                bx, by = divmod(tile // parts, 64)
                cells = 0 if 63 in (bx, by) else -(-tiles.width(bx) // parts) * tiles.width(by)
                dense = np.zeros(cells, np.int64) if 0 < cells <= tiles.cells else None
            if dense is None:
                held.append((x, np.zeros(len(x), np.int64) if y is None else y, k))
                size += len(k)
                if size > limit:
                    squeeze()
                    limit = max(tiles.held, 2 * size)
            elif len(k) * 8 > len(dense):
                dense += np.bincount(x, weights=k, minlength=len(dense)).astype(np.int64)
            else:
                dense[x] += k  # cells of one row are all different
        if now:
            if dense is None:
                squeeze()
            yield from out()

    sent = texts.mapInArrow(count, _TILE_ROWS)
    there = first
    while there < parts:
        sent, there = _cut(sent, tiles, there, min(parts, there * tiles.fan)), min(parts, there * tiles.fan)
    merged = _by_tile(sent).mapInArrow(merge, "lang string, x long, y long, a long")
    return stored(merged, "pairs")


def _with_ids(rows: DataFrame, key: str, most: int, name: str) -> tuple[DataFrame, _Ids, Callable]:
    """rows(lang, key long, rank) with `id`, and the listed ones' ids by key."""
    langs = max(1, rows.select("lang").distinct().count())
    limit, total = max(1, most // langs), rows.count()
    table = rows.where(F.col("rank") < limit).select(key, "rank").toArrow()  # `most` rows at most
    keys = table.column(0).to_numpy().view(np.uint64)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tails = _tail(np.maximum(b.column(key).to_numpy().view(np.uint64), np.uint64(1)))
            rank = b.column("rank").to_numpy()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.where(rank < limit, rank, tails))], [*b.schema.names, "id"])

    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes) + ", id long"
    numbered = stored(rows.mapInArrow(number, schema), name)
    return numbered, _Ids(keys, table.column(1).to_numpy().astype(np.int64), len(keys) == total)


def collocations(docs: DataFrame, least: int = 10, top: int = 2000, contained: int = 50, listed: int = 1 << 21, tiles: Tiles = Tiles()) -> DataFrame:  # noqa: B008
    """(lang, rank, phrase, a, l, r, n, score): the `top` phrases of 2 or 3 words of each lang by the score of their weakest cut.

    docs(lang, text): A-Z are lower-cased, pieces end at . , ; : ! ? and LF to CR, words are parted by blanks and tabs; a null lang is
    `und`, null and empty texts have no words, repeated rows count as often as they come, an empty table gives an empty
    result. a is a phrase's number of occurrences, at least `least`; l and r those of its two parts, n that of all words of the lang;
    score = floor(1000000 a a / (l r)), exact for numbers below 10^15. A phrase inside a longer one that has at least `contained` % of its
    occurrences is left out. Ties go to the larger a, then to the phrase that is first in byte order.
    """
    with small_batches(docs.sparkSession):
        return _collocations(docs, least, top, contained, listed, tiles)


def _collocations(docs: DataFrame, least: int, top: int, contained: int, listed: int, tiles: Tiles) -> DataFrame:
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    vocabulary = stored(_vocabulary(texts, tiles.held).where((F.col("f") >= least) | F.col("word").isNull()), "vocabulary")
    sizes = stored(vocabulary.where("word is null").groupBy("lang").agg(F.sum("f").alias("n")), "sizes")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    words, word_ids = _with_ids(_ranked(vocabulary.where("word is not null"), "f", ["word"], "words"), "h", listed, "word-ids")
    given = spark.sparkContext.broadcast(word_ids)

    def encoded(lang: str, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words and whether each goes with the next one to a pair that counts."""
        x = given.value.find(word_hashes(data, _seed(lang)))
        return x, _follows(data) & (x[1:] >= 0) & (x[:-1] >= 0) if len(x) > 1 else np.zeros(0, bool)

    def pairs_of(lang: str, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        x, both = encoded(lang, data)
        at = np.flatnonzero(both)
        return x[at], x[at + 1]

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, x, y = np.array(b.column("lang").to_pylist(), object), b.column("x").to_numpy(), b.column("y").to_numpy()
            key = np.zeros(len(b), np.uint64)
            for one in set(lang):
                key[lang == one] = _pair_keys(x[lang == one], y[lang == one], one)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(key.view(np.int64))], [*b.schema.names, "key"])

    found = _count(texts, pairs_of, least, total, tiles).mapInArrow(keyed, "lang string, x long, y long, a long, key long")
    pairs, pair_ids = _with_ids(_ranked(found, "a", ["x", "y"], "pairs"), "key", listed, "pair-ids")
    known = spark.sparkContext.broadcast(pair_ids)

    def triples_of(lang: str, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        x, both = encoded(lang, data)
        if len(x) < 3:
            return x[:0], x[:0]
        at = np.flatnonzero(both)
        pair = np.full(len(both), -1, np.int64)
        pair[at] = known.value.find(_pair_keys(x[at], x[at + 1], lang))
        at = np.flatnonzero((pair[:-1] >= 0) & (pair[1:] >= 0))
        return pair[at], x[at + 2]

    triples = _count(texts, triples_of, least, total, tiles)
    given.destroy(), known.destroy()

    pair = lambda k: pairs.select(F.col("lang").alias(f"lang{k}"), *(F.col(c).alias(f"{c}{k}") for c in ("id", "x", "y", "a")))
    threes = triples.withColumnsRenamed({"x": "first", "y": "z"}).join(pair(1), F.expr("lang = lang1 and first = id1"))
    threes = stored(threes.join(pair(2), F.expr("lang = lang2 and y1 = x2 and z = y2")).select("lang", "id1", "id2", "x1", "y1", "z", "a", "a1", "a2"), "triples")
    longest = threes.select("lang", F.col("id1").alias("id"), "a").union(threes.select("lang", F.col("id2").alias("id"), "a")).groupBy("lang", "id").agg(F.max("a").alias("longer"))
    twos = pairs.join(longest, ["lang", "id"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < contained * F.col("a")))
    word = lambda tag, on: words.select(F.col("lang").alias(f"lang_{tag}"), F.col("id").alias(on), F.col("word").alias(f"w{tag}"), F.col("f").alias(f"f{tag}"))

    def named(rows: DataFrame, *on: str) -> DataFrame:
        for k, c in enumerate(on):
            w = word(k, f"{c}_id")
            rows = rows.join(w, (rows.lang == w[f"lang_{k}"]) & (rows[c] == w[f"{c}_id"])).drop(f"lang_{k}", f"{c}_id")
        return rows

    def scored(a: str, left: str, right: str) -> Column:
        return F.expr(f"cast((cast({a} as decimal(15,0)) * cast({a} as decimal(15,0)) * cast(1000000 as decimal(7,0))) div (cast({left} as decimal(15,0)) * cast({right} as decimal(15,0))) as long)")

    two = named(twos, "x", "y").select("lang", F.concat_ws(" ", "w0", "w1").alias("phrase"), "a", F.col("f0").alias("l"), F.col("f1").alias("r"), scored("a", "f0", "f1").alias("score"))
    cut1, cut2 = scored("a", "f0", "a2"), scored("a", "a1", "f2")
    three = named(threes, "x1", "y1", "z").withColumns({"s1": cut1, "s2": cut2})
    one = F.col("s1") <= F.col("s2")
    three = three.select("lang", F.concat_ws(" ", "w0", "w1", "w2").alias("phrase"), "a", F.when(one, F.col("f0")).otherwise(F.col("a1")).alias("l"), F.when(one, F.col("a2")).otherwise(F.col("f2")).alias("r"), F.least("s1", "s2").alias("score"))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    salted = two.union(three).withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(64)))  # a language may have most of all phrases
    best = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return best.join(F.broadcast(sizes), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
