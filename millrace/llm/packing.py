"""Best-fit packing of token pieces into sequences by exact-complement hashing.

What decides a packing is how many pieces there are of each length, at most `limit` numbers: the plan is made from them,
as patterns of lengths with multiplicities. Gaps are filled exactly from an index of single, pair and triple length sums
under availability counts; what is left is placed best-fit, longest first. As exact fillings may use up small pieces that
later long ones need, plans are also made with fewer kinds of them, or for longer gaps only, and the one of fewest sequences is
taken. Every step uses up a length or a kind of gap, so plans stay small while the corpus grows. Pieces then take their places by their rank among those of their length, in three levels.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import give_back, slices, small_batches, small_table, stored
from .tokens import encoder

#: Pieces of one length that are ranked together, and how many such blocks are counted together.
RANKED, BLOCKS = 512, 4096


def token_pieces(docs: DataFrame, path: str, end_id: int, limit: int, with_ids: bool = False, forget: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of docs(doc_id, text): ids of the whole text, then end_id.

    Documents of up to `limit` ids are one piece; longer ones have a first piece of the remainder and then full ones.
    Null and empty texts are the end id alone; rows without doc_id are left out; repeated rows have pieces each. forget: a
    worker's memory of words ends with each task, so that it takes no room beside what comes after.
    """
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int32()))] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = encoder(path)
        for b in slices(batches):
            rows = []
            for doc, ids in zip(b.column(0).to_pylist(), tok.encode(b.column(1)), strict=True):
                ids = np.r_[ids, end_id].astype("<u4")
                cuts = [0, *range(len(ids) % limit or limit, len(ids), limit), len(ids)]
                for k, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    rows.append((doc, k, i, j - i, zlib.crc32(ids[i:j].tobytes()), *([ids[i:j].astype(np.int32)] * with_ids)))
            if forget:
                give_back()
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(zip(*rows, strict=True) if rows else [[]] * len(fields), fields, strict=True)], names=[n for n, _ in fields])
        if forget:
            tok.forget()
            give_back()

    kept = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return kept.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def plan(counts: dict[int, int], limit: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, number of such sequences), using each length as often as counts says; never more sequences than best-fit decreasing."""
    least = -(-sum(n * c for n, c in counts.items()) // limit)
    best: list[tuple[tuple[int, ...], int]] = []
    for kinds, least_long in ((3, 1), (3, limit // 2), (2, 1), (2, limit // 2), (1, 1), (0, 1)):
        made = _plan(counts, limit, kinds, least_long)
        if not best or sum(t for _, t in made) < sum(t for _, t in best):
            best = made
        if sum(t for _, t in best) <= least:
            break
    return best


def _plan(counts: dict[int, int], limit: int, kinds: int, least_long: int) -> list[tuple[tuple[int, ...], int]]:
    """A plan whose gaps are filled exactly by up to `kinds` lengths, behind lengths of at least least_long."""
    left = np.zeros(limit + 1, np.int64)
    for n, c in counts.items():
        left[n] = c
    out: list[tuple[tuple[int, ...], int]] = []

    def take(*lengths: int) -> None:
        times = min(int(left[n]) // lengths.count(n) for n in lengths)
        if times > 0:
            left[list(set(lengths))] -= [times * lengths.count(n) for n in set(lengths)]
            out.append((lengths, times))

    for long in range(limit, least_long - 1, -1):
        gap = limit - long
        if left[long] and not gap:
            take(long)
        if kinds > 0 and left[long] and gap and gap <= long:
            take(long, gap)
        for a in range(min(gap - 1, long), (gap - 1) // 2, -1):  # pairs a >= b
            if kinds < 2 or not left[long]:
                break
            if left[a] and left[gap - a]:
                take(long, a, gap - a)
        for a in range(min(gap - 2, long), max(0, (gap - 1) // 3), -1):  # triples a >= b >= c
            if kinds < 3 or not left[long]:
                break
            if left[a]:
                b = np.arange((gap - a + 1) // 2, min(a, gap - a - 1) + 1)
                for x in b[(left[b] > 0) & (left[gap - a - b] > 0)].tolist():
                    if left[long] and left[a] and left[x] and left[gap - a - x]:
                        take(long, a, x, gap - a - x)
    bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for n in range(limit, 0, -1):
        while left[n]:
            gap = min((g for g, b in bins.items() if g >= n and b), default=None)
            if gap is None:  # new sequences, each with as many of this length as it holds
                each = min(limit // n, int(left[n]))
                pattern, times = (n,) * each, int(left[n]) // each
                bins.setdefault(limit - n * each, []).append((pattern, times))
                left[n] -= times * each
                continue
            pattern, there = bins[gap].pop()
            times = min(there, int(left[n]))
            if there > times:
                bins[gap].append((pattern, there - times))
            bins.setdefault(gap - n, []).append(((*pattern, n), times))
            left[n] -= times
    return out + [x for b in bins.values() for x in b]


def pack(pieces: DataFrame, limit: int) -> DataFrame:
    """pieces(length, ...) with sequence_id and offset: no sequence is longer than `limit`, offsets have no gaps.

    pieces must read the same rows each time (a stored table) and have doc_id and piece. No pieces give an empty result.
    """
    spark = pieces.sparkSession
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # `limit` rows at most
    slots, taken, sequence = [], dict.fromkeys(counts, 0), 0
    for lengths, times in plan(counts, limit):
        offset = 0
        for n in lengths:
            slots.append((n, taken[n], taken[n] + times, sequence - taken[n], offset))
            taken[n] += times
            offset += n
        sequence += times
    numbers = lambda rows, *names: small_table(spark, rows, pa.schema({n: pa.int64() for n in names}))
    slot = numbers(slots, "slot_length", "low", "high", "base", "offset")
    blocks = numbers([(n, -(-c // RANKED)) for n, c in counts.items()], "length", "blocks")
    dealt = pieces.join(F.broadcast(blocks), "length").withColumn("block", F.pmod(F.xxhash64("doc_id", "piece"), "blocks")).drop("blocks")
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    running = lambda over: F.coalesce(F.sum("n").over(over), F.lit(0))
    bases = dealt.groupBy("length", "block").agg(F.count("*").alias("n")).withColumn("upper", F.floor(F.col("block") / BLOCKS))
    uppers = bases.groupBy("length", "upper").agg(F.sum("n").alias("n")).withColumn("first", running(before("length").orderBy("upper"))).drop("n")
    bases = bases.withColumn("within", running(before("length", "upper").orderBy("block"))).join(uppers, ["length", "upper"]).select("length", "block", (F.col("first") + F.col("within")).alias("before"))
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("length", "block").orderBy("doc_id", "piece")) - 1).join(bases, ["length", "block"]).withColumn("rank", F.col("rank") + F.col("before"))
    placed = ranked.join(F.broadcast(slot), (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    return placed.select(*pieces.columns, (F.col("base") + F.col("rank")).alias("sequence_id"), F.col("offset"))


def pack_documents(docs: DataFrame, path: str, end_id: int, limit: int = 1024, with_ids: bool = False, forget: bool = False) -> DataFrame:
    """token_pieces() of docs with their places by pack()."""
    with small_batches(docs.sparkSession):
        pieces = stored(token_pieces(docs, path, end_id, limit, with_ids, forget), "pieces")
    return pack(pieces, limit)
