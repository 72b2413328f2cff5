"""Embedding near-duplicates by a pivot-permutation index.

Every vector is described by its nearest reference points in order. Inverted lists bring together vectors that share pivots:
a list for each pair of pivots holds the vectors that have both among their nearest, so two vectors meet if their count of
shared pivots is two or more. Pairs that meet are verified by their cosine, in blocks of a list, and count in the first list
they share. Equal vectors are one member with a multiplicity. Lists longer than a block are dealt out as pairs of blocks.

The number of pivots grows with the root of the number of vectors, and how many nearest ones describe a vector with its
logarithm: lists then stay of some hundred to a few thousand members, and a pair with a cosine of 0.9 in 64 unrelated
dimensions meets with a probability of 0.995 or more with 64 to 4096 pivots (measured in the tests). Only the pivots are fitted,
on a bounded sample; every row is indexed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import slices, stored
from .simhash import forest
from .vectors import matrix, sample, spread, usable

#: Fewest and most pivots, and vectors of the sample for each of them.
LEAST_PIVOTS, MOST_PIVOTS, SAMPLED = 64, 4096, 8
BLOCK = 1024


def pivots_for(count: int) -> int:
    return min(MOST_PIVOTS, max(LEAST_PIVOTS, round(math.sqrt(count) / 4)))


def near_for(pivots: int) -> int:
    """Nearest pivots that describe a vector."""
    return max(6, math.ceil(math.log2(max(2, pivots))))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1))[:, None]


def _listed(vectors: DataFrame, pivots: np.ndarray, near: int, shared: int, dim: int, kind: str) -> DataFrame:
    """(list, id, weight, order binary, vector binary): a row for each set of `shared` of the vector's `near` nearest pivots."""
    subsets = list(combinations(range(near), shared))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2048):
            if not len(b):
                continue
            x = matrix(b.column(2), dim)
            order = np.sort(np.argsort(-(_unit(x) @ pivots.T), axis=1, kind="stable")[:, :near], axis=1).astype("<i2")
            keys = np.stack([sum(order[:, i].astype(np.int64) << (16 * k) for k, i in enumerate(c)) for c in subsets], axis=1)
            at = np.repeat(np.arange(len(x)), len(subsets))
            text = lambda rows: pa.array([r.tobytes() for r in rows], pa.binary()).take(pa.array(at))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at)), text(order), text(x.astype(kind))], ["list", "id", "weight", "order", "vector"])

    return vectors.mapInArrow(run, "list long, id long, weight long, order binary, vector binary")


def links(vectors: DataFrame, pivots: np.ndarray, threshold: float, near: int, shared: int, dim: int, kind: str = "<f8") -> DataFrame:
    """(a, b, n) of vectors(id, weight, embedding), distinct and not zero; kind: the numbers that they are sent as.

    Rows with b: links that connect what all links found connect. Rows without: n links, weights counted, to add up for a.
    """
    near = min(near, len(pivots))
    shared = min(shared, near)
    rows = stored(_listed(vectors, pivots, near, shared, dim, kind), "lists")
    sizes = rows.groupBy("list").count().where(F.col("count") > 1)
    blocks = F.ceil(F.col("count") / BLOCK).cast("int")
    dealt = rows.join(sizes.select("list", blocks.alias("blocks")), "list").withColumn("own", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("list", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "weight", "order", "vector")

    def solve(key: tuple, t: pa.Table) -> pa.Table:
        this, i, j = (k.as_py() for k in key)
        t = t.sort_by("id")
        ids, weights, own = (t.column(c).to_numpy() for c in ("id", "weight", "own"))
        order = np.frombuffer(b"".join(t.column("order").to_pylist()), "<i2").reshape(len(ids), -1)
        unit = _unit(np.frombuffer(b"".join(t.column("vector").to_pylist()), kind).reshape(len(ids), -1).astype(float))
        left = np.flatnonzero(own == i)
        right = np.flatnonzero(own == j)
        a, b, counts = [], [], np.zeros(len(ids), np.int64)
        for at in range(0, len(left), BLOCK):
            part = left[at : at + BLOCK]
            x, y = np.nonzero(unit[part] @ unit[right].T >= threshold)
            x, y = part[x], right[y]
            if i == j:
                x, y = x[x < y], y[x < y]
            for k in range(0, len(x), 1 << 18):
                p, q = x[k : k + (1 << 18)], y[k : k + (1 << 18)]
                same = (order[p][:, :, None] == order[q][:, None, :]).any(2)
                rank = np.cumsum(same, 1)
                first = sum(np.where(same & (rank == s + 1), order[p].astype(np.int64) << (16 * s), 0).sum(1) for s in range(shared))
                mine = first == this  # a pair counts in the first list that it shares
                p, q = p[mine], q[mine]
                counts += np.bincount(p, weights[q], len(ids)).astype(np.int64) + np.bincount(q, weights[p], len(ids)).astype(np.int64)
                keep = forest(p, q, len(ids))
                a.append(p[keep])
                b.append(q[keep])
        a, b = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (a, b))
        keep = forest(a, b, len(ids))
        some = np.flatnonzero(counts)
        return pa.table({"a": np.r_[ids[a[keep]], ids[some]], "b": pa.array(np.r_[ids[b[keep]], ids[some]], mask=np.r_[np.zeros(len(keep), bool), np.ones(len(some), bool)]), "n": np.r_[np.zeros(len(keep), np.int64), counts[some]]})

    return dealt.groupBy("list", "i", "j").applyInArrow(solve, "a long, b long, n long")


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, pivots: int | None = None, near: int | None = None, shared: int = 2) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of vectors(vec_id, embedding).

    n_links: other vectors with a cosine of `threshold` or more, in double precision; component_id: the smallest vec_id that
    links reach, its own included; kept: vec_id is it. Vectors that are null, zero or hold null or non-finite components link
    with nothing; vectors of unequal length compare as if filled with zeros; rows without vec_id are left out; each repeated
    row is a vector of its own; an empty table gives an empty result. The pivots' sample has at most SAMPLED * MOST_PIVOTS
    vectors.
    """
    element = vectors.schema["embedding"].dataType.elementType.simpleString()
    kind, wide = ("<f4", "array<float>") if element == "float" else ("<f8", "array<double>")  # no digit is lost in floats that were floats
    all_rows = vectors.where("vec_id is not null").select(F.col("vec_id").cast("long"), F.col("embedding").cast(wide).alias("embedding"))
    linkable = usable("embedding") & F.exists("embedding", lambda x: x != 0)
    digests = [F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding").alias("h2")]  # 128 bits stand for a vector in joins
    good = all_rows.where(linkable).select("vec_id", "embedding", *digests)
    classes = stored(good.groupBy("h1", "h2").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight"), F.min_by("embedding", "vec_id").alias("embedding")), "classes")
    count, dim = classes.agg(F.count("*"), F.max(F.size("embedding"))).first()
    members = good.select("vec_id", "h1", "h2").join(classes.select("h1", "h2", "id", "weight"), ["h1", "h2"]).select("vec_id", "id", "weight")
    singles = all_rows.where(~linkable | F.col("embedding").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if not count:
        return singles
    wanted = pivots or pivots_for(count)
    points = sample(classes, "id", "embedding", max(4096, SAMPLED * wanted))
    points = np.pad(points, ((0, 0), (0, dim - points.shape[1])))
    chosen = spread(_unit(points), wanted)
    found = stored(links(classes.select("id", "weight", "embedding"), chosen, threshold, near or near_for(len(chosen)), shared, dim, kind), "links")
    degree = found.where("b is null").groupBy("a").agg(F.sum("n").alias("n"))
    groups = components(found.where("b is not null").select("a", "b"))
    named = classes.select("id").join(degree, F.col("id") == F.col("a"), "left").join(groups, F.col("id") == F.col("node"), "left")
    named = named.select(F.col("id").alias("class"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("component", "id").alias("component_id"))
    linked = members.join(named, F.col("id") == F.col("class")).select("vec_id", (F.col("n") + F.col("weight") - 1).alias("n_links"), "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    return linked.union(singles)
