"""Exact top-k by inner product as a Voronoi kNN join.

Data are grouped by nearest pivot; of each cell its size, its radius and the distances of its k + 1 members nearest the pivot are
summarised. From the summaries alone every query has a lower bound of its k-th best score: a vector x of cell p scores
q.p - |q| * |x - p| at least, so the best of these bounds count. It scores q.p + |q| * |x - p| at most, so a group of queries
needs only vectors at a distance from their pivot of at least the group's bound for that cell. Queries are grouped by nearest
pivot; groups near each other that need much the same vectors are made one, which is told from the summaries. Data are replicated
to the groups that need them, once a group, solved locally, and the results merged. Where vectors have no clusters at all no
distance rules a vector out, every group needs every vector, and so there is but one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import slices, stored
from .vectors import matrix, sample, spread, usable

#: Fewest and most pivots, and vectors of the sample for each of them.
LEAST_PIVOTS, MOST_PIVOTS, SAMPLED = 64, 1024, 16
#: Queries and vectors that a block holds.
QUERY_BLOCK, DATA_BLOCK = 4096, 16_384
#: Steps by which a summary tells how a cell's distances from its pivot are spread, and by how much more work joined groups may cost.
STEPS, DEARER = 16, 1.25


def joined_groups(points: np.ndarray, asked: np.ndarray, needed: np.ndarray) -> np.ndarray:
    """The group that each group of queries becomes part of: groups' pivots, numbers of queries, and vectors needed of each cell.

    A group joins the nearest one before it if all queries of both then meet at most DEARER times as many vectors.
    """
    joined, members, work = np.arange(len(points)), [], []
    for g in range(len(points)):
        if members:
            k = int(np.argmin([((points[g] - points[m[0]]) ** 2).sum() for m in members]))
            both = np.maximum(work[k][1], needed[g])
            own = work[k][0] * work[k][1].sum() + asked[g] * needed[g].sum()
            if (work[k][0] + asked[g]) * both.sum() <= DEARER * own:
                members[k].append(g)
                work[k] = (work[k][0] + asked[g], both)
                joined[g] = members[k][0]
                continue
        members.append([g])
        work.append((asked[g], needed[g]))
    return joined


def top_k(vectors: DataFrame, queries_where: str, k: int = 10, scale: int = 1024, told: dict | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) of vectors(vec_id, embedding): each query's k highest scores, ties to the smaller vec_id.

    Components become floor(scale * x); the score is their inner product, exact up to 2**53. A query's own row is no
    candidate. Vectors that are null or hold null or non-finite components take no part; of unequal lengths, the shorter is
    filled with zeros; rows without vec_id are left out; repeated rows of a vec_id are candidates each, but for queries of
    that id; with fewer than k candidates all are returned; an empty table gives an empty result. told, if given, is told the
    numbers of vectors, groups and vectors sent to groups.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col("vec_id").isNotNull() & usable("embedding"))
    rows = rows.select(F.col("vec_id").cast("long"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("x"), F.expr(f"coalesce({queries_where}, false)").alias("query"))
    rows = stored(rows, "vectors")
    count, dim = rows.agg(F.count("*"), F.coalesce(F.max(F.size("x")), F.lit(0))).first()
    wanted = min(MOST_PIVOTS, max(LEAST_PIVOTS, round(math.sqrt(count) / 4)))
    points = spread(sample(rows, "vec_id", "x", SAMPLED * wanted), wanted)
    points = np.pad(points, ((0, 0), (0, dim - points.shape[1]))) if len(points) else np.zeros((1, dim))
    half = (points**2).sum(1) / 2

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2048):
            x = matrix(b.column(1), dim)
            cell = np.argmax(x @ points.T - half, axis=1)
            away = np.sqrt(((x - points[cell]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cell.astype(np.int32)), pa.array(away), b.column(2), pa.array([r.tobytes() for r in x], pa.binary())], ["vec_id", "cell", "away", "query", "x"])

    placed = stored(rows.mapInArrow(place, "vec_id long, cell int, away double, query boolean, x binary"), "cells")
    steps = F.percentile_approx("away", [s / STEPS for s in range(STEPS)], 1000).alias("steps")
    summary = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius"), F.count_if("query").alias("asked"), steps).orderBy("cell").collect()  # a row for each pivot at most
    cells = np.array([r["cell"] for r in summary], np.int64)
    place_in_cell = F.row_number().over(Window.partitionBy("cell").orderBy("away"))
    nearest = placed.select("cell", "away").withColumn("n", place_in_cell).where(F.col("n") <= k + 1).select("cell", "away").collect()  # k + 1 numbers a pivot at most
    index = {c: i for i, c in enumerate(cells.tolist())}
    near_cell, near_away = np.array([index[r["cell"]] for r in nearest], np.int64), np.array([r["away"] for r in nearest])

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 256):
            q = np.frombuffer(b"".join(b.column(1).to_pylist())).reshape(len(b), dim)
            to, length = q @ points[cells].T, np.sqrt((q * q).sum(1))
            least = to[:, near_cell] - length[:, None] * near_away
            kth = np.full(len(q), -np.inf)
            if least.shape[1] > k:  # one more than k: the query itself may be among them
                kth = np.partition(least, least.shape[1] - k - 1, axis=1)[:, least.shape[1] - k - 1]
            with np.errstate(divide="ignore", invalid="ignore"):
                need = np.where(length[:, None] > 0, (kth[:, None] - to) / length[:, None], -np.inf)
            need = np.where(np.isfinite(need), need - 1e-9 * np.abs(need) - 1e-6, -1.0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(need.tolist(), pa.list_(pa.float64())), b.column(1)], ["query_id", "group", "need", "q"])

    queries = stored(placed.where("query").select("vec_id", "x", "cell").mapInArrow(bound, "query_id long, cell int, need array<double>, q binary"), "queries")
    least = queries.select("cell", F.posexplode("need").alias("i", "need")).groupBy("cell", "i").agg(F.min("need").alias("need")).toArrow()  # pivots x pivots numbers at most
    first = {c: i for i, c in enumerate(sorted(set(least.column("cell").to_pylist())))}
    needed = np.full((len(first), len(cells)), np.inf)
    needed[[first[c] for c in least.column("cell").to_pylist()], least.column("i").to_numpy()] = least.column("need").to_numpy()
    radius, size = np.array([r["radius"] for r in summary]), np.array([r["n"] for r in summary])
    expected = np.zeros_like(needed)
    for i, r in enumerate(summary):  # vectors of a cell at such a distance or more, by its steps
        part = 1 - (np.searchsorted(np.array(r["steps"]), needed[:, i]) - 1).clip(0) / STEPS
        expected[:, i] = np.where(needed[:, i] <= radius[i], part * size[i], 0)
    own = np.array(list(first), np.int64)
    joined = joined_groups(points[own], np.array([summary[index[c]]["asked"] for c in first]), expected)
    group_of = F.broadcast(spark.createDataFrame([(c, int(joined[i])) for c, i in first.items()], "of int, group int"))  # a row for each pivot
    queries = queries.join(group_of, F.col("cell") == F.col("of")).drop("cell", "of", "need")
    groups = sorted(set(joined.tolist()))
    bounds = [(g, int(cells[i]), float(v)) for g in groups for i, v in enumerate(needed[joined == g].min(0).tolist()) if v <= radius[i]]
    needs = spark.createDataFrame(bounds, "group int, needed_cell int, need double")  # groups x pivots rows at most
    sent = stored(placed.join(F.broadcast(needs), (F.col("cell") == F.col("needed_cell")) & (F.col("away") >= F.col("need"))).select("group", "vec_id", "x"), "sent")
    if told is not None:
        told |= {"vectors": count, "groups": len(groups), "sent": sent.count()}
    blocks = lambda df, size: df.groupBy("group").agg(F.ceil(F.count("*") / size).cast("int").alias("blocks"))
    shape = blocks(queries, QUERY_BLOCK).withColumnRenamed("blocks", "query_blocks").join(blocks(sent, DATA_BLOCK).withColumnRenamed("blocks", "data_blocks"), "group")
    shape = F.broadcast(spark.createDataFrame(shape.collect(), "group int, query_blocks int, data_blocks int"))  # a row for each group
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = queries.join(shape, "group").select("group", F.pmod(F.xxhash64("query_id"), "query_blocks").cast("int").alias("i"), every("data_blocks").alias("j"), "query_id", "q")
    right = sent.join(shape, "group").select("group", every("query_blocks").alias("i"), F.pmod(F.xxhash64("vec_id"), "data_blocks").cast("int").alias("j"), "vec_id", "x")

    def solve(asked: pa.Table, data: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
        if not len(asked) or not len(data):
            return schema.empty_table()
        data = data.sort_by("vec_id")
        ids, qs = data.column("vec_id").to_numpy(), asked.column("query_id").to_numpy()
        x = np.frombuffer(b"".join(data.column("x").to_pylist())).reshape(len(ids), dim)
        q = np.frombuffer(b"".join(asked.column("q").to_pylist())).reshape(len(qs), dim)
        found: list[tuple] = []
        for at in range(0, len(qs), 128):
            scores = q[at : at + 128] @ x.T
            for query, row in zip(qs[at : at + 128].tolist(), scores, strict=True):
                other = ids != query
                row, other_ids = row[other], ids[other]
                if len(row) > k:
                    keep = np.flatnonzero(row >= np.partition(row, len(row) - k)[len(row) - k])
                    row, other_ids = row[keep], other_ids[keep]
                best = np.lexsort((other_ids, -row))[:k]
                found += [(query, v, s) for v, s in zip(other_ids[best].tolist(), row[best].astype(np.int64).tolist(), strict=True)]
        return pa.table([pa.array(c, pa.int64()) for c in zip(*found, strict=True)] if found else [pa.array([], pa.int64())] * 3, schema=schema)

    found = left.groupBy("group", "i", "j").cogroup(right.groupBy("group", "i", "j")).applyInArrow(solve, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
