"""Connected components of a graph given as links, by alternating large-star and small-star rounds.

Each round is two groupings and two joins on the link table; a hub's rows are pre-aggregated by min() and its
joins are split by adaptive execution, so no group is ever gathered. The links are checkpointed after each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import shared_dir


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """links: a > b."""
    least = links.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m")
    moved = links.join(least, F.col("a") == F.col("n")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select(F.col("n").alias("a"), F.col("m").alias("b"))).distinct()


def _are_stars(links: DataFrame) -> bool:
    """links: a > b. Whether each node is linked to one smaller node at most, and only if none smaller is linked to that one."""
    ends = links.select(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(links.select(F.col("b").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1 and up > 0").isEmpty()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of links(a long, b long); component is the smallest node reachable.

    Self links and links with a null end are ignored; no links give an empty result. Nodes without links are not listed.
    """
    shared_dir(links.sparkSession)
    now = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    for _ in range(rounds):
        if _are_stars(now):  # whose centres are the smallest nodes
            break
        now = _small_star(_large_star(now)).checkpoint()
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
