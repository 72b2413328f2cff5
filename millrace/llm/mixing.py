"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree, in DataFrame operations only.

Each source is a stream of its documents in an order that a hash permutes, repeated if its target exceeds its size and cut
where the target is reached. The stream is divided into blocks of equally many words. A tree halves the output shards again
and again: at each node the exact numbers of blocks that every source has there are split by one draw of the multivariate
hypergeometric distribution. A shard then draws its number of consecutive blocks of the permuted order of every source,
disjoint from all others', and orders its documents by a hash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored, word_count

WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
#: Hash buckets of a source's documents, in two levels of FAN each, whose sizes add up to places in the stream.
FAN = 256


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_size, target double) of sizes(source, size long).

    Sources in code-point order, null last, weigh as `weights` repeats. They share the sum of all sizes by weight; no target
    exceeds `most` times its source's size, and what is above is shared again: target = least(cap, level * weight), where
    the level is found from running sums in the order of cap / weight.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = totals.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    capped = ranked.withColumn("weight", weight).withColumn("cap", most * F.col("source_size").cast("double")).withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", "rank")
    running = capped.withColumns({
        "total": F.sum("source_size").over(Window.partitionBy()).cast("double"),
        "full": F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "open": F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
    }).withColumn("level", (F.col("total") - F.col("full")) / F.col("open"))
    level = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "rank", "level"))).over(Window.partitionBy())["level"]
    return running.withColumn("found", level).select("source", "source_size", F.least("cap", F.coalesce(F.col("found") * F.col("weight"), F.col("cap"))).alias("target"))


def _log_factorial(n: Column) -> Column:
    x = n.cast("double") + 1
    series = (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x)
    return F.when(n <= 20, F.log(F.factorial(F.least(n, F.lit(20)).cast("int")).cast("double"))).otherwise(series)


def _let(value: Column, make) -> Column:
    """make(value) with value worked out once."""
    return F.element_at(F.transform(F.array(value), make), 1)


def _hypergeometric(u: Column, total: Column, kind: Column, drawn: Column) -> Column:
    """Number of one kind among `drawn` of `total` things of which `kind` are of that kind, by inversion of u in [0, 1)."""

    def log_weight(s: Column, k: Column) -> Column:
        return -(_log_factorial(k) + _log_factorial(s["kind"] - k) + _log_factorial(s["drawn"] - k) + _log_factorial(s["rest"] + k))

    def window(s: Column) -> Column:
        share = s["kind"] / F.greatest(s["total"], F.lit(1))
        return F.struct((s["drawn"] * share).alias("mean"), F.sqrt(F.greatest(F.lit(0.0), s["drawn"] * share * (1 - share))).alias("deviation"))

    def pick(s: Column, first: Column, weights: Column) -> Column:
        step = lambda a, w: F.struct((a["sum"] + w).alias("sum"), (a["passed"] + F.when(a["sum"] + w <= a["aim"], 1).otherwise(0)).alias("passed"), a["aim"].alias("aim"))
        start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).cast("long").alias("passed"), (s["u"] * F.aggregate(weights, F.lit(0.0), lambda a, w: a + w)).alias("aim"))
        return F.least(s["high"], first + F.aggregate(weights, start, step)["passed"])

    def draw(s: Column) -> Column:
        mode = F.greatest(s["low"], F.least(s["high"], F.floor((s["drawn"] + 1) * ((s["kind"] + 1) / (s["total"] + 2)))))
        near = lambda m: F.sequence(F.greatest(s["low"], F.floor(m["mean"] - 10 * m["deviation"] - 10)).cast("long"), F.least(s["high"], F.ceil(m["mean"] + 10 * m["deviation"] + 10)).cast("long"))
        return _let(_let(window(s), near), lambda ks: _let(log_weight(s, mode), lambda top: pick(s, ks[0], F.transform(ks, lambda k: F.exp(log_weight(s, k) - top)))))

    rest = total - kind - drawn
    given = F.struct(u.alias("u"), total.alias("total"), kind.alias("kind"), drawn.alias("drawn"), rest.alias("rest"), F.greatest(F.lit(0).cast("long"), -rest).alias("low"), F.least(drawn, kind).alias("high"))
    return _let(given, lambda s: F.when(s["low"] == s["high"], s["low"]).otherwise(draw(s)))


def split_quotas(root: DataFrame, levels: int, seed: int) -> DataFrame:
    """(shard, quotas array<long>) of the 2**levels leaves under root(quotas array<long>)."""
    nodes = root.select(F.lit(0).cast("long").alias("node"), "quotas")
    for level in range(levels):
        total = F.aggregate("quotas", F.lit(0).cast("long"), lambda a, q: a + q)
        start = F.struct(total.alias("total"), F.floor((total + F.col("node") % 2) / 2).cast("long").alias("drawn"), F.lit(0).alias("i"), F.array().cast("array<long>").alias("left"))

        salt = F.xxhash64(F.lit(seed), F.lit(level), F.col("node"))

        def step(a: Column, kind: Column) -> Column:
            u = F.pmod(F.xxhash64(salt, a["i"]), F.lit(1 << 53)) / F.lit(float(1 << 53))
            k = _hypergeometric(u, a["total"], kind, a["drawn"])
            return F.struct((a["total"] - kind).alias("total"), (a["drawn"] - k).alias("drawn"), (a["i"] + 1).alias("i"), F.concat(a["left"], F.array(k)).alias("left"))

        split = nodes.withColumn("left", F.aggregate("quotas", start, step)["left"])
        children = F.array(F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("quotas")), F.struct((F.col("node") * 2 + 1).alias("node"), F.zip_with("quotas", "left", lambda q, x: q - x).alias("quotas")))
        nodes = stored(split.select(F.inline(children)), "nodes")  # each level's plan stays as small as the first's
        if level % 6 == 5:
            nodes = nodes.repartition("node")
    return nodes.select(F.col("node").alias("shard"), "quotas")


def mix(docs: DataFrame, seed: int = 17, shard_words: int = 1 << 20, shard_blocks: int = 64, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(documents, draws) of docs(doc_id, text, source).

    documents: key, doc_id, source, size, source_size, target, one row per row. draws: key, shard, place (order within the
    shard), epoch, words (fewer than size for the one document of a source that its target cuts). key joins the two and has
    `source_key` null-safe. A source's words drawn are its target rounded; no document is drawn more often than targets allow.
    Null and empty texts have size 0 and are never drawn; null is a source of its own; rows without doc_id take part and keep
    their null; repeated rows are rows of their own; no rows give empty results. The same rows and seed give the same draws.
    `keep` names columns that the documents keep; with doc_id they decide the order. Each node of the tree has a number for
    each source, and shards of a source are numbered by one task, which holds for sources up to some ten thousands.
    """
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    sizes = stored(docs.select("doc_id", *keep, F.col("source").cast("string"), word_count(F.col("text")).alias("size")), "sizes")
    aims = stored(targets(sizes), "targets").withColumn("words", F.round("target").cast("long"))
    total, kinds = aims.agg(F.sum("words"), F.count("*")).first()
    levels = max(3, math.ceil(math.log2(max(1, (total or 0) / shard_words))))
    block_words = max(1, -(-(total or 0) // (shard_blocks << levels)))

    h = F.xxhash64(F.lit(seed), "doc_id", "size", *keep)
    placed = sizes.withColumn("source_key", key).withColumn("h", h).withColumn("bucket", F.pmod("h", F.lit(FAN * FAN)).cast("int"))
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    running = lambda over: F.coalesce(F.sum("size").over(over), F.lit(0))
    buckets = placed.groupBy("source_key", "bucket").agg(F.sum("size").alias("size")).withColumn("upper", F.floor(F.col("bucket") / FAN).cast("int"))
    uppers = buckets.groupBy("source_key", "upper").agg(F.sum("size").alias("size")).withColumn("upper_at", running(before("source_key").orderBy("upper"))).drop("size")
    buckets = buckets.withColumn("bucket_at", running(before("source_key", "upper").orderBy("bucket"))).drop("size").join(uppers, ["source_key", "upper"])
    inner = Window.partitionBy("source_key", "bucket").orderBy("h", "doc_id", *keep)
    placed = placed.withColumn("at", running(inner.rowsBetween(Window.unboundedPreceding, -1))).withColumn("number", F.row_number().over(inner))
    placed = placed.join(buckets.select("source_key", "bucket", (F.col("bucket_at") + F.col("upper_at")).alias("base")), ["source_key", "bucket"])
    keyed = aims.withColumn("source_key", key).select("source_key", "source_size", "target", "words")
    placed = placed.join(keyed, "source_key").withColumn("at", F.col("at") + F.col("base"))
    documents = placed.select(F.struct("source_key", "bucket", "number").alias("key"), "source_key", "doc_id", *keep, "source", "size", "source_size", "target", "words", "at", "h")

    epochs = F.sequence(F.lit(0), F.lit(MOST_EPOCHS - 1))
    draws = documents.where("size > 0").select("key", "source_key", "size", "words", "h", F.explode(epochs).alias("epoch"), (F.col("epoch") * F.col("source_size") + F.col("at")).alias("at"))
    draws = draws.where("at < words").select("key", "source_key", "h", "epoch", F.least("size", F.col("words") - F.col("at")).alias("words"), F.floor(F.col("at") / block_words).cast("long").alias("block"))

    quotas = keyed.withColumn("blocks", F.ceil(F.col("words") / block_words).cast("long"))
    root = quotas.agg(F.sort_array(F.collect_list(F.struct("source_key", "blocks"))).alias("all"))
    leaves = split_quotas(root.select(F.col("all.blocks").alias("quotas")), levels, seed)
    names = root.select(F.posexplode("all.source_key").alias("i", "source_key"))
    owned = leaves.select("shard", F.posexplode("quotas").alias("i", "n")).where("n > 0").join(names, "i")
    owned = owned.withColumn("first", F.coalesce(F.sum("n").over(before("source_key").orderBy("shard")), F.lit(0)))
    owner = owned.select("shard", "source_key", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("block"))
    drawn = draws.join(owner, ["source_key", "block"]).select("key", "shard", F.xxhash64("h", "shard", "epoch").alias("place"), "epoch", "words")
    return documents.drop("words", "at", "h"), drawn
