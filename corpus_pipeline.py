"""The corpus pipeline: documents that a classifier keeps, one of each group of near copies, pseudonymised, mixed and packed."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import mixing, packing, pii, quality, simhash
from millrace.llm.queries import PII_KEY
from millrace.llm.shared import broadcast_if_small, stored


def _digested(docs: DataFrame) -> DataFrame:
    """docs with a hash of the text: with doc_id it tells apart all rows but repeated ones."""
    return docs.withColumn("__digest", F.xxhash64("text"))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier, fitted on the labels of these documents, does not reject.

    Null and empty texts are scored like any other; rows without doc_id and repeated rows are judged by their texts; without
    labels of both kinds all rows stay or go by the labels' rate. No rows give none.
    """
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, model)


def keep_first(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates - five-word shingles, similarity 0.8 or more: that of the smallest doc_id.

    Candidates come from SimHash groups by ball hashing, and from min-hash bands what lies further apart; all are verified.
    Rows are told apart as rows: of repeated ones one stays, rows of one doc_id with other texts are documents of their own,
    rows without doc_id take part and come last. Null texts count as empty, and all empty texts are one group. No rows give none.
    """
    rows = stored(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    groups = stored(simhash.near_components(rows.select(F.col("__row").alias("doc_id"), "text")), "groups")
    of = groups.select(F.col("doc_id").alias("__of"), "component").join(rows.select("__row", "doc_id"), F.col("__of") == F.col("__row"))
    placed = of.select("__of", "component", F.struct(F.col("doc_id").isNull(), "doc_id", "__of").alias("place"))
    chosen = placed.groupBy("component").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").select("component", "first")
    gone = stored(placed.join(chosen, "component").where("place <> first").select(F.col("__of").alias("__row")), "gone")
    return rows.join(broadcast_if_small(gone), "__row", "left_anti").select(*docs.columns)


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced; n_chars follows the text.

    Null and empty texts, rows without doc_id, repeated rows and all other columns stay as they are. No rows give none.
    """
    masked = pii.pseudonymise(docs, PII_KEY)
    return masked.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else masked


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents as often as the mix draws them, shard by shard in shuffled order.

    A source's last document, which its target cuts, is taken if the target reaches its half. Null and empty texts have no
    words and are never drawn; null is a source of its own; rows are drawn by doc_id, null too, and text, so repeated rows come
    together. No rows give none.
    """
    rows, draws = mixing.mix(_digested(docs), keep=("__digest",))
    drawn = draws.join(rows.select("key", F.col("doc_id").alias("drawn_id"), F.col("__digest").alias("drawn"), "size"), "key").where(F.col("words") * 2 >= F.col("size"))
    places = drawn.select(F.col("drawn_id").alias("__id"), F.col("drawn").alias("__drawn"), F.col("shard").alias("__shard"), F.col("place").alias("__place"), F.col("epoch").alias("__epoch")).dropDuplicates(["__id", "__drawn", "__epoch"])
    mixed = _digested(docs).join(places, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__digest") == F.col("__drawn")))
    return mixed.repartition("__shard").sortWithinPartitions("__shard", "__place", "doc_id", "__epoch").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each token piece with its sequence and offset.

    Null and empty texts are one end id; rows without doc_id are left out; repeated rows have pieces each. No rows give none.
    """
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2, limit=1024, forget=True)


STAGES = [("quality", keep_quality), ("simhash", keep_first), ("pii", pseudonymise), ("mixing", mix), ("packing", pack)]
#: Not expressible in SQL; each stage is tested against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
