"""Line dedup over levelled sorted runs of line hashes; DataFrame functions only.

A run is a table of line keys, one row each, bucketed and sorted by the key's hash. Each new batch of documents brings its own
keys in order, is anti-joined by merging with every run - what the runs have settled already is not written again - and
becomes a run of level 0. As soon as a level has `fan_out` runs they are merged into one of the next level, so there are
never more than a few runs for each power of `fan_out`, and a key is rewritten once a level. A key is told by two 64-bit hashes.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import broadcast_if_small, new_path, stored

_WHITE = " \t\x0b\x0c\r\n"
_KEY = ["h1", "h2"]
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


class LineRuns:
    """Runs of (h1, h2, n, largest): a key, in how many documents of some batches it was found, and the largest doc_id of these.

    A document must come in one batch only; batches may come in any order, most is spared if those of larger ids come first.
    """

    def __init__(self, spark: SparkSession, enough: int, fan_out: int = 2):
        self.spark, self.enough, self.fan_out = spark, enough, fan_out
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.paths: dict[str, str] = {}

    def _written(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        self.paths[name] = new_path(self.spark, name)
        dealt = rows.repartition(self.buckets, *_KEY)  # as buckets are dealt: a file each
        dealt.write.bucketBy(self.buckets, *_KEY).sortBy(*_KEY).option("path", self.paths[name]).saveAsTable(name)
        return name

    def _summed(self, names: list[str]) -> DataFrame:
        """Runs merged into one; read as files, since Spark 4.1 may sum a union of bucketed tables without bringing equal keys together."""
        rows = self.spark.read.schema("h1 long, h2 long, n long, largest long").parquet(*[self.paths[n] for n in names])
        return rows.groupBy(*_KEY).agg(F.sum("n").alias("n"), F.max("largest").alias("largest"))

    def add(self, lines: DataFrame) -> None:
        """Adds a batch of lines(h1, h2, doc_id) as a run, without the keys that some run has in enough documents and in a larger one."""
        new = lines.select(*_KEY, "doc_id").distinct().groupBy(*_KEY).agg(F.count("*").alias("n"), F.max("doc_id").alias("largest"))
        for name in (x for level in self.levels for x in level):
            run = self.spark.table(name).where(F.col("n") >= self.enough).select(*_KEY, F.col("largest").alias("known"))
            same = (new.h1 == run.h1) & (new.h2 == run.h2) & (run.known >= new.largest)
            new = new.join(run.hint("merge"), same, "left_anti")
        self._place(self._written(new), 0)

    def _place(self, name: str, level: int) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fan_out:
            merged, old = self._written(self._summed(self.levels[level])), self.levels[level]
            self.levels[level] = []
            self._forget(old)
            self._place(merged, level + 1)

    def _forget(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE {name}")

    def frequent(self) -> DataFrame:
        """(h1, h2, largest) of the keys found in enough documents, stored."""
        names = [x for level in self.levels for x in level]
        return stored(self._summed(names).where(F.col("n") >= self.enough).select(*_KEY, "largest"), "frequent-lines")

    def close(self) -> None:
        """Takes the runs' names out of the session's catalog; their files stay in the shared folder."""
        self._forget([x for level in self.levels for x in level])
        self.levels = []


def line_key(line: Column) -> Column:
    """A line without ASCII white space at its ends, A-Z lower-cased and no other letter."""
    bare = F.btrim(line, F.lit(_WHITE))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _UPPER.lower()))


def drop_lines(docs: DataFrame, min_length: int = 40, min_documents: int = 5, batches: int = 4, fan_out: int = 2) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_text): keys of at least `min_length` code points found in at least `min_documents` documents keep their lines in the largest doc_id holding them alone.

    docs(doc_id, text): lines end at LF only. Null and empty texts are one empty line; rows without doc_id are left out; rows
    of one doc_id are one document, whose rows lose their lines each by its own text; a key that its last document repeats keeps
    all its lines there; an empty table gives an empty result. Documents come to the runs in `batches` ranges of doc_id of about
    equal numbers, largest ids first.
    """
    spark = docs.sparkSession
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = texts.select("doc_id", F.xxhash64("text").alias("digest"), "text")  # rows of one doc_id are told apart by their texts
    edges = texts.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 1000)).first()[0] or []
    batch = sum((F.when(F.col("doc_id") < e, 1).otherwise(0) for e in edges), F.lit(0)).alias("batch")
    places = texts.select("doc_id", "digest", batch, F.posexplode(F.split("text", "\n")).alias("place", "line"))
    keys = places.where(F.length("line") >= min_length).withColumn("line", line_key(F.col("line"))).where(F.length("line") >= min_length)
    path = new_path(spark, "lines")
    keys.select("batch", "doc_id", "digest", "place", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2")).write.partitionBy("batch").parquet(path)
    lines = spark.read.schema("doc_id long, digest long, place int, h1 long, h2 long, batch int").parquet(path)

    runs = LineRuns(spark, min_documents, fan_out)
    for k in range(len(edges) + 1):
        runs.add(lines.where(F.col("batch") == k))
    frequent = runs.frequent()
    runs.close()
    gone = lines.join(broadcast_if_small(frequent), _KEY).where("doc_id <> largest").groupBy("doc_id", "digest").agg(F.collect_set("place").alias("gone"))
    gone = stored(gone, "gone")

    row = ["doc_id", "digest"]
    losing = broadcast_if_small(gone.select(*row))  # texts that lose nothing aren't shuffled
    hit = texts.select(*row, F.split("text", "\n").alias("lines")).join(losing, row, "left_semi").join(gone, row)  # the join keeps the split out of the function below
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone"), lambda i: F.get("lines", i))
    hit = hit.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_dropped"), F.array_join(kept, "\n").alias("kept_text"))
    feeds = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))
    rest = texts.join(losing, row, "left_anti").select("doc_id", (feeds + 1).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"), F.col("text").alias("kept_text"))
    return hit.union(rest)
