"""Tables of the evaluation domain, derived from whole driver tables: in Spark, and as SQL for the checks.

A document's lines stand for the fields' values of a run, events for jobs of a load test and for answers of a model.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rules import NAMES

#: Phrases that rules have something to say about; the documents have none.
PHRASES = [
    "Project budget not to exceed $50,000", "Minimum of three (3) references required", "Submit electronically via portal", "Section 4",
    "ISO 9001 testing and validation", "70% minimum threshold, 30 points pricing", "General liability insurance of $2,000,000", "Not specified",
    "Contact procurement@example.org", "Hosted in Canada with encryption", "Vendor presentation for shortlisted vendors",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; those of a few files that Spark can't split are dealt out to all cores, as text work is costly."""
    docs, cores = table(spark, sf_dir, "documents"), spark.sparkContext.defaultParallelism
    return docs if docs.rdd.getNumPartitions() > 2 * cores else docs.repartition(2 * cores, "doc_id")


def _pick(names: list[str], index):
    return F.element_at(F.array(*[F.lit(n) for n in names]), (index + 1).cast("int"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = documents(spark, sf_dir).select("doc_id", F.split("text", "\n").alias("parts"))
    pairs = F.arrays_zip(F.col("parts").alias("line"), F.slice("parts", 2, F.greatest(F.lit(1), F.size("parts"))).alias("next_line"))
    placed = parts.select("doc_id", F.posexplode(pairs).alias("line_no", "p"))
    return placed.select("doc_id", F.col("line_no").cast("long").alias("line_no"), "p.line", "p.next_line")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rfp_no, line_no, model, field, expected, predicted)."""
    n = F.col("doc_id") + F.col("line_no")
    expected = F.when(n % 7 == 0, None).when(n % 11 == 0, "Not Specified").otherwise(F.col("line"))
    kind = F.col("line_no") % 4
    predicted = F.when(n % 5 == 0, "N/A.").when(kind == 0, F.col("line")).when(kind == 1, F.col("next_line")).otherwise(F.concat(F.lit("  "), "line", F.lit(" .")))
    model = F.concat(F.lit("model"), (F.col("line_no") % 3).cast("string"))
    return lines(spark, sf_dir).select(F.col("doc_id").alias("rfp_no"), "line_no", model.alias("model"), _pick(NAMES, F.floor(F.col("line_no") / 3) % 24).alias("field"), expected.alias("expected"), predicted.alias("predicted"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rfp_no, line_no, field, value, excerpt): more than four distinct values and repeated ones for a document."""
    at = (F.col("line_no") * F.col("line_no") + F.col("doc_id")) % len(PHRASES)
    return lines(spark, sf_dir).select(F.col("doc_id").alias("rfp_no"), "line_no", _pick(NAMES, F.col("doc_id") % 24).alias("field"), _pick(PHRASES, at).alias("value"), F.col("line").alias("excerpt"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model, concurrency, job_id, success, latency_s, ts)."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("model"), (1 + F.col("user_id") % 15).alias("concurrency"), F.col("event_id").alias("job_id"), (F.col("event_id") % 10 != 0).alias("success"), F.col("value").alias("latency_s"), "ts")


def responses(spark: SparkSession, sf_dir: str, kind=None) -> DataFrame:
    """(rfp_no, model, event_id, props, raw): answers plain, fenced, after thinking, cut off, in a list, in prose, by kind modulo 6."""
    k, p = (F.col("event_id") if kind is None else kind) % 6, F.col("props")
    raw = (
        F.when(k == 0, p).when(k == 1, F.concat(F.lit("```json\n"), p, F.lit("\n```"))).when(k == 2, F.concat(F.lit("<think>x {\n}</think>"), p))
        .when(k == 3, F.substring(p, F.lit(1), F.length(p) - 1)).when(k == 4, F.concat(F.lit("["), p, F.lit("]"))).otherwise(F.concat(F.lit("Answer: "), p, F.lit(" done")))
    )
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("rfp_no"), F.col("event_type").alias("model"), "event_id", "props", raw.alias("raw"))


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, w): each text is cut into words once, whatever the number of values taken from it."""
    return documents(spark, sf_dir).select("doc_id", F.split("text", " ").alias("w"))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rfp, field, expected): 24 fields of every document, three words from each 24th of its whole text; some null, some that say nothing."""
    said = lambda i: F.when((F.col("doc_id") + i) % 7 == 0, None).when((F.col("doc_id") + i) % 11 == 0, "n/a").otherwise(_words(i, 0))
    each = _split(spark, sf_dir).select("doc_id", F.posexplode(F.array(*[said(i) for i in range(len(NAMES))])).alias("i", "value"))
    return each.select(F.concat(F.lit("rfp"), "doc_id", F.lit(".txt")).alias("rfp"), _pick(NAMES, F.col("i")).alias("field"), F.col("value").alias("expected"))


def _words(i: int, shift: int | Column) -> Column:
    """Three words of a whole text, from its i-th part on."""
    return F.concat_ws(" ", F.slice("w", (F.floor(F.size("w") * i / len(NAMES)) + 1 + shift).cast("int"), 3))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rfp, model, success, ..., output map): two models' answers to every document, each without some fields, and what was measured."""
    d, n = F.col("doc_id"), F.col("m")
    given = lambda i: F.when((d + i + n) % 5 != 0, F.struct(F.lit(NAMES[i]).alias("key"), _words(i, n if i % 2 else 0).alias("value")))
    each = _split(spark, sf_dir).select("doc_id", "w", F.explode(F.array(F.lit(0), F.lit(1))).alias("m"))
    output = F.map_from_entries(F.array_compact(F.array(*[given(i) for i in range(len(NAMES))])))
    return each.select(
        F.concat(F.lit("rfp"), "doc_id", F.lit(".txt")).alias("rfp"), F.concat(F.lit("model"), n.cast("string")).alias("model"), (d % 3 != 0).alias("success"),
        (d % 12).cast("int").alias("chunks_total"), (d % 5).cast("int").alias("chunks_successful"), F.when(d % 4 != 0, d / 8.0).alias("time_seconds"),
        F.when(d % 9 != 0, (d % 100) / 4.0).alias("raw_json_valid_rate"), ((d + n) % 100 / 2.0).alias("json_valid_after_cleanup_rate"),
        (d * 3).alias("prompt_tokens"), (d + n).alias("completion_tokens"), (d * 4 + n).alias("total_tokens"), output.alias("output"),
    )


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _listed(names: list[str]) -> str:
    return "[" + ", ".join(map(_quoted, names)) + "]"


SQL = {
    "lines": """lines AS (SELECT doc_id, line_no, parts[line_no + 1] AS line, parts[line_no + 2] AS next_line
  FROM (SELECT doc_id, parts, unnest(range(len(parts))) AS line_no FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)))""",
    "cells": f"""cells AS (SELECT doc_id AS rfp_no, line_no, 'model' || (line_no % 3) AS model, {_listed(NAMES)}[(line_no // 3) % 24 + 1] AS field,
  CASE WHEN (doc_id + line_no) % 7 = 0 THEN NULL WHEN (doc_id + line_no) % 11 = 0 THEN 'Not Specified' ELSE line END AS expected,
  CASE WHEN (doc_id + line_no) % 5 = 0 THEN 'N/A.' WHEN line_no % 4 = 0 THEN line WHEN line_no % 4 = 1 THEN next_line ELSE '  ' || line || ' .' END AS predicted FROM lines)""",
    "candidates": f"""candidates AS (SELECT doc_id AS rfp_no, line_no, {_listed(NAMES)}[doc_id % 24 + 1] AS field,
  {_listed(PHRASES)}[(line_no * line_no + doc_id) % {len(PHRASES)} + 1] AS value, line AS excerpt FROM lines)""",
    "jobs": "jobs AS (SELECT event_type AS model, 1 + user_id % 15 AS concurrency, event_id AS job_id, event_id % 10 <> 0 AS success, value AS latency_s, ts FROM events)",
    "truth": f"""truth AS (SELECT 'rfp' || doc_id || '.txt' AS rfp, {_listed(NAMES)}[i + 1] AS field,
  CASE WHEN (doc_id + i) % 7 = 0 THEN NULL WHEN (doc_id + i) % 11 = 0 THEN 'n/a' ELSE array_to_string(w[len(w) * i // 24 + 1 : len(w) * i // 24 + 3], ' ') END AS expected
  FROM (SELECT doc_id, string_split(text, ' ') AS w, unnest(range({len(NAMES)})) AS i FROM documents))""",
    "runs": f"""answers AS (SELECT doc_id, m, 'rfp' || doc_id || '.txt' AS rfp, 'model' || m AS model, i, {_listed(NAMES)}[i + 1] AS field, (doc_id + i + m) % 5 <> 0 AS given,
  array_to_string(w[len(w) * i // 24 + 1 + m * (i % 2) : len(w) * i // 24 + 3 + m * (i % 2)], ' ') AS value
  FROM (SELECT doc_id, w, m, unnest(range({len(NAMES)})) AS i FROM (SELECT doc_id, string_split(text, ' ') AS w, unnest([0, 1]) AS m FROM documents))),
runs AS (SELECT DISTINCT rfp, model, doc_id % 3 <> 0 AS success, doc_id % 12 AS chunks_total, doc_id % 5 AS chunks_successful, CASE WHEN doc_id % 4 <> 0 THEN doc_id / 8.0 END AS time_seconds,
  CASE WHEN doc_id % 9 <> 0 THEN (doc_id % 100) / 4.0 END AS raw_json_valid_rate, (doc_id + m) % 100 / 2.0 AS json_valid_after_cleanup_rate,
  doc_id * 3 AS prompt_tokens, doc_id + m AS completion_tokens, doc_id * 4 + m AS total_tokens FROM answers)""",
    "responses": """responses AS (SELECT user_id AS rfp_no, event_type AS model, event_id, CASE event_id % 6 WHEN 0 THEN props
  WHEN 1 THEN '```json' || chr(10) || props || chr(10) || '```' WHEN 2 THEN '<think>x {' || chr(10) || '}</think>' || props
  WHEN 3 THEN substring(props, 1, length(props) - 1) WHEN 4 THEN '[' || props || ']' ELSE 'Answer: ' || props || ' done' END AS raw FROM events)""",
}
