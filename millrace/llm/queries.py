"""The registered queries of the corpus operators and the SQL that checks them where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, embeddings, licenses, lines, mixing, packing, periodic, pii, quality, records, simhash, substrings, topk
from .shared import WORD, documents

OP7_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL),
good AS (SELECT vec_id, e FROM v WHERE e IS NOT NULL AND list_count(e) = len(e) AND len(list_filter(e, lambda x: isnan(x) OR isinf(x))) = 0
         AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach(node, to_id) AS (SELECT a, b FROM l UNION SELECT r.node, l.b FROM reach r JOIN l ON l.a = r.to_id)
SELECT v.vec_id, coalesce(d.n, 0) AS n_links, least(v.vec_id, coalesce(c.m, v.vec_id)) AS component_id,
       v.vec_id = least(v.vec_id, coalesce(c.m, v.vec_id)) AS kept
FROM v LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) d ON d.a = v.vec_id
LEFT JOIN (SELECT node, min(to_id) AS m FROM reach GROUP BY node) c ON c.node = v.vec_id
"""
OP9_SQL = """
WITH v AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor(1024 * x) AS BIGINT)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND list_count(embedding) = len(embedding)
           AND len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
             CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
      FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE doc_id IS NOT NULL),
places AS (SELECT doc_id, w, unnest(range(len(w))) AS i FROM d),
windows AS (SELECT doc_id, i, CASE WHEN i + 35 <= len(w) THEN array_to_string(w[i + 1 : i + 35], ' ') END AS t, w[i + 1] AS word FROM places),
counted AS (SELECT *, CASE WHEN t IS NULL THEN 0 ELSE CAST(count(*) OVER (PARTITION BY t) > 1 AS INTEGER) END AS again FROM windows),
covered AS (SELECT *, max(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) = 1 AS gone FROM counted),
kept AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS t FROM covered GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""


def _rows(rows: list[tuple]) -> str:
    """VALUES of texts and numbers."""
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


OP10_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
           FROM documents WHERE doc_id IS NOT NULL),
base AS (SELECT string_split(phrase, ' ') AS p, label FROM (VALUES ('cc by', 'cc-by'), ('general public license', 'gpl'), ('all rights reserved', 'reserved')) t(phrase, label)),
forms AS (SELECT string_split(body, ' ') AS tw, string_split(k, ' ') AS p, label, key_at FROM (VALUES {_rows([(" ".join(t.words), t.key, t.label, t.key_at) for t in licenses.TEMPLATES])}) t(body, k, label, key_at)),
places AS (SELECT doc_id, w, unnest(range(len(w))) AS i FROM d),
b AS (SELECT doc_id, i, label FROM places JOIN base ON w[i + 1] = p[1] AND w[i + 1 : i + len(p)] = p),
f AS (SELECT doc_id, label, len(list_filter(range(len(tw)), lambda j: i - key_at + j >= 0 AND w[i - key_at + j + 1] = tw[j + 1])) / len(tw) AS share
      FROM places JOIN forms ON w[i + 1] = p[1] AND w[i + 1 : i + len(p)] = p),
bs AS (SELECT doc_id, count(*) AS n, min(i) AS low, max(i) AS high, list_distinct(list(label)) AS labels FROM b GROUP BY doc_id),
fs AS (SELECT doc_id, max(share) AS share, list_distinct(list(label)) AS labels FROM f GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, low AS first_word, high AS last_word,
       array_to_string(list_sort(coalesce(bs.labels, [])), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(bs.labels, []), coalesce(fs.labels, [])))), ',') AS labels,
       CASE WHEN n > 0 THEN 1.0 ELSE coalesce(share, 0.0) END AS score
FROM d LEFT JOIN bs ON bs.doc_id = d.doc_id LEFT JOIN fs ON fs.doc_id = d.doc_id
"""


OP11_SQL = r"""
WITH c AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS crc),
o AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
             xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                             lambda x, b: xor(x >> 8, crc[(xor(x, b) & 255) + 1])), 4294967295) AS h
      FROM documents, c WHERE doc_id IS NOT NULL),
g AS (SELECT r, doc_id, w, h, len(w) AS n, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM o),
p AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM g),
places AS (SELECT r, n, unnest(range(n)) AS i, CASE WHEN h % 10 = 0 THEN a END AS a, p FROM p),
moved AS (SELECT r, n, i, CASE WHEN a IS NULL OR i < a THEN i ELSE a + (i - a) % p END AS source FROM places),
given AS (SELECT r, unnest(range(n)) AS source, unnest(w) AS word FROM p),
words AS (SELECT m.r, m.n, m.i, word FROM moved m JOIN given USING (r, source)),
d AS (SELECT r, list(word ORDER BY i) AS w FROM words GROUP BY r),
grams AS (SELECT r, w, unnest(range(len(w) - 15)) AS i FROM d WHERE len(w) > 16),
keyed AS (SELECT r, i, hash(w[i + 1 : i + 16]) AS k, CASE WHEN i > 0 THEN w[i] END AS before FROM grams),
again AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY r, k) AS n FROM keyed) WHERE n > 1),
near AS (SELECT x.r, x.i, y.i - x.i AS q FROM again x JOIN again y ON x.r = y.r AND x.k = y.k AND x.i < y.i AND x.before IS DISTINCT FROM y.before),
long AS (SELECT r, i, q, coalesce(list_position(list_transform(list_zip(w[i + 1 :], w[i + q + 1 :]), lambda z: z[1] IS NOT DISTINCT FROM z[2]), false) - 1, len(w) - i - q) AS common
         FROM near JOIN d USING (r)),
runs AS (SELECT r, i AS start, common + q AS length, min(q) AS period FROM long WHERE common >= 2 * q AND common + q >= 24 GROUP BY ALL),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY CAST(length AS DOUBLE) / period DESC, start, period) AS k FROM runs) WHERE k = 1),
listed AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS t FROM runs GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
       sha256(coalesce(listed.t, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
FROM p LEFT JOIN listed USING (r) LEFT JOIN best USING (r) LEFT JOIN kept USING (r)
"""
OP12_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS t FROM d),
w AS (SELECT lang, regexp_extract_all(t, '[^\x20\x09]+') AS w FROM pieces),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
spans AS (SELECT lang, 1 AS k, w[i] AS phrase FROM places UNION ALL SELECT lang, 2, w[i] || ' ' || w[i + 1] FROM places WHERE i + 1 <= len(w)
          UNION ALL SELECT lang, 3, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FROM places WHERE i + 2 <= len(w)),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM spans GROUP BY ALL),
sizes AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
cut AS (SELECT *, unnest(range(1, k)) AS j FROM cand),
parts AS MATERIALIZED (SELECT lang, k, phrase, a, j, array_to_string(w[1 : j], ' ') AS one, array_to_string(w[j + 1 :], ' ') AS two FROM cut),
cuts AS (SELECT c.*, x.f AS l, y.f AS r, CAST((1000000 * CAST(a AS HUGEINT) * a) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
         FROM parts c JOIN f x ON x.lang = c.lang AND x.phrase = c.one JOIN f y ON y.lang = c.lang AND y.phrase = c.two),
weakest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS o FROM cuts) WHERE o = 1),
inner_ AS (SELECT lang, array_to_string(w[1 : 2], ' ') AS phrase, a FROM cand WHERE k = 3 UNION ALL SELECT lang, array_to_string(w[2 : 3], ' '), a FROM cand WHERE k = 3),
longer AS (SELECT lang, phrase, max(a) AS most FROM inner_ GROUP BY ALL),
ranked AS (SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) AS rank
           FROM weakest s LEFT JOIN longer g ON g.lang = s.lang AND g.phrase = s.phrase WHERE most IS NULL OR 100 * most < 50 * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000
"""
OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS w FROM documents WHERE doc_id IS NOT NULL),
lines AS (SELECT r, doc_id, unnest(range(len(w))) AS i, unnest(w) AS line FROM d),
keyed AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
often AS (SELECT k, max(doc_id) AS largest FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
judged AS (SELECT r, doc_id, i, line, coalesce(doc_id <> largest, false) AS gone FROM keyed LEFT JOIN often USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY r, doc_id
"""


#: A production job takes its key from a secret store.
PII_KEY = "millrace example key"


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_groups(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(documents(spark, sf_dir), PII_KEY, count="n_replaced").select("doc_id", "text", "n_replaced")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end_id=2, limit=1024)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model).select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, draws = mixing.mix(documents(spark, sf_dir))
    taken = draws.groupBy("key").agg(F.sum("words").alias("taken"))
    return docs.join(taken, "key", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def op6_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.read_records(records.write_records(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=1))


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.drop_repeats(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id % 100 = 0", k=10)


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def _planted(docs: DataFrame) -> DataFrame:
    """docs with a periodic end, word by word, in the tenth of the texts whose doc_id's CRC-32 is a multiple of 10."""
    words = docs.withColumn("h", F.crc32(F.col("doc_id").cast("string").cast("binary"))).withColumn("w", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))))
    sized = words.withColumns({"g": F.expr("h div 10"), "n": F.coalesce(F.size("w"), F.lit(-1))}).withColumn("a", F.expr("cast(if(n > 0, g % n, 0) as int)")).withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    tail = F.expr("concat(slice(w, 1, a), slice(flatten(array_repeat(slice(w, a + 1, p), cast(ceil((n - a) / p) as int))), 1, n - a))")
    return sized.select("doc_id", F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), F.array_join(tail, " ")).otherwise(F.col("text")).alias("text"))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find_runs(_planted(documents(spark, sf_dir)))
    better = "case when x.length * y.period > y.length * x.period then -1 when x.length * y.period < y.length * x.period then 1 when x.start <> y.start then sign(x.start - y.start) else sign(x.period - y.period) end"
    best = found.withColumn("best", F.get(F.expr(f"array_sort(runs, (x, y) -> cast({better} as int))"), F.lit(0)))
    listed = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")),
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir))


def op13_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.drop_lines(documents(spark, sf_dir))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op7_embeddings": OP7_SQL, "op8_substrings": OP8_SQL, "op9_topk": OP9_SQL, "op10_licenses": OP10_SQL, "op11_runs": OP11_SQL, "op12_collocations": OP12_SQL, "op13_lines": OP13_SQL}
