"""The registered queries of the evaluation engine; each runs over whole driver tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, udfs
from ..operators import capacity, chunking, dashboard, extract, rules, score
from ..shared import new_path, stored
from ..sources import files, sinks
from ..streaming import jobs as job_stream
from . import fixtures
from .sql import ORACLES

KEYS = ["rfp_no", "model"]
RATES = ["field_accuracy_pct", "avg_field_similarity_pct", "completeness_pct", "hallucination_rate_pct", "wrong_value_rate_pct"]
_long = lambda c: F.col(c).cast("long").alias(c)


def _runs(spark: SparkSession, sf: str, ratio: bool = True) -> DataFrame:
    return score.run_scores(score.field_scores(fixtures.cells(spark, sf), ratio=ratio), KEYS, "line_no")


def _summary(spark: SparkSession, sf: str, ratio: bool = True) -> DataFrame:
    return score.model_summary(_runs(spark, sf, ratio))


def _levels(spark: SparkSession, sf: str) -> DataFrame:
    return capacity.level_summary(fixtures.jobs(spark, sf))


def _top(spark: SparkSession, sf: str) -> DataFrame:
    return extract.first_candidates(fixtures.candidates(spark, sf), ["rfp_no", "field"], ["line_no"]).withColumn("idx", F.col("idx").cast("long"))


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return fixtures.documents(spark, sf)


def _models(spark: SparkSession, sf: str) -> DataFrame:
    return fixtures.table(spark, sf, "events").select(F.col("event_type").alias("model")).distinct()


def q_model_quality(spark: SparkSession, sf: str, ratio: bool = True) -> DataFrame:
    return _summary(spark, sf, ratio)


def q_run_scores(spark: SparkSession, sf: str, ratio: bool = True) -> DataFrame:
    return _runs(spark, sf, ratio)


def q_model_summary_ordered(spark: SparkSession, sf: str, ratio: bool = True) -> DataFrame:
    from pyspark.sql import Window

    order = Window.orderBy(score.model_rank(F.col("model")), "model")
    return _summary(spark, sf, ratio).select("model", "rfps_evaluated", "field_accuracy_pct", F.row_number().over(order).alias("place"))


def q_missing(spark: SparkSession, sf: str) -> DataFrame:
    c, p, e = fixtures.cells(spark, sf), F.col("predicted"), F.col("expected")
    return c.groupBy("model").agg(F.count("*").alias("cells"), F.count_if(text.clean_value(p).isNull()).alias("missing_extract"), F.count_if(text.is_missing(p)).alias("missing_score"), F.count_if(text.is_missing(e)).alias("missing_expected"))


def q_clean_values(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("predicted")
    return fixtures.cells(spark, sf).select("rfp_no", "line_no", text.clean_value(p).alias("cleaned"), text.normalize_text(p).alias("normal"))


def q_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return fixtures.lines(spark, sf).select("doc_id", "line_no", udfs.normalized(F.col("line")).alias("normal"))


def q_token_f1(spark: SparkSession, sf: str) -> DataFrame:
    ready = fixtures.cells(spark, sf).select("rfp_no", "line_no", *[text.tokens(udfs.normalized(F.col(c))).alias(c) for c in ("expected", "predicted")])
    return ready.select("rfp_no", "line_no", F.round(text.token_f1(F.col("expected"), F.col("predicted")), 4).alias("token_f1"))


def q_field_similarity(spark: SparkSession, sf: str) -> DataFrame:
    return score.field_scores(fixtures.cells(spark, sf)).select("rfp_no", "line_no", F.round("similarity", 4).alias("similarity"), "is_correct")


def q_seq_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return fixtures.lines(spark, sf).select("doc_id", "line_no", F.round(udfs.seq_ratio("line", "next_line"), 4).alias("ratio"))


def q_emails(spark: SparkSession, sf: str) -> DataFrame:
    return _documents(spark, sf).select("doc_id", F.array_join(F.array_sort(text.emails(F.col("text"))), " ").alias("emails"))


def q_numbers(spark: SparkSession, sf: str) -> DataFrame:
    found = _documents(spark, sf).select("doc_id", text.numbers(udfs.normalized(F.col("text"))).alias("n"))
    return found.select("doc_id", F.size("n").cast("long").alias("n_numbers"), F.get("n", F.lit(0)).alias("first_number"))


def q_keyword_tokens(spark: SparkSession, sf: str) -> DataFrame:
    found = _documents(spark, sf).select("doc_id", text.keyword_tokens(F.col("text")).alias("k"))
    return found.select("doc_id", F.size("k").cast("long").alias("n_keywords"), F.md5(F.array_join(F.array_sort("k"), " ")).alias("keywords"))


def q_chunks(spark: SparkSession, sf: str) -> DataFrame:
    found = chunking.chunks(_documents(spark, sf))
    return found.select("doc_id", _long("chunk_no"), F.length("chunk_text").cast("long").alias("n_chars"), F.md5("chunk_text").alias("digest"))


def q_chunk_stats(spark: SparkSession, sf: str) -> DataFrame:
    found = chunking.chunks(_documents(spark, sf), keep=("source",))
    return found.groupBy("source").agg(F.count("*").alias("chunks"), F.sum(F.length("chunk_text")).alias("chars"))


def q_split_failed(spark: SparkSession, sf: str) -> DataFrame:
    found = _documents(spark, sf).select("doc_id", F.posexplode(chunking.halves(F.col("text"))).alias("part_no", "half"))
    return found.select("doc_id", _long("part_no"), F.md5("half").alias("digest"))


def q_recovery(spark: SparkSession, sf: str) -> DataFrame:
    read = lambda parts: parts.withColumn("cleaned_ok", (F.col("doc_id") + F.col("chunk_no")) % 3 != 0)
    parts = chunking.chunks(_documents(spark, sf)).select("doc_id", _long("chunk_no"), "chunk_text")
    tried = extract.with_recovery(parts, read, stored)
    return tried.select("doc_id", "chunk_no", _long("part_no"), F.length("chunk_text").cast("long").alias("n_chars"))


def q_excerpts(spark: SparkSession, sf: str) -> DataFrame:
    field = F.element_at(F.array(*[F.lit(n) for n in rules.NAMES]), (F.col("doc_id") % 24 + 1).cast("int"))
    last = F.element_at(F.split("text", "\n"), -1)
    return _documents(spark, sf).select("doc_id", F.md5(text.source_excerpt(F.col("text"), field, last)).alias("digest"))


def q_heading_reference(spark: SparkSession, sf: str) -> DataFrame:
    line = F.col("line")
    return fixtures.lines(spark, sf).select("doc_id", "line_no", text.heading_only(line).alias("heading_only"), text.reference_count(line).alias("reference_count"))


def q_json_valid(spark: SparkSession, sf: str) -> DataFrame:
    return extract.read_answers(fixtures.responses(spark, sf)).select("event_id", "raw_ok", "cleaned_ok")


def q_json_entries(spark: SparkSession, sf: str) -> DataFrame:
    found = extract.read_answers(fixtures.responses(spark, sf)).select("event_id", F.explode("entries").alias("e"))
    return found.select("event_id", "e.pos", "e.key", "e.value")


def q_run_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Every third event is a chunk's first answer, the two after it are those to its halves."""
    n = F.col("event_id")
    e = fixtures.responses(spark, sf, n + F.floor(n / 4))
    run = F.floor(n / 30)
    used = e.select(run.alias("rfp"), F.concat(F.lit("m"), (run % 3).cast("string")).alias("model"), F.floor(n / 3).alias("chunk_no"), (n % 3).cast("int").alias("part_no"), "raw", F.length("props").cast("long").alias("prompt_tokens"), (n % 100).alias("completion_tokens"), (F.length("props") + n % 100).alias("total_tokens"))
    return extract.run_metrics(extract.read_answers(used), used.where("part_no = 0").select("rfp", "model", "chunk_no"), ["rfp", "model"])


def q_candidates_top4(spark: SparkSession, sf: str) -> DataFrame:
    return _top(spark, sf).select("rfp_no", "field", "idx", "value")


def _scores(spark: SparkSession, sf: str, rule_set: str) -> DataFrame:
    found = _top(spark, sf).withColumn("value", text.clean_value(F.col("value")))
    return found.select("rfp_no", "field", "idx", rules.candidate_score(F.col("field"), F.col("value"), F.col("excerpt"), rule_set).alias("score"))


def q_rule_score_v5(spark: SparkSession, sf: str) -> DataFrame:
    return _scores(spark, sf, "v5")


def q_rule_score_capacity(spark: SparkSession, sf: str) -> DataFrame:
    return _scores(spark, sf, "capacity")


def q_select_final(spark: SparkSession, sf: str) -> DataFrame:
    best = extract.best_candidates(_top(spark, sf), ["rfp_no"])
    runs = _documents(spark, sf).select(F.col("doc_id").alias("rfp_no"))
    return extract.final_values(best, runs, ["rfp_no"]).select("rfp_no", "field", "value")


def q_extract_stub(spark: SparkSession, sf: str) -> DataFrame:
    """The whole extraction with the offline backend: every document, one model."""
    docs = _documents(spark, sf).select(F.col("doc_id").alias("rfp"), "text")
    final, _ = extract.extract_documents(docs, ["stub"], extract.StubBackend(), stored)
    return extract.answers_as_json(final, ["rfp", "model"])


def q_extract_logged(spark: SparkSession, sf: str) -> DataFrame:
    """The whole extraction once more from the log of its answers."""
    docs, log = _documents(spark, sf).select(F.col("doc_id").alias("rfp"), "text"), extract.answer_log(spark, new_path(spark, "answers"))
    for backend in (extract.StubBackend(), extract.NoBackend()):
        final, _ = extract.extract_documents(docs, ["stub"], backend, stored, log=log)
    return extract.answers_as_json(final, ["rfp", "model"])


def q_upsert(spark: SparkSession, sf: str) -> DataFrame:
    docs = _documents(spark, sf)
    old = docs.groupBy("source").agg(F.count("*").alias("n"))
    new = docs.join(fixtures.table(spark, sf, "labels").select("doc_id"), "doc_id").groupBy("source").agg(F.count("*").alias("n"))
    return score.upsert(old, new, ["source"])


def q_run_matrix(spark: SparkSession, sf: str) -> DataFrame:
    models = [r[0] for r in _models(spark, sf).orderBy("model").collect()]  # the registry of models is small
    return extract.run_matrix(_documents(spark, sf).select("source"), models).groupBy("source", "model").agg(F.count("*").alias("runs"))


def q_capacity_levels(spark: SparkSession, sf: str) -> DataFrame:
    return _levels(spark, sf)


def q_capacity_overview(spark: SparkSession, sf: str) -> DataFrame:
    return capacity.overview(_levels(spark, sf))


def q_peak_per_model(spark: SparkSession, sf: str) -> DataFrame:
    return capacity.peak_levels(_levels(spark, sf)).select("model", "concurrency", "throughput_requests_per_min")


def q_extreme_levels(spark: SparkSession, sf: str) -> DataFrame:
    """The levels of largest and smallest throughput; the first by model and concurrency on ties."""
    from pyspark.sql import Window

    placed = _levels(spark, sf).withColumn("place", F.row_number().over(Window.orderBy("model", "concurrency")))
    rows = [dashboard.extreme_row(placed, "throughput_requests_per_min", "place", most).select(F.lit(kind).alias("kind"), "model", "concurrency", F.col("throughput_requests_per_min").alias("value")) for kind, most in (("max", True), ("min", False))]
    return rows[0].union(rows[1])


def q_resume_plan(spark: SparkSession, sf: str) -> DataFrame:
    levels = _levels(spark, sf)
    return capacity.left_to_run(levels.select("model", "concurrency"), levels.where("success_rate_pct >= 90"))


def q_completed_levels(spark: SparkSession, sf: str) -> DataFrame:
    done = capacity.completed_levels(_levels(spark, sf).where("success_rate_pct >= 90"))
    return done.select("model", F.array_join(F.transform("completed", lambda x: x.cast("string")), ",").alias("completed"))


def q_job_plan(spark: SparkSession, sf: str) -> DataFrame:
    plan = capacity.job_plan(_levels(spark, sf).select("model", "concurrency"), _documents(spark, sf))
    return plan.select("model", "concurrency", _long("job_id"), "doc_no")


def q_gauges(spark: SparkSession, sf: str, ratio: bool = True) -> DataFrame:
    return dashboard.gauges(_runs(spark, sf, ratio), RATES, "rfp_no")


def q_melt_quality(spark: SparkSession, sf: str, ratio: bool = True) -> DataFrame:
    return dashboard.melted(_summary(spark, sf, ratio), ["model"], RATES[:3])


def q_detail_by_rfp(spark: SparkSession, sf: str, ratio: bool = True) -> DataFrame:
    docs = dashboard.chosen(_documents(spark, sf), "lang", ["en"]).select(F.col("doc_id").alias("rfp_no"), "source")
    return dashboard.chosen(_runs(spark, sf, ratio), "model", ["model0", "model2"]).join(docs, "rfp_no").select("model", "source", "rfp_no", "completeness_pct")


def q_natural_order(spark: SparkSession, sf: str) -> DataFrame:
    return dashboard.natural_order(_documents(spark, sf), "source")


def q_model_union(spark: SparkSession, sf: str) -> DataFrame:
    return dashboard.model_union([_models(spark, sf), _documents(spark, sf).select(F.col("source").alias("model"))])


def q_colours(spark: SparkSession, sf: str) -> DataFrame:
    return dashboard.colours(_models(spark, sf), 4)


def q_chat_prompts(spark: SparkSession, sf: str) -> DataFrame:
    return extract.chat_prompts(fixtures.table(spark, sf, "conversations")).select("conv_id", F.md5("prompt").alias("digest"))


def q_prompts(spark: SparkSession, sf: str) -> DataFrame:
    found = chunking.chunks(_documents(spark, sf))
    return found.select("doc_id", _long("chunk_no"), F.md5(extract.prompt(F.col("chunk_text"))).alias("digest"))


def q_json_payload(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.capacity_payload(_levels(spark, sf), F.struct(F.lit("log").alias("test_type")))


def q_windowed_throughput(spark: SparkSession, sf: str) -> DataFrame:
    found = job_stream.windowed_throughput(fixtures.table(spark, sf, "events"))
    return found.select("model", "start", "jobs", F.round("mean_latency", 4).alias("mean_latency"))


def q_text_files(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as a file of its own, every tenth one empty, and all files read back."""
    folder = new_path(spark, "texts")
    text_ = F.when(F.col("doc_id") % 10 != 0, F.col("text")).otherwise("")
    sinks.save_texts(_documents(spark, sf).select(F.concat(F.lit("rfp"), "doc_id", F.lit(".txt")).alias("rfp"), text_.alias("text")), folder)
    return files.text_files(spark, folder).select("rfp", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest"))


def q_results_file(spark: SparkSession, sf: str) -> DataFrame:
    """All runs as results files, merged with those of model1 that have other figures, written and read back: one row a field."""
    first, second = new_path(spark, "results"), new_path(spark, "results")
    runs = fixtures.runs(spark, sf)
    sinks.save_results(runs, first)
    again = runs.where("model = 'model1'").withColumn("total_tokens", F.col("total_tokens") + 1)
    sinks.save_results(score.upsert(files.benchmark_runs(spark, first), again, ["rfp", "model"]), second)
    read = files.benchmark_runs(spark, second)
    return extract.field_table(read, ["rfp", "model", "success", "total_tokens", "time_seconds"]).withColumn("field_id", F.col("field_id").cast("long"))


def q_runs_table(spark: SparkSession, sf: str) -> DataFrame:
    """The runs as a committed table whose runs of model1 are replaced; the replacement is tried twice under one token."""
    folder = new_path(spark, "runs")
    runs = fixtures.runs(spark, sf).drop("output")
    sinks.save_runs(runs, folder)
    for cost in (0, 5):
        sinks.save_runs(runs.where("model = 'model1'").withColumn("prompt_tokens", F.lit(cost).cast("long")), folder, token="model1")
    return sinks.run_store(spark, folder).read().select("rfp", "model", "prompt_tokens", "completion_tokens", "success")


def q_truth_file(spark: SparkSession, sf: str) -> DataFrame:
    """The expected values as JSON files, read back."""
    path = new_path(spark, "truth")
    sinks.save_truth(fixtures.truth(spark, sf), path)
    return files.ground_truth(spark, path)


def _run_rows(spark: SparkSession, sf: str, ratio: bool = True) -> DataFrame:
    return score.scored_runs(fixtures.truth(spark, sf), fixtures.runs(spark, sf), ratio)


def q_run_rows(spark: SparkSession, sf: str, ratio: bool = True) -> DataFrame:
    """The run table with all its columns, from expected values and runs."""
    return _run_rows(spark, sf, ratio)


def q_model_means(spark: SparkSession, sf: str, ratio: bool = True) -> DataFrame:
    """All nine means of each model."""
    return score.model_summary(_run_rows(spark, sf, ratio))


def q_expected_cells(spark: SparkSession, sf: str) -> DataFrame:
    predictions = fixtures.runs(spark, sf).select("rfp", "model", F.explode("output").alias("field", "value"))
    return score.expected_cells(fixtures.truth(spark, sf), predictions)


def q_scores_csv(spark: SparkSession, sf: str) -> DataFrame:
    """The run table as a CSV file, read back with its schema; the file must be there and have rows."""
    path = new_path(spark, "scores")
    rows = _run_rows(spark, sf, ratio=False)
    sinks.save_csv(rows, path, rows.columns)
    return files.csv_rows(spark, path, files.RUN_SCORES, must_exist=True).select("rfp", "model", *RATES, "fields_correct", "latency_seconds", "total_tokens")


def q_capacity_files(spark: SparkSession, sf: str) -> DataFrame:
    """Levels appended to a CSV file model by model, read where the JSON payload is broken, next to those of the whole payload."""
    csv, whole, broken = (new_path(spark, n) for n in ("levels", "payload", "broken"))
    levels = stored(_levels(spark, sf))
    columns = [c.split()[0] for c in files.CAPACITY.split(", ")]
    for r in levels.select("model").distinct().orderBy("model").collect():  # the registry of models is small
        sinks.save_csv(levels.where(F.col("model") == r[0]), csv, columns, "append", single=True)
    payload = sinks.capacity_payload(levels, F.struct(F.lit("log").alias("test_type")))
    payload.write.text(whole)
    payload.select(F.substring("json", F.lit(1), F.length("json") - 10)).write.text(broken)
    rows = [files.capacity_rows(spark, json, csv).select(F.lit(kind).alias("kind"), *columns) for kind, json in (("json", whole), ("csv", broken))]
    return rows[0].union(rows[1])


def q_report_tables(spark: SparkSession, sf: str) -> DataFrame:
    """The three tables of the report pages, written and read as CSV: rows and models of each."""
    rows = _run_rows(spark, sf, ratio=False)
    made = {"scores": (rows, files.RUN_SCORES), "summary": (score.model_summary(rows), files.MODEL_SUMMARY), "capacity": (_levels(spark, sf), files.CAPACITY)}
    paths = {name: (new_path(spark, name), schema) for name, (_, schema) in made.items()}
    for name, (df, schema) in made.items():
        sinks.save_csv(df, paths[name][0], [c.split()[0] for c in schema.split(", ")], single=name != "scores")
    read = [df.groupBy(F.lit(name).alias("name")).agg(F.count("*").alias("n"), F.count_distinct("model").alias("models")) for name, df in files.report_tables(spark, paths).items()]
    return read[0].union(read[1]).union(read[2])


def q_number_texts(spark: SparkSession, sf: str) -> DataFrame:
    e = fixtures.table(spark, sf, "events")
    return e.select("event_id", dashboard.percent_text(F.col("event_id") / 8).alias("percent"), dashboard.thousands(F.col("event_id") * 12345).alias("thousands"))


def q_nested_values(spark: SparkSession, sf: str) -> DataFrame:
    """Objects and arrays within an answer become compact JSON texts, numbers and truth values what Python shows."""
    raw = F.concat(F.lit('{"Budget": {"a" : [1, '), F.col("props"), F.lit(']}, "Summary": true, "Issue Date": [ ], "Other": '), F.col("event_id").cast("string"), F.lit(".50, \"Start Date\": null}"))
    found = extract.read_answers(fixtures.table(spark, sf, "events").select("event_id", raw.alias("raw"))).select("event_id", F.explode("entries").alias("e"))
    return found.select("event_id", F.col("e.pos").cast("long").alias("pos"), "e.key", "e.value")


def q_field_table(spark: SparkSession, sf: str) -> DataFrame:
    """Answers as rows in the order of fields; another name among them is left out."""
    odd = fixtures.runs(spark, sf).withColumn("output", F.map_concat("output", F.create_map(F.lit("Other"), F.lit("x"))))
    return extract.field_table(odd, ["rfp", "model"]).withColumn("field_id", F.col("field_id").cast("long"))


def q_enabled_models(spark: SparkSession, sf: str) -> DataFrame:
    registry = _documents(spark, sf).select(F.concat("source", F.lit("-"), "lang").alias("model"), F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") % 2 == 0).alias("enabled"))
    return extract.enabled_models(registry).groupBy("model").agg(F.count("*").alias("n"))


def q_unknown_names(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents whose conversation is unknown."""
    known = fixtures.table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"))
    return score.unknown(fixtures.table(spark, sf, "labels"), known, "doc_id")


def q_sorted_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Levels in the order of model and concurrency, with their places."""
    from pyspark.sql import Window

    return _levels(spark, sf).select("model", "concurrency", F.row_number().over(Window.orderBy("model", "concurrency")).cast("long").alias("place"))


def q_final_json(spark: SparkSession, sf: str) -> DataFrame:
    """One JSON object of all fields for each document."""
    best = extract.best_candidates(_top(spark, sf), ["rfp_no"])
    final = extract.final_values(best, _documents(spark, sf).select(F.col("doc_id").alias("rfp_no")), ["rfp_no"])
    return extract.answers_as_json(final, ["rfp_no"])


def q_gauge_lines(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.gauge_lines(dashboard.gauges(_run_rows(spark, sf, ratio=False), ["field_accuracy_pct", "latency_seconds", "total_tokens"], "rfp"))


def q_report_lines(spark: SparkSession, sf: str) -> DataFrame:
    """What the console shows of each model."""
    labels = {"field_accuracy_pct": "accuracy", "completeness_pct": "completeness", "hallucination_rate_pct": "hallucination"}
    return sinks.report_lines(score.model_summary(_run_rows(spark, sf, ratio=False)), "model", labels, ["model"]).select(_long("place"), "line")


def q_run_report(spark: SparkSession, sf: str) -> DataFrame:
    """What the console shows of each run."""
    return _run_rows(spark, sf, ratio=False).select("rfp", F.concat("model", F.lit(": "), sinks.report_line(sinks.RUN_REPORT)).alias("line"))


def q_level_report(spark: SparkSession, sf: str) -> DataFrame:
    """What the console shows of each level of the load test."""
    return _levels(spark, sf).select("model", "concurrency", sinks.report_line(sinks.LEVEL_REPORT).alias("line"))


def q_score_documents(spark: SparkSession, sf: str, ratio: bool = True) -> DataFrame:
    """Guarded scoring of all documents: each must have expected values and a run."""
    names = _documents(spark, sf).select(F.concat(F.lit("rfp"), "doc_id", F.lit(".txt")).alias("rfp"))
    return score.score_documents(fixtures.truth(spark, sf), fixtures.runs(spark, sf), names, ratio)


def q_upsert_repeats(spark: SparkSession, sf: str) -> DataFrame:
    """The last event of each user and kind, where one side or both repeat keys; those with an even number are the new ones."""
    e = fixtures.table(spark, sf, "events").select("user_id", "event_type", "event_id", "value")
    merged = score.upsert(e.where("event_id % 2 = 1"), e.where("event_id % 2 = 0"), ["user_id", "event_type"], "event_id")
    return merged.select("user_id", "event_type", "event_id", "value")


def q_committed_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Levels from a stream of level rows, committed batch by batch; then all of them come once more and add nothing."""
    folder, store, columns = new_path(spark, "level-rows"), new_path(spark, "levels"), [c.split()[0] for c in files.CAPACITY.split(", ")]
    kept = job_stream.level_store(spark, store)
    typed = [F.col(name).cast(kind) for name, kind in (c.split() for c in files.CAPACITY.split(", "))]
    _levels(spark, sf).select(*typed).repartition(4, "model").write.parquet(folder)
    for k in range(2):
        job_stream.commit_levels(job_stream.level_stream(spark, folder, 1), kept, new_path(spark, f"levels-{k}"), f"run {k}").awaitTermination()
    return kept.read().select(*columns)


def q_latest_gauges(spark: SparkSession, sf: str) -> DataFrame:
    """The last latency of each model and level by event time, from the job log as a stream."""
    folder, store = new_path(spark, "jobs"), new_path(spark, "gauges")
    jobs = fixtures.jobs(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    jobs.repartitionByRange(4, "ts").write.parquet(folder)
    kept = job_stream.gauge_store(spark, store)
    job_stream.follow_gauges(job_stream.log_stream(spark, folder, 1), kept, new_path(spark, "gauges-log")).awaitTermination()
    return kept.read().select("model", "concurrency", "job_id", F.col("latency_s").alias("value"))


def q_collected_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates of answers to chunks and their halves, with where they come from and the source around them."""
    parts = chunking.chunks(_documents(spark, sf)).select("doc_id", _long("chunk_no"), "chunk_text")
    read = lambda parts: parts.withColumn("cleaned_ok", (F.col("doc_id") + F.col("chunk_no")) % 3 != 0)
    tried = extract.with_recovery(parts, read, stored).withColumn("cleaned_ok", F.col("cleaned_ok") | (F.col("part_no") > 0))
    words = F.split(F.col("chunk_text"), " ")
    entry = lambda pos, key, value: F.struct(F.lit(pos).alias("pos"), F.lit(key).alias("key"), value.alias("value"))
    entries = F.array(entry(0, "Summary", F.element_at(words, -1)), entry(1, "Other", F.lit("x")), entry(2, "Summary", F.element_at(words, 1)), entry(3, "Budget", F.lit(" N/A ")))
    found = extract.candidates_of(tried.withColumn("entries", entries), ["doc_id"])
    return found.select("doc_id", "field", _long("idx"), "source", "value", F.md5("excerpt").alias("digest"))


#: Queries over run scores. The sequence ratio has no SQL: their SQL checks variants with the token F1 alone.
RATIO = [q_model_quality, q_run_scores, q_model_summary_ordered, q_gauges, q_melt_quality, q_detail_by_rfp, q_run_rows, q_model_means, q_score_documents]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: f for name, f in globals().items() if name.startswith("q_")}
    return found | {f"{f.__name__}_token_f1": partial(f, ratio=False) for f in RATIO}


def oracle_sql() -> dict[str, str]:
    full = {f.__name__ for f in RATIO}
    return {f"{k}_token_f1" if k in full else k: v for k, v in ORACLES.items()}
