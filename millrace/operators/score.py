"""Scores of extracted values against expected ones, of runs and of models."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, udfs
from ..sources.store import last_of
from . import rules

LONG_LEAST, LEAST = 0.45, 0.70
#: The order in which models are listed; others come last.
MODEL_ORDER = ["Granite-8B-AWQ", "OpenAI", "Qwen-4B-AWQ"]


def field_scores(cells: DataFrame, ratio: bool = True) -> DataFrame:
    """cells(field, expected, predicted, ...) with similarity, is_correct, expected_missing and predicted_missing.

    Expected missing: 1 if predicted is missing too, else 0. Predicted missing: 0. Equal in normal form, a contact's e-mails
    all there, or the same first number of references: 1. Else the larger of the sequence ratio (unless ratio is False) and
    the token F1. Decided cells reach the ratio as nulls, so it runs on the rest only.
    """
    both = {"__e": "expected", "__p": "predicted"}
    ready = cells.withColumns({f"{k}s": text.quick_strip(F.col(c)) for k, c in both.items()})  # step by step: each is worked out once
    ready = ready.withColumns({f"{k}c": F.when(F.col(f"{k}s").isNull() | text.is_missing_phrase(F.col(f"{k}s")), "").otherwise(F.col(f"{k}s")) for k in both})
    no_e, no_p, same = F.col("__ec") == "", F.col("__pc") == "", F.col("__ec") == F.col("__pc")
    ready = ready.withColumns({k: udfs.normalized_clean(F.when(~no_e & ~no_p & ~same, F.col(f"{k}c"))) for k in both})  # null where no normal form is needed
    contact = (F.col("field") == rules.CONTACT) & text.contains_all(text.emails(F.col("expected")), text.emails(F.col("predicted")))
    first = lambda c: F.get(text.numbers(F.col(c)), F.lit(0))
    count = (F.col("field") == rules.REFERENCES) & (first("__e") == first("__p"))
    decided = F.when(no_e, F.when(no_p, 1.0).otherwise(0.0)).when(no_p, 0.0).when(same | (F.col("__e") == F.col("__p")) | contact | F.coalesce(count, F.lit(False)), 1.0)
    ready = ready.withColumn("__d", decided)
    ready = ready.withColumns({f"{k}t": F.when(F.col("__d").isNull(), text.tokens(F.col(k))) for k in both})
    ready = ready.withColumn("__f1", F.when(F.col("__d").isNull(), text.token_f1(F.col("__et"), F.col("__pt"))))
    if ratio:
        most = F.try_divide(2 * F.least(F.length("__e"), F.length("__p")), F.length("__e") + F.length("__p"))  # the ratio's upper bound
        open_ = F.col("__d").isNull() & (F.col("__f1") < most)
        ready = ready.withColumn("__r", udfs.seq_ratio_above(F.when(open_, F.col("__e")), F.when(open_, F.col("__p")), F.col("__f1")))
    rest = F.greatest(F.coalesce("__r", F.lit(0.0)), F.col("__f1")) if ratio else F.col("__f1")
    scored = ready.withColumn("similarity", F.coalesce("__d", rest))
    long = F.col("field").isin([n for n, is_long in rules.FIELDS if is_long])
    return scored.withColumn("is_correct", F.col("similarity") >= F.when(long, LONG_LEAST).otherwise(LEAST)).select(*cells.columns, "similarity", "is_correct", no_e.alias("expected_missing"), no_p.alias("predicted_missing"))


def _percent(part: Column, whole: Column, default: float) -> Column:
    return text.python_round(F.coalesce(F.try_divide(part, whole) * 100.0, F.lit(default)), 2)


def run_scores(scored: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Counts and five rates of each run of field_scores()'s rows.

    Similarities are added in the order of the column `order`, or else of the fields: a sum's last bits decide how a mean half way
    between two roundings is rounded, so they must not depend on how rows are dealt out.
    """
    place = F.col(order) if order else F.array_position(F.array(*[F.lit(n) for n in rules.NAMES]), F.col("field"))
    added = F.aggregate(F.sort_array(F.collect_list(F.struct(place.alias("place"), "similarity"))), F.lit(0.0), lambda sum_, x: sum_ + x["similarity"])
    flagged = scored.withColumnsRenamed({"expected_missing": "__no_e", "predicted_missing": "__no_p"})
    c = F.col
    counts = flagged.groupBy(*keys).agg(
        F.count("*").alias("fields_total"), F.count_if("is_correct").alias("fields_correct"), F.count_if("__no_e").alias("gt_null_fields"),
        F.count_if(c("__no_e") & ~c("__no_p")).alias("hallucinated_null_fields"), F.count_if(~c("__no_e")).alias("expected_nonmissing_fields"),
        F.count_if(~c("__no_e") & ~c("__no_p")).alias("expected_found_fields"), F.count_if(~c("__no_e") & c("__no_p")).alias("omitted_expected_fields"),
        F.count_if(~c("__no_e") & ~c("__no_p") & ~c("is_correct")).alias("wrong_value_fields"), (added / F.count("*")).alias("mean"),
    )
    return counts.select(
        *keys, _percent(c("fields_correct"), c("fields_total"), 0.0).alias("field_accuracy_pct"), text.python_round(c("mean") * 100.0, 2).alias("avg_field_similarity_pct"),
        _percent(c("expected_found_fields"), c("expected_nonmissing_fields"), 100.0).alias("completeness_pct"),
        _percent(c("hallucinated_null_fields"), c("gt_null_fields"), 0.0).alias("hallucination_rate_pct"),
        _percent(c("wrong_value_fields"), c("expected_nonmissing_fields"), 0.0).alias("wrong_value_rate_pct"),
        *[x for x in counts.columns if x not in (*keys, "mean")],
    )


#: What a run's row takes over from the run itself, under the row's names; absent values are 0.
TAKEN_OVER = {
    "latency_seconds": "time_seconds", "prompt_tokens": "prompt_tokens", "completion_tokens": "completion_tokens", "total_tokens": "total_tokens",
    "chunks_total": "chunks_total", "chunks_successful": "chunks_successful", "raw_json_valid_pct": "raw_json_valid_rate", "json_after_cleanup_pct": "json_valid_after_cleanup_rate",
}
RUN_COLUMNS = [
    "field_accuracy_pct", "avg_field_similarity_pct", "completeness_pct", "hallucination_rate_pct", "wrong_value_rate_pct", "fields_correct", "fields_total",
    "expected_nonmissing_fields", "expected_found_fields", "gt_null_fields", "hallucinated_null_fields", "wrong_value_fields", "omitted_expected_fields", *TAKEN_OVER,
]


def run_rows(scores: DataFrame, runs: DataFrame, keys: list[str]) -> DataFrame:
    """run_scores()'s rows with what each run of `runs` measured of itself, in the order of the run table's columns; a run without measures has zeros."""
    kinds = dict(runs.dtypes)
    taken = [(F.coalesce(F.col(f"__{new}"), F.lit(0)) if old in kinds else F.lit(0)).cast(kinds.get(old, "double")).alias(new) for new, old in TAKEN_OVER.items()]
    found = runs.select(*keys, *[F.col(old).alias(f"__{new}") for new, old in TAKEN_OVER.items() if old in kinds])
    return scores.join(found, keys, "left").select(*keys, *[c for c in RUN_COLUMNS if c not in TAKEN_OVER], *taken)


def require_scorable(truth: DataFrame, runs: DataFrame, names: DataFrame) -> None:
    """An error if no document is chosen by names(rfp), one has no truth or no run, or if documents' truths have different fields."""
    if names.isEmpty():
        raise ValueError("no documents are chosen")
    require_known(names, truth, "rfp")
    require_known(names, runs, "rfp", "without a run")
    if truth.groupBy("rfp").agg(F.sort_array(F.collect_set("field")).alias("fields")).select("fields").distinct().limit(2).count() > 1:
        raise ValueError("documents have different fields")


def score_documents(truth: DataFrame, runs: DataFrame, chosen: list[str] | DataFrame, ratio: bool = True) -> DataFrame:
    """Run rows of the chosen documents, a list or a table (rfp): truth(rfp, field, expected), runs(rfp, model, output map, ...), every model of a document."""
    names = chosen.select("rfp").distinct() if isinstance(chosen, DataFrame) else truth.sparkSession.createDataFrame([(n,) for n in set(chosen)], "rfp string")
    require_scorable(truth, runs, names)
    some = runs.join(names, "rfp", "left_semi")
    return scored_runs(truth, some, ratio).orderBy("rfp", "model")


def scored_runs(truth: DataFrame, runs: DataFrame, ratio: bool = True) -> DataFrame:
    """Run rows of every run of a document with expected values; a document's fields meet its runs' answers in one join."""
    runs_of = truth.join(runs.select("rfp", "model", "output"), "rfp")
    cells = runs_of.select("rfp", "model", "field", "expected", F.element_at("output", F.col("field")).alias("predicted"))
    return run_rows(run_scores(field_scores(cells, ratio=ratio), ["rfp", "model"]), runs, ["rfp", "model"])


def expected_cells(truth: DataFrame, predictions: DataFrame) -> DataFrame:
    """(rfp, model, field, expected, predicted): every expected field of every run; other predicted fields are left out."""
    runs = predictions.select("rfp", "model").distinct()
    return truth.join(runs, "rfp").join(predictions, ["rfp", "model", "field"], "left").select("rfp", "model", "field", "expected", F.col("value").alias("predicted"))


def unknown(names: DataFrame, known: DataFrame, column: str) -> DataFrame:
    """The distinct values of a column that `known` hasn't."""
    return names.select(column).distinct().join(known.select(column).distinct(), column, "left_anti")


def require_known(names: DataFrame, known: DataFrame, column: str, said: str | None = None) -> None:
    """An error that names up to ten unknown values, the first in order."""
    if some := unknown(names, known, column).orderBy(column).limit(10).collect():
        raise ValueError(f"{said or f'unknown {column}'}: {', '.join(str(r[0]) for r in some)}")


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Rows of existing and new in the order of keys, the new one for equal keys; of repeated keys on one side the last by `order`, or else the last of the table's rows."""
    named = [f"__{k}" for k in keys]
    new = last_of(new, keys, order)
    known = new.select(*[F.col(k).alias(n) for k, n in zip(keys, named, strict=True)])
    same = reduce(operator.and_, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, named, strict=True)])
    return last_of(existing, keys, order).join(known, same, "left_anti").unionByName(new).orderBy(*keys)


def model_summary(runs: DataFrame) -> DataFrame:
    """Unweighted means over documents of each model, rounded as Python does; blank names are left out, names are stripped."""
    means = ["field_accuracy_pct", "avg_field_similarity_pct", "completeness_pct", "hallucination_rate_pct", "wrong_value_rate_pct", "latency_seconds", "total_tokens", "raw_json_valid_pct", "json_after_cleanup_pct"]
    there = [m for m in means if m in runs.columns]
    names = {"latency_seconds": "avg_latency_seconds", "total_tokens": "avg_total_tokens"}
    mean = lambda m: F.coalesce(F.avg(m), F.lit(0.0))
    value = lambda m: text.python_round(mean(m)).cast("long") if m == "total_tokens" else text.python_round(mean(m), 2)
    named = runs.withColumn("model", text.strip(F.col("model"))).where("model <> ''")
    return named.groupBy("model").agg(F.count("*").alias("rfps_evaluated"), *[value(m).alias(names.get(m, m)) for m in there])


def model_rank(model: Column, order: list[str] = MODEL_ORDER) -> Column:
    rank = F.lit(999)
    for i, name in enumerate(order):
        rank = F.when(model == name, i).otherwise(rank)
    return rank
