"""From chunks to one value per field: answers, recovery, candidates, selection and the metrics of a run."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from concurrent.futures import TimeoutError as FutureTimeout
from dataclasses import dataclass
from threading import Thread
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text, udfs
from ..sources.store import TableStore
from . import chunking, rules

DEFAULT, MOST_CANDIDATES = "Not Specified", 4
#: Answers that go from a task to Spark at once.
SENT = 256
#: What tells a field from one that is easily taken for it.
_HINTS = {
    "Start Date": "when the contract begins", "End Date": "when the contract ends", "Number of References Required": "a number",
    "Evaluation Criteria & Weighting (points breakdown by category)": "each criterion with its points", "Summary": "what is asked for, in one sentence",
}


def _asked_for(name: str, is_long: bool) -> str:
    """A field's line in the prompt: its name, and how its value is to look."""
    return f"- {name}: {_HINTS.get(name, 'a sentence or a list' if is_long else 'as it is written')}\n"


#: What a model is asked, made from the field dimension; the chunk follows.
PROMPT = (
    "Below are the fields that a request for proposals may fill, then a part of one. Which fields does this part fill, and with what?\n"
    "Reply with a JSON object of strings, keyed by the fields' names, without the fields on which the part is silent and without further text.\n\n"
    + "".join(_asked_for(*field) for field in rules.FIELDS)
    + "\nDOCUMENT CHUNK:\n"
)
USAGE = "raw string, finish_reason string, prompt_tokens long, completion_tokens long, total_tokens long, time_s double"


class Backend(Protocol):
    """Answers prompts. connect() runs once in each task, answer() for every prompt.

    An answer has raw, finish_reason, time_s and the usage as numbers of tokens, under the names of USAGE or in a dict `usage`.
    What a call may take (output tokens, time, no temperature, no thinking) is the backend's to ask for.
    """

    def connect(self) -> object: ...

    def answer(self, client: object, model: str, prompt: str) -> dict: ...


class StubBackend:
    """Answers with the chunk's first line as the summary, without a network."""

    def connect(self) -> object:
        return None

    def answer(self, client: object, model: str, prompt: str) -> dict:
        chunk = prompt[len(PROMPT) :]
        line = chunk.strip().split("\n", 1)[0].replace("\\", " ").replace('"', "'")
        raw = '{"Summary": "' + "".join(c for c in line if c >= " ") + '"}'
        return {"raw": raw, "finish_reason": "stop", "prompt_tokens": len(prompt) // 4, "completion_tokens": len(raw) // 4, "total_tokens": len(prompt) // 4 + len(raw) // 4, "time_s": 0.0}


class NoBackend:
    """Answers nothing: for runs whose answers are all in a log."""

    def connect(self) -> object:
        raise RuntimeError("no backend to call")

    def answer(self, client: object, model: str, prompt: str) -> dict:
        raise RuntimeError("no backend to call")


def run_matrix(docs: DataFrame, models: list[str]) -> DataFrame:
    """Every document with every model; the list of models is small and given."""
    return docs.withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))


def prompt(chunk: Column) -> Column:
    return F.concat(F.lit(PROMPT), chunk)


def usage(answer: dict) -> dict:
    """prompt_tokens, completion_tokens and total_tokens of an answer in either naming; what is absent is 0, an absent total the sum."""
    given = answer.get("usage") or answer
    prompt_tokens, completion_tokens = (next((int(given[n]) for n in names if given.get(n) is not None), 0) for names in (("prompt_tokens", "input_tokens"), ("completion_tokens", "output_tokens")))
    total = given.get("total_tokens")
    return {"prompt_tokens": prompt_tokens, "completion_tokens": completion_tokens, "total_tokens": prompt_tokens + completion_tokens if total is None else int(total)}


@dataclass(frozen=True)
class Calls:
    """How calls are made: at most so many at once, each tried so often, with a pause that doubles, and given up after so many seconds."""

    at_once: int = 2
    attempts: int = 1
    pause_s: float = 0.5
    limit_s: float | None = None

    def made(self, call: Callable[[], dict]) -> dict:
        """The answer of a call, or why there is none; time_s covers all attempts unless the answer has its own."""
        began, said = time.monotonic(), ""
        for k in range(self.attempts):
            if k:
                time.sleep(self.pause_s * 2 ** (k - 1))
            try:
                answer = call() if self.limit_s is None else _within(call, self.limit_s)
                return answer if answer.get("time_s") is not None else {**answer, "time_s": time.monotonic() - began}
            except Exception as e:  # a failed call is a row, not a failed job
                said = f"error: {e or type(e).__name__}"
        return {"finish_reason": said, "time_s": time.monotonic() - began}


def _within(call: Callable[[], dict], seconds: float) -> dict:
    """The call's answer if it comes in time; a thread that is late is left to end by itself."""
    out: Future = Future()

    def run() -> None:
        try:
            out.set_result(call())
        except Exception as e:
            out.set_exception(e)

    Thread(target=run, daemon=True).start()
    try:
        return out.result(seconds)
    except FutureTimeout:
        raise TimeoutError(f"no answer within {seconds} s") from None


def ask(parts: DataFrame, backend: Backend, calls: Calls | None = None) -> DataFrame:
    """parts(..., model, chunk_text) with the backend's answer and what is read from it. A failed call has a null answer.

    Without calls each task makes one call after the other. With them the backend has at most calls.at_once calls at a time,
    and as many while work is left: there are no more tasks than calls or cores, each with its share of the calls,
    and a task makes the next call as soon as one of its own ends. Rows come back as answers do.
    """
    spark = parts.sparkSession
    tasks = None if calls is None else max(1, min(calls.at_once, spark.sparkContext.defaultParallelism))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        how, client = calls or Calls(at_once=1), None
        own = 1 if tasks is None else how.at_once // tasks + (TaskContext.get().partitionId() < how.at_once % tasks)

        def asked(row: dict) -> dict:
            answer = how.made(lambda: backend.answer(client, row["model"], PROMPT + row["chunk_text"]))
            return {**row, **{c: answer.get(c) for c in ("raw", "finish_reason", "time_s")}, **usage(answer)}

        schema, ready = None, []
        with ThreadPoolExecutor(own) as pool:
            open_: set[Future] = set()
            for b in (b for b in batches if len(b)):
                if schema is None:
                    schema, client = _arrow(b.schema), backend.connect()
                for row in b.to_pylist():
                    if own == 1:
                        ready.append(asked(row))
                    else:
                        if len(open_) >= own:
                            done, open_ = wait(open_, return_when=FIRST_COMPLETED)
                            ready += [f.result() for f in done]
                        open_.add(pool.submit(asked, row))
                    if len(ready) >= SENT:
                        yield pa.RecordBatch.from_pylist(ready, schema=schema)
                        ready = []
            if ready := ready + [f.result() for f in open_]:
                yield pa.RecordBatch.from_pylist(ready, schema=schema)

    def _arrow(schema: pa.Schema) -> pa.Schema:
        kinds = {"string": pa.string(), "long": pa.int64(), "double": pa.float64()}
        for c in USAGE.split(", "):
            schema = schema.append(pa.field(c.split()[0], kinds[c.split()[1]]))
        return schema

    columns = ", ".join(f"`{n}` {t}" for n, t in parts.dtypes)
    dealt = parts if tasks is None else parts.repartition(tasks)
    return read_answers(dealt.mapInArrow(run, f"{columns}, {USAGE}"))


ANSWERS = f"model string, prompt_hash string, {USAGE}"


def answer_log(spark: SparkSession, folder: str, buckets: int = 32) -> TableStore:
    """The committed table of answers that were given, one for each model and prompt."""
    return TableStore(spark, folder, ["model", "prompt_hash"], buckets)


def ask_once(parts: DataFrame, backend: Backend, log: TableStore, calls: Calls | None = None) -> DataFrame:
    """ask() that makes only calls whose answers the log doesn't have, each prompt once, and keeps their answers there.

    Answers are committed before they are used, so a run that is repeated or fails later makes no call again; a call that
    failed isn't kept and is made again by the next run.
    """
    keyed = parts.select("model", F.sha2(prompt(F.col("chunk_text")), 256).alias("prompt_hash"), "chunk_text").dropDuplicates(["model", "prompt_hash"])
    known = log.read(schema=ANSWERS).select(F.col("model").alias("__m"), F.col("prompt_hash").alias("__h"))
    new = keyed.join(known, F.col("model").eqNullSafe(F.col("__m")) & (F.col("prompt_hash") == F.col("__h")), "left_anti")
    given = ask(new, backend, calls).where("raw IS NOT NULL").select(*[c.split()[0] for c in ANSWERS.split(", ")])
    log.upsert(given, replace=False)
    return replay(parts, log.read())


def replay(parts: DataFrame, answers: DataFrame) -> DataFrame:
    """ask() from a table of answers(model, prompt_hash, raw, ...): prompt_hash is sha2 of the whole prompt."""
    keyed = parts.withColumn("prompt_hash", F.sha2(prompt(F.col("chunk_text")), 256))
    return read_answers(keyed.join(answers, ["model", "prompt_hash"], "left").drop("prompt_hash"))


def read_answers(answers: DataFrame) -> DataFrame:
    """answers(raw, ...) with raw_ok, cleaned_ok and entries."""
    return answers.withColumn("__a", udfs.parse_answer("raw")).select(*answers.columns, F.col("__a.raw_ok").alias("raw_ok"), F.col("__a.ok").alias("cleaned_ok"), F.col("__a.entries").alias("entries"))


def failed(attempts: DataFrame, retry_short: bool = False) -> DataFrame:
    """Attempts to make again in halves; short chunks only under the load test's policy, whole."""
    return attempts.where(~F.coalesce("cleaned_ok", F.lit(False)) & (F.lit(retry_short) | (F.length("chunk_text") >= 2000)))


def with_recovery(chunks: DataFrame, ask_parts, store, retry_short: bool = False) -> DataFrame:
    """attempts of chunks(rfp, model, chunk_no, chunk_text): originals (part_no 0) and the halves of failed ones (1, 2).

    ask_parts maps parts to attempts; store cuts the plan after the first pass (a written table or checkpoint), so that
    no call is made twice: millrace.shared.stored.
    """
    first = store(ask_parts(chunks.withColumn("part_no", F.lit(0))))
    again = failed(first, retry_short).select(*chunks.columns, F.posexplode(chunking.halves(F.col("chunk_text"))).alias("part_no", "half"))
    second = ask_parts(again.withColumn("chunk_text", F.col("half")).withColumn("part_no", F.col("part_no") + 1).drop("half"))
    return first.unionByName(second)


def label(chunk_no: Column, part_no: Column) -> Column:
    return F.concat(F.lit("chunk "), chunk_no.cast("string"), F.when(part_no > 0, F.concat(F.lit("."), part_no.cast("string"))).otherwise(""))


def candidates_of(attempts: DataFrame, keys: list[str], most: int = MOST_CANDIDATES) -> DataFrame:
    """(keys, field, idx, source, value, excerpt) of attempts(keys, chunk_no, part_no, chunk_text, entries) that were read."""
    place = [*keys, "chunk_no", "part_no"]
    kept = attempts.where("cleaned_ok").select(*place, F.explode("entries").alias("e"))
    named = kept.join(F.broadcast(rules.field_dimension(attempts.sparkSession)), F.col("e.key") == F.col("field"), "left_semi")
    values = named.select(*place, F.col("e.key").alias("field"), F.col("e.pos").alias("pos"), text.clean_value(F.col("e.value")).alias("value"))
    first = first_candidates(values, [*keys, "field"], ["chunk_no", "part_no", "pos"], most)
    told = first.join(attempts.where("cleaned_ok").select(*place, "chunk_text"), place)  # the few that stay meet their text
    excerpt = text.source_excerpt(F.col("chunk_text"), F.col("field"), F.col("value"))
    return told.select(*keys, "field", "idx", label(F.col("chunk_no"), F.col("part_no")).alias("source"), "value", excerpt.alias("excerpt"))


def first_candidates(values: DataFrame, keys: list[str], order: list[str], most: int = MOST_CANDIDATES) -> DataFrame:
    """The first of each distinct normalised value, at most `most` of a key, numbered by idx in order."""
    normal = values.withColumn("__norm", text.normalize_text(F.col("value"))).where("__norm <> ''")
    first = normal.withColumn("__n", F.row_number().over(Window.partitionBy(*keys, "__norm").orderBy(*order))).where("__n = 1").drop("__n", "__norm")
    return first.withColumn("idx", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("idx") <= most)


def best_candidates(candidates: DataFrame, keys: list[str], rule_set: str = "v5") -> DataFrame:
    """(keys, field, value, score): the best score of a field, ties to the earlier candidate; a reference count as a number."""
    scored = candidates.withColumn("score", rules.candidate_score(F.col("field"), F.col("value"), F.col("excerpt"), rule_set)).where("score IS NOT NULL")
    best = scored.groupBy(*keys, "field").agg(F.max_by(F.struct("value", "score"), F.struct("score", -F.col("idx"))).alias("b"))
    value = F.when(F.col("field") == rules.REFERENCES, F.coalesce(text.reference_count(F.col("b.value")), F.col("b.value"))).otherwise(F.col("b.value"))
    return best.select(*keys, "field", value.alias("value"), F.col("b.score").alias("score"))


def final_values(best: DataFrame, runs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, field_id, field, value) of every run and field; fields without a candidate have the default."""
    fields = F.explode(F.array(*[F.struct(F.lit(i).alias("field_id"), F.lit(n).alias("field")) for i, n in enumerate(rules.NAMES)]))
    every = runs.select(*keys, fields.alias("f")).select(*keys, "f.field_id", "f.field")
    return every.join(best.select(*keys, "field", "value"), [*keys, "field"], "left").select(*keys, "field_id", "field", F.coalesce("value", F.lit(DEFAULT)).alias("value"))


def run_metrics(attempts: DataFrame, chunks: DataFrame, keys: list[str]) -> DataFrame:
    """One row a run: chunks and how many succeeded, validity rates over original attempts, tokens of all attempts.

    A chunk succeeds if its original attempt was read, or it has parts and all were; a run if any chunk does.
    """
    part = F.col("part_no") > 0
    by_chunk = attempts.groupBy(*keys, "chunk_no").agg(
        F.coalesce(F.bool_or(F.col("cleaned_ok") & ~part), F.lit(False)).alias("original"),
        F.coalesce(F.bool_and(F.when(part, F.col("cleaned_ok"))), F.lit(False)).alias("parts"),
        F.count_if(~part & F.col("raw_ok")).alias("raw_ok"), F.count_if(~part & F.col("cleaned_ok")).alias("cleaned_ok"),
        *[F.sum(c).alias(c) for c in ("prompt_tokens", "completion_tokens", "total_tokens")],
    )
    sums = by_chunk.groupBy(*keys).agg(F.count_if(F.col("original") | F.col("parts")).alias("chunks_successful"), *[F.sum(c).alias(c) for c in ("raw_ok", "cleaned_ok", "prompt_tokens", "completion_tokens", "total_tokens")])
    total = chunks.groupBy(*keys).agg(F.count("*").alias("chunks_total"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    rate = lambda c: text.python_round(F.coalesce(F.try_divide(zero(F.col(c)), F.col("chunks_total")) * 100.0, F.lit(0.0)), 2)
    return total.join(sums, keys, "left").select(
        *keys, (zero(F.col("chunks_successful")) > 0).alias("success"), "chunks_total", zero(F.col("chunks_successful")).alias("chunks_successful"),
        rate("raw_ok").alias("raw_json_valid_rate"), rate("cleaned_ok").alias("json_valid_after_cleanup_rate"),
        *[zero(F.col(c)).alias(c) for c in ("prompt_tokens", "completion_tokens", "total_tokens")],
    )


def extract_documents(docs: DataFrame, models: list[str], backend: Backend, store, rule_set: str = "v5", calls: Calls | None = None, log: TableStore | None = None) -> tuple[DataFrame, DataFrame]:
    """(final values, run metrics) of docs(rfp, text): chunk, ask, recover, collect, select. With a log no call is made whose answer it has."""
    keys = ["rfp", "model"]
    parts = run_matrix(chunking.chunks(docs, "rfp"), models).select("rfp", "model", "chunk_no", "chunk_text")
    asked = (lambda p: ask(p, backend, calls)) if log is None else (lambda p: ask_once(p, backend, log, calls))
    attempts = store(with_recovery(parts, asked, store))
    best = best_candidates(candidates_of(attempts, keys), keys, rule_set)
    return final_values(best, run_matrix(docs.select("rfp"), models), keys), run_metrics(attempts, parts, keys)


def answers_as_json(final: DataFrame, keys: list[str]) -> DataFrame:
    """One JSON object a run, fields in order."""
    ordered = F.array_sort(F.collect_list(F.struct("field_id", "field", "value")))
    pairs = F.transform(ordered, lambda x: F.struct(x["field"].alias("key"), x["value"].alias("value")))
    return final.groupBy(*keys).agg(F.to_json(F.map_from_entries(pairs)).alias("json"))


def results(final: DataFrame, metrics: DataFrame) -> DataFrame:
    """(rfp, model, success, ..., output map): what a results file has of each run; output in the order of fields."""
    pairs = F.transform(F.array_sort(F.collect_list(F.struct("field_id", "field", "value"))), lambda x: F.struct(x["field"].alias("key"), x["value"].alias("value")))
    return metrics.join(final.groupBy("rfp", "model").agg(F.map_from_entries(pairs).alias("output")), ["rfp", "model"])


def field_table(output: DataFrame, keys: list[str], answer: str = "output") -> DataFrame:
    """(keys, field_id, field, value): a map of answers as rows in the order of fields; names that are no fields are left out."""
    rows = output.select(*keys, F.explode(answer).alias("field", "value"))
    return rows.join(F.broadcast(rules.field_dimension(output.sparkSession)), "field").select(*keys, "field_id", "field", "value")


def enabled_models(registry: DataFrame) -> DataFrame:
    """Rows of registry(model, enabled) that are switched on; null is off."""
    return registry.where(F.coalesce("enabled", F.lit(False)))


def chat_prompts(messages: DataFrame, generate: bool = True) -> DataFrame:
    """(conv_id, prompt) of messages(conv_id, turn, role, text): every message in its markers, then the assistant's header."""
    one = lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["text"], F.lit("<|im_end|>\n"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), one), "")
    return messages.groupBy("conv_id").agg(F.concat(joined, F.lit("<|im_start|>assistant\n" if generate else "")).alias("prompt"))


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    if missing := sorted(set(columns) - set(df.columns)):
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df
