"""Load-test logs: summaries of each level, throughput, plans of jobs and what is left to run."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..shared import stored

KEYS = ["model", "concurrency"]
#: Ranges of values, whose counts are summed up to find a rank, and the error of their bounds as a part of all values.
RANGES, ERROR = 64, 1e-3


def _joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """left with right's other columns, nulls among the keys being equal."""
    named = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    return left.join(named, reduce(operator.and_, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]), how).drop(*[f"__{k}" for k in keys])


def interpolated(values: DataFrame, keys: list[str], column: str, p: float) -> DataFrame:
    """(keys, value): the exact percentile of each key's values, linear between ranks, nulls left out.

    Equal values are counted first and the counts' running sums find the two ranks, so a key's values are never in one
    aggregation buffer: a mergeable sketch of the different values cuts them into ranges of about equal numbers however they are spread,
    ranges are summed up, and ranks are sought within the one or two ranges they lie in. The sketch sets the ranges only; ranks are exact.
    It depends on the order in which its parts meet, so its cuts, a row a key, are stored: sums and ranks are over the same ranges.
    """
    counted = values.where(F.col(column).isNotNull()).groupBy(*keys, F.col(column).alias("__v")).agg(F.count("*").alias("__n"))
    cuts = F.percentile_approx("__v", [k / RANGES for k in range(1, RANGES)], F.lit(int(1 / ERROR)))
    bounds = stored(counted.groupBy(*keys).agg(F.sum("__n").alias("__total"), cuts.alias("__cuts")), "cuts")
    placed = _joined(counted, bounds, keys).withColumn("__range", F.size(F.filter("__cuts", lambda c: c < F.col("__v")))).drop("__cuts")
    sums = placed.groupBy(*keys, "__range").agg(F.sum("__n").alias("__in"))
    sums = sums.withColumn("__before", F.sum("__in").over(Window.partitionBy(*keys).orderBy("__range")) - F.col("__in"))
    at = (F.col("__total") - 1) * p
    needed = _joined(placed, sums, [*keys, "__range"]).where((F.col("__before") <= F.ceil(at)) & (F.col("__before") + F.col("__in") > F.floor(at)))
    inner = Window.partitionBy(*keys, "__range").orderBy("__v")
    ranked = needed.withColumn("__first", F.col("__before") + F.sum("__n").over(inner) - F.col("__n"))
    holds = lambda rank: (F.col("__first") <= rank) & (F.col("__first") + F.col("__n") > rank)
    ends = ranked.groupBy(*keys).agg(F.max(F.when(holds(F.floor(at)), F.col("__v"))).alias("__a"), F.max(F.when(holds(F.ceil(at)), F.col("__v"))).alias("__b"), F.max(at - F.floor(at)).alias("__part"))
    return ends.select(*keys, (F.col("__a") + (F.col("__b") - F.col("__a")) * F.col("__part")).alias("value"))


def level_summary(jobs: DataFrame) -> DataFrame:
    """One row a level of jobs(model, concurrency, success, latency_s, ts): latencies of successful jobs, wall time of all, throughput by the wall time before it is rounded."""
    ok = F.col("success")
    wall = (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 1e6
    sums = jobs.groupBy(*KEYS).agg(
        F.count("*").alias("requests_total"), F.count_if(ok).alias("requests_successful"), F.count_if(~ok).alias("requests_failed"),
        text.python_round(F.coalesce(F.avg(F.when(ok, F.col("latency_s"))), F.lit(0.0)), 4).alias("avg_latency_s"), wall.alias("wall"),
    )
    p95 = interpolated(jobs.where(ok), KEYS, "latency_s", 0.95)
    sums = _joined(sums, p95, KEYS, "left").withColumn("p95_latency_s", text.python_round(F.coalesce("value", F.lit(0.0)), 4)).drop("value")
    rate = text.python_round(F.coalesce(F.try_divide(F.col("requests_successful"), F.col("requests_total")) * 100.0, F.lit(0.0)), 2)
    through = text.python_round(F.coalesce(F.try_divide(F.col("requests_successful"), F.col("wall")) * 60.0, F.lit(0.0)), 2)
    columns = ["requests_total", "requests_successful", "requests_failed", "avg_latency_s", "p95_latency_s", "total_test_time_s", "success_rate_pct", "throughput_requests_per_min"]
    return sums.withColumns({"success_rate_pct": rate, "throughput_requests_per_min": through, "total_test_time_s": text.python_round(F.col("wall"), 4)}).select(*KEYS, *columns)


def overview(levels: DataFrame) -> DataFrame:
    """One row over all levels: success as a ratio of sums, largest throughput, latency and concurrency."""
    return levels.agg(
        text.python_round(F.coalesce(F.try_divide(F.sum("requests_successful"), F.sum("requests_total")) * 100.0, F.lit(0.0)), 2).alias("overall_success_pct"),
        F.sum("requests_total").alias("requests"), F.max("throughput_requests_per_min").alias("max_throughput"),
        F.min("avg_latency_s").alias("min_avg_latency"), F.max("p95_latency_s").alias("max_p95"), F.max("concurrency").alias("max_concurrency"),
    )


def peak_levels(levels: DataFrame, by: str = "throughput_requests_per_min") -> DataFrame:
    """Each model's row with the largest value, the lower concurrency on ties."""
    order = Window.partitionBy("model").orderBy(F.desc(by), "concurrency")
    return levels.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def job_plan(levels: DataFrame, documents: DataFrame) -> DataFrame:
    """(model, concurrency, job_id, doc_no) of levels(model, concurrency): as many jobs as the concurrency, dealt round robin.

    documents(doc_no) are numbered from 0.
    """
    n = documents.agg(F.count("*").alias("__docs"))
    jobs = levels.select(*KEYS, F.explode(F.sequence(F.lit(0), (F.col("concurrency") - 1).cast("int"))).alias("job_id"))
    size = n.first()[0]
    if not size:
        return jobs.where("false").withColumn("doc_no", F.lit(0).cast("long"))
    return jobs.withColumn("doc_no", F.col("job_id").cast("long") % size)


def left_to_run(plan: DataFrame, done: DataFrame) -> DataFrame:
    """Levels of a plan without a finished row."""
    return plan.join(done.select(*KEYS).distinct(), KEYS, "left_anti")


def completed_levels(levels: DataFrame) -> DataFrame:
    return levels.groupBy("model").agg(F.sort_array(F.collect_set("concurrency")).alias("completed"))
