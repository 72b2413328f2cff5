"""The load-test log as a stream: windows of event time, levels committed batch by batch, gauges that follow new rows.

What batches write goes to committed tables under a token of the batch, so a batch that is replayed after a failure changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.files import CAPACITY
from ..sources.store import TableStore

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
JOBS = "model string, concurrency long, job_id long, success boolean, latency_s double, ts timestamp"
LEVEL = ["model", "concurrency"]


def _stream(spark: SparkSession, schema: str, folder: str, files_per_trigger: int) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def job_stream(spark: SparkSession, folder: str, files_per_trigger: int = 16) -> DataFrame:
    return _stream(spark, EVENTS, folder, files_per_trigger)


def log_stream(spark: SparkSession, folder: str, files_per_trigger: int = 16) -> DataFrame:
    """Rows of finished jobs."""
    return _stream(spark, JOBS, folder, files_per_trigger)


def level_stream(spark: SparkSession, folder: str, files_per_trigger: int = 16) -> DataFrame:
    """Rows of finished levels."""
    return _stream(spark, CAPACITY, folder, files_per_trigger)


def windowed_throughput(jobs: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(model, start, jobs, mean_latency) in tumbling windows; rows later than `late` are left out. Also for batches."""
    grouped = jobs.withWatermark("ts", late) if jobs.isStreaming else jobs
    return grouped.groupBy(F.col("event_type").alias("model"), F.window("ts", window).alias("w")).agg(F.count("*").alias("jobs"), F.avg("value").alias("mean_latency")).select("model", F.col("w.start").alias("start"), "jobs", "mean_latency")


def level_store(spark: SparkSession, folder: str) -> TableStore:
    """The committed table of levels, one row for each (model, concurrency)."""
    return TableStore(spark, folder, LEVEL, buckets=8)


def commit_levels(levels: DataFrame, store: TableStore, checkpoint: str, name: str) -> StreamingQuery:
    """Commits the rows of a stream of finished levels that the store doesn't have yet, batch by batch, as far as there are rows.

    A level that is there stays as it is: to run a plan again means to run what is left of it. name tells this stream's
    batches from those of others.
    """

    def commit(batch: DataFrame, number: int) -> None:
        store.upsert(batch, token=f"{name}/{number}", replace=False)

    return levels.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def gauge_store(spark: SparkSession, folder: str) -> TableStore:
    """The committed table of gauges: of each (model, concurrency) the last job by event time."""
    return TableStore(spark, folder, LEVEL, buckets=8)


def follow_gauges(log: DataFrame, store: TableStore, checkpoint: str, expires: str | None = None, name: str = "gauges", once: bool = True) -> StreamingQuery:
    """Keeps the store at the last job of each (model, concurrency), by ts and then job_id, while rows come in any order.

    A job that is older than what the store has changes nothing. expires, an interval: gauges whose job is so much older
    than the newest one leave the store. once: ends when all rows there are have been read, else goes on.
    """
    columns = [c.split()[0] for c in JOBS.split(", ")]

    def follow(batch: DataFrame, number: int) -> None:
        known = store.read(schema=JOBS).select(*columns)
        both = known.unionByName(batch.where("success").select(*columns))
        last = both.groupBy(*LEVEL).agg(F.max_by(F.struct(*[c for c in columns if c not in LEVEL]), F.struct("ts", "job_id")).alias("j")).select(*LEVEL, "j.*").select(*columns)
        gone = F.lit(False)
        if expires is not None:
            newest = last.agg(F.max("ts")).first()[0]
            gone = F.col("ts") < F.lit(newest) - F.expr(f"INTERVAL {expires}")
        store.upsert(last, token=f"{name}/{number}", remove=gone)

    started = log.writeStream.foreachBatch(follow).option("checkpointLocation", checkpoint)
    return (started.trigger(availableNow=True) if once else started).start()
