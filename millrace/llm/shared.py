"""Helpers that several corpus operators use."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import new_path, shared_dir, stored  # noqa: F401

#: What the contracts call a word, as a Java and a Python pattern: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


@contextmanager
def small_batches(spark: SparkSession, rows: int = 512) -> Iterator[None]:
    """Within it, whole texts travel to Python in batches of so many rows, so that long ones don't add up; then the session's setting is back.

    For what is written within it: a plan that is run later has the caller's setting.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches as Spark sends them, bounded in bytes by its own setting, in parts of so many rows, whose results then don't add up."""
    for b in batches:
        for at in range(0, len(b), rows):
            yield b.slice(at, rows)


def give_back() -> None:
    """Gives the system what this worker has freed, which else stays with it while other stages run."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc
        trim(0)


def small_table(spark: SparkSession, rows: list[tuple], schema: pa.Schema) -> DataFrame:
    """A table of a few rows that the driver has; it comes as Arrow data, so executors start no Python workers for it."""
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return spark.createDataFrame(pa.table([pa.array(x, f.type) for x, f in zip(columns, schema, strict=True)], schema=schema))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z, as the contracts ask; other letters may be lower-cased too, but none of them becomes an ASCII one.

    Lower case maps two others to ASCII letters: the Kelvin sign and, with a mark after it, the dotted capital I.
    """
    return F.lower(F.replace(F.replace(text, F.lit("\u212a"), F.lit("\u0138")), F.lit("\u0130"), F.lit("\u0131")))


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def broadcast_if_small(ids: DataFrame, most_rows: int = 2_000_000) -> DataFrame:
    """A stored table of a few numbers a row, to be broadcast if it has at most so many rows; else the join shuffles."""
    return F.broadcast(ids) if ids.count() <= most_rows else ids
