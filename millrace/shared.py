"""The folder that driver and executors share, for tables that cut a plan."""

from __future__ import annotations

import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder of our own where it is unset in local mode."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def _own_dir(spark: SparkSession) -> str:
    """The part of the shared folder that this application's tables are in."""
    return f"{shared_dir(spark)}/millrace/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Deletes the intermediate tables of this application; for its end, when no result that reads them is needed any more."""
    store, folder = fs.FileSystem.from_uri(_own_dir(spark))
    if store.get_file_info(folder).type == fs.FileType.Directory:
        store.delete_dir(folder)


def stored(df: DataFrame, name: str = "stored") -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: its plan ends there, and a lost executor costs nothing."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
