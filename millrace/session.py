"""A session with the settings that tests and the bench use; on a cluster the caller brings its own."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cores: int = 8, memory: str = "12g", **conf: str) -> SparkSession:
    base = {
        "spark.sql.shuffle.partitions": str(cores), "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": memory, "spark.sql.adaptive.enabled": "true",
    }
    return SparkSession.builder.master(f"local[{cores}]").config(map=base | conf).getOrCreate()
