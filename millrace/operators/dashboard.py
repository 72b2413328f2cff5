"""The queries behind the report pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import natural_number, python_round

#: Display names of metrics.
METRIC_NAMES = {
    "field_accuracy_pct": "Field Accuracy", "avg_field_similarity_pct": "Field Similarity", "completeness_pct": "Completeness",
    "hallucination_rate_pct": "Hallucination Rate", "wrong_value_rate_pct": "Wrong Value Rate",
}


def relabelled(column: Column, names: dict[str, str] = METRIC_NAMES) -> Column:
    """Display name; null for an unknown one."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), column) if names else F.lit(None).cast("string")


def melted(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """(keys, metric, percent): a row for each metric under its display name."""
    return df.unpivot(keys, metrics, "metric", "percent").withColumn("metric", relabelled(F.col("metric")))


def chosen(df: DataFrame, column: str, values: list) -> DataFrame:
    return df.where(F.col(column).isin(values))


def extreme_row(df: DataFrame, metric: str, order: str, largest: bool = True) -> DataFrame:
    """The row of the largest (smallest) metric, the first by `order` on ties."""
    by = F.struct(F.col(metric) if largest else -F.col(metric), -F.col(order))
    return df.agg(F.max_by(F.struct(*df.columns), by).alias("r")).select("r.*")


def natural_order(df: DataFrame, column: str) -> DataFrame:
    """Distinct names that aren't null, by the number in them, then by name."""
    return df.where(F.col(column).isNotNull()).select(F.col(column).alias("name")).distinct().withColumn("number", natural_number(F.col("name"))).orderBy("number", "name")


def model_union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, [f.select("model") for f in frames]).distinct().orderBy("model")


def colours(models: DataFrame, palette: int) -> DataFrame:
    """A colour number for each model in order of names; the list of models is small."""
    return models.select("model").distinct().withColumn("colour", ((F.row_number().over(Window.orderBy("model")) - 1) % palette).cast("int"))


def gauges(rows: DataFrame, metrics: list[str], order: str) -> DataFrame:
    """(metric, model, value): the last row of a model by `order` counts."""
    last = rows.groupBy("model").agg(*[F.max_by(m, order).alias(m) for m in metrics])
    return last.unpivot(["model"], metrics, "metric", "value").select("metric", "model", "value")


def percent_text(c: Column) -> Column:
    """Two digits, rounded as Python does."""
    return F.format_string("%.2f", python_round(c, 2))


def thousands(c: Column) -> Column:
    return F.format_number(c, 0)
