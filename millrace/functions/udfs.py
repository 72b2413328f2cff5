"""The few functions that Spark has no expression for, as Arrow-batched UDFs."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, StringType, StructField, StructType

from . import ratio, text
from .spans import spans

ENTRY = StructType([StructField("pos", IntegerType()), StructField("key", StringType()), StructField("value", StringType())])
ANSWER = StructType([StructField("raw_ok", BooleanType()), StructField("ok", BooleanType()), StructField("entries", ArrayType(ENTRY))])
_THINKING = re.compile(r"<think>.*?</think>", re.S | re.I)
_FENCES = re.compile("```(?:json|JSON)?")


@F.pandas_udf(StringType())
def nfkd(values: pd.Series) -> pd.Series:
    """Unicode compatibility decomposition."""
    return values.map(lambda s: unicodedata.normalize("NFKD", s), na_action="ignore")


@F.pandas_udf(DoubleType())
def seq_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-blocks ratio of two strings in this order; null for a null."""
    return ratios(a, b, [-1.0] * len(a))


@F.pandas_udf(DoubleType())
def seq_ratio_above(a: pd.Series, b: pd.Series, least: pd.Series) -> pd.Series:
    """seq_ratio where it may exceed `least`, else it or 0: enough for the larger of the two."""
    return ratios(a, b, least)


def ratios(a: pd.Series, b: pd.Series, least: Iterable[float]) -> pd.Series:
    """ratio.ratios() of the pairs without a null, each once: pairs repeat within a batch."""
    rows = pd.DataFrame({"a": a, "b": b, "least": least})
    known = rows.dropna(subset=["a", "b"]).drop_duplicates()
    known = known.assign(ratio=ratio.ratios(known["a"].tolist(), known["b"].tolist(), known["least"].to_numpy()))
    return rows.merge(known, "left", ["a", "b", "least"])["ratio"].astype("float64")


def _object(raw: str) -> dict | None:
    try:
        value = json.loads(raw)
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def lenient_object(raw: str | None) -> dict | None:
    """The answer's JSON object: without thinking and fences the whole text, else the first that starts at a brace."""
    if not raw:
        return None
    body = _FENCES.sub("", _THINKING.sub("", raw.strip())).strip()
    found, at, reader = _object(body), body.find("{"), json.JSONDecoder()
    while found is None and at >= 0:
        try:
            found = reader.raw_decode(body, at)[0]
        except (ValueError, RecursionError):
            at = body.find("{", at + 1)
    return found


def _text(value: object) -> str | None:
    if isinstance(value, dict | list):
        return json.dumps(value, ensure_ascii=False, separators=(",", ":"))
    return None if value is None else str(value)


@F.pandas_udf(ANSWER)
def parse_answer(raw: pd.Series) -> pd.DataFrame:
    """raw_ok: the whole text is one JSON object; ok and entries: what the lenient reading finds, in order."""
    rows = []
    for r in raw:
        found = lenient_object(r)
        entries = None if found is None else [{"pos": i, "key": k, "value": _text(v)} for i, (k, v) in enumerate(found.items())]
        rows.append((r is not None and _object(r.strip()) is not None, found is not None, entries))
    return pd.DataFrame(rows, columns=["raw_ok", "ok", "entries"])


def normalized(c: Column) -> Column:
    """Scoring's normal form of a value."""
    return normalized_clean(text.clean_missing_text(c))


def normalized_clean(cleaned: Column) -> Column:
    """Scoring's normal form of a cleaned value; only values that are not ASCII go through Python."""
    other = F.when(~text.is_ascii(cleaned), cleaned)
    return text.comparable(F.coalesce(nfkd(other), cleaned))


@F.pandas_udf(BooleanType())
def raw_json_valid(raw: pd.Series) -> pd.Series:
    """The whole stripped text is one JSON object."""
    return pd.Series([r is not None and _object(r.strip()) is not None for r in raw], dtype="bool")


@F.pandas_udf(ArrayType(StringType()))
def chunk_text(text: pd.Series) -> pd.Series:
    """The chunks of a document in order, blank ones left out."""
    wholes = [(t or "").strip() for t in text]
    return pd.Series([[part for start, end in spans(w) if (part := w[start:end].strip())] for w in wholes], dtype="object")


def register(spark: SparkSession) -> None:
    """Names for SQL."""
    for name, f in (("nfkd_norm", nfkd), ("seq_ratio", seq_ratio), ("lenient_json", parse_answer), ("raw_json_valid", raw_json_valid), ("chunk_text", chunk_text)):
        spark.udf.register(name, f)
