from __future__ import annotations

import pytest

DATA = "/root/testdata/sf0.001"
#: Nulls, empty and long texts, ties, repeated rows, and columns whose names the operators use themselves.
EDGES = [
    (1, None, "a", "x"), (2, "", None, "x"), (3, "one", "a", None), (4, "the same text of a few words here and now", "b", "x"), (4, "the same text of a few words here and now", "b", "x"),
    (5, "The same text of a few words here and NOW", "b", "y"), (6, "word " * 5000, "c", "x"), (7, " \t\n ", "c", "x"), (8, "é ß ü 日本語 <|endoftext|> x", "a", "x"),
    (None, "no id", "a", "x"),
]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="session")
def edges(spark):
    return spark.createDataFrame(EDGES, "doc_id long, text string, source string, id string").selectExpr("*", "'z' AS fp", "1 AS length", "2 AS size", "3 AS key", "4 AS n")


@pytest.fixture(scope="session")
def nothing(edges):
    return edges.limit(0)
