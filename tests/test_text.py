"""Text functions against plain Python on fuzzed strings, and their fixed cases."""

from __future__ import annotations

import difflib
import re
import unicodedata

from hypothesis import Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import text, udfs

ALPHABET = st.sampled_from(list("abcXYZ 019.,;:-–&@$%/\n\t\"'éßİ\xa0\x1c") + ["not specified", "N/A", "http://", "one", "ten", "%", "section", "a@b.ca"])
STRINGS = st.lists(ALPHABET, max_size=14).map("".join)


def plain_clean(value):
    value = value.strip()
    simple = re.sub(r"\s+", " ", value.lower()).strip(" .;:")
    return None if not value or simple in text.EMPTY_WORDS or simple.startswith(tuple(text.MISSING_PREFIXES)) else value


def plain_norm(value):
    return re.sub(r"\s+", " ", (plain_clean(value) or "").lower()).strip(" .;:")


def plain_missing(value):
    return re.sub(r"\s+", " ", value.strip().lower()).strip(" .;:") in text.MISSING_PHRASES


def plain_comparable(value):
    value = "" if plain_missing(value) else unicodedata.normalize("NFKD", value.strip())
    value = value.replace("–", "-").replace("—", "-").replace("&", " and ").lower()
    return " ".join(re.sub("[^a-z0-9@.$%:/+-]+", " ", re.sub("https?://", "", value)).split())


@settings(max_examples=4, deadline=None, phases=[Phase.generate], derandomize=True)
@given(st.lists(STRINGS, min_size=60, max_size=60))
def test_functions_agree_with_python(spark, values):
    frame = spark.createDataFrame(list(enumerate(values)), "i int, s string")
    s = F.col("s")
    rows = frame.select(
        "s", text.clean_value(s).alias("clean"), text.normalize_text(s).alias("norm"), text.is_missing(s).alias("missing"), udfs.normalized(s).alias("comparable"),
        text.keyword_tokens(s).alias("keywords"), text.emails(s).alias("emails"), text.heading_only(s).alias("heading"), text.reference_count(s).alias("count"),
    ).collect()
    for r in rows:
        norm = plain_norm(r.s)
        assert (r.clean, r.norm, r.missing, r.comparable) == (plain_clean(r.s), norm, plain_missing(r.s), plain_comparable(r.s)), repr(r.s)
        assert r.keywords == list(dict.fromkeys(re.findall(r"[a-z0-9@.$%+-]{4,}", r.s.lower())))
        assert set(r.emails) == set(re.findall(text.EMAIL, r.s))
        heading = not norm or (len(norm) <= 90 and any(h in norm for h in text.HEADINGS) and not re.search(text.HEADING_DETAIL, norm))
        assert r.heading == heading
        number = re.search(r"\b(\d+)\b", norm)
        words = [str(i) for i, w in enumerate(text.NUMBER_WORDS, 1) if re.search(rf"\b{w}\b", norm)]
        assert r["count"] == (number[1] if number else words[0] if words else None), repr(r.s)


def test_ratio_and_f1(spark):
    pairs = [("tide", "diet"), ("a" * 250 + "b", "b" + "a" * 250), ("", ""), ("x", None), ("minimum of three", "three at least")]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", udfs.seq_ratio("a", "b").alias("r"), text.token_f1(text.tokens(F.col("a")), text.tokens(F.coalesce("b", F.lit("")))).alias("f")).collect()
    for r in rows:
        assert r.r == (None if r.b is None else difflib.SequenceMatcher(None, r.a, r.b).ratio())
        a, b = set(re.findall("[a-z]+", r.a)), set(re.findall("[a-z]+", r.b or ""))
        assert r.f == (1.0 if not a and not b else 2 * len(a & b) / (len(a) + len(b)) if a and b else 0.0)


def test_rounding_is_pythons(spark):
    import random

    random.seed(4)
    values = [0.125, 2.675, 1.005, 0.5, 1.5, 2.5, -2.675, -0.125, 0.0, 99.995, 2192133.56735, 1e9 + 0.125, 33.335, 1 / 3, None]
    values += [random.randrange(10**9) / 10**random.randrange(8) for _ in range(2000)] + [random.randrange(10**7) / 2**random.randrange(12) for _ in range(2000)] + [(2 * random.randrange(10**6) + 1) / 200 for _ in range(2000)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", *[text.python_round(F.col("v"), d).alias(f"r{d}") for d in (0, 2, 4)]).collect()
    for r in rows:
        assert (r.r0, r.r2, r.r4) == ((None,) * 3 if r.v is None else (round(r.v), round(r.v, 2), round(r.v, 4))), r.v


def test_answers(spark):
    raws = {
        '{"a": 1}': (True, True, [("a", "1")]), '```json\n{"a": "x"}\n```': (False, True, [("a", "x")]), '<think>{"n": 1}</think>{"a": true}': (False, True, [("a", "True")]),
        'Here {bad} {"b": [1, 2.50], "c": {"é": null}, "d": null} tail': (False, True, [("b", "[1,2.5]"), ("c", '{"é":null}'), ("d", None)]), '[{"a": 1}]': (False, True, [("a", "1")]),
        '{"a": 1': (False, False, None), "": (False, False, None), '{"a": 1, "b": 2, "a": 3}': (True, True, [("a", "3"), ("b", "2")]), "{}": (True, True, []), None: (False, False, None),
    }
    rows = spark.createDataFrame([(r,) for r in raws], "raw string").select("raw", udfs.parse_answer("raw").alias("p")).collect()
    for r in rows:
        assert (r.p.raw_ok, r.p.ok, None if r.p.entries is None else [(e.key, e.value) for e in r.p.entries]) == raws[r.raw], r.raw


def test_excerpt(spark):
    source = "x" * 2000 + " Budget here " + "y" * 2000
    frame = spark.createDataFrame([(source, "Budget", "nothing known"), (source, "zzzz", "zz"), ("  short ", "a", "b"), (None, "a", "b")], "s string, f string, v string")
    got = [r[0] for r in frame.select(text.source_excerpt(F.col("s"), F.col("f"), F.col("v"))).collect()]
    assert got == [source[1551:2451].strip(), source[2006 - 450 : 2006 + 450].strip(), "short", ""]
    assert frame.select(text.source_excerpt(F.col("s"), F.col("f"), F.col("v"), fallback=False)).first()[0] == source[2006 - 450 : 2006 + 450].strip()


def test_sql_names(spark):
    udfs.register(spark)
    assert spark.sql("SELECT seq_ratio('tide', 'diet') AS r, nfkd_norm('é') AS n").first()[0] == difflib.SequenceMatcher(None, "tide", "diet").ratio()
    row = spark.sql("SELECT raw_json_valid(' {\"a\": 1} ') AS a, raw_json_valid('[1]') AS b, raw_json_valid(NULL) AS c, chunk_text(repeat('line of text\\n', 1000)) AS t, chunk_text(NULL) AS n").first()
    assert (row.a, row.b, row.c, row.n) == (True, False, False, []) and len(row.t) == 2 and row.t[0].startswith("line of text") and max(map(len, row.t)) <= 8000


def test_a_candidate_is_cleaned_once_for_each_use(spark):
    """Filters on cleaned values work them out once and once more for the result, however often their conditions name them."""
    from pyspark.sql import functions as F

    from millrace.functions import text
    from millrace.operators import extract

    odd = [("k", i, v) for i, v in enumerate(["A", "a ", " N/A", "", "B\t\nb", "b  B.", "K", "k", "not stated: x", "é\x85 é", None])]
    values = spark.createDataFrame(odd, "k string, n int, value string").withColumn("value", text.clean_value(F.col("value")))
    found = extract.first_candidates(values, ["k"], ["n"])
    assert [r.value for r in found.orderBy("idx").collect()] == ["A", "B\t\nb", "K", "é\x85 é"]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") <= 16
