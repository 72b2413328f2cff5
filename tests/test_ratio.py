"""The sequence ratio of batches against the standard library, pair by pair."""

from __future__ import annotations

import difflib
import random

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.functions import ratio, udfs


def made(rng: random.Random) -> tuple[str, str]:
    letters = rng.choice(["ab", "abc", "abcdefgh ", "etaoin shrdlucmf wypvbgkq ", "é日ab \U0001f600"])
    one = "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 3, 10, 40, 120, 199, 200, 201, 260, 500])))
    if rng.random() < 0.4:
        return one, "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 5, 50, 199, 200, 210, 400])))
    two = list(one)
    for _ in range(rng.randint(0, 12)):
        at = rng.randint(0, len(two))
        kind = rng.random()
        if kind < 0.4:
            two[at:at] = list(rng.choice(["x", "hello", "ab", "ZZ"]))
        elif kind < 0.8:
            del two[at : at + rng.randint(1, 20)]
        else:
            two = two[at:] + two[:at]
    return one, "".join(two)


def plain(pairs):
    return [difflib.SequenceMatcher(None, a, b).ratio() for a, b in pairs]


@pytest.mark.parametrize("points", [1 << 21, 300])
def test_equal_to_the_standard_library(points, monkeypatch):
    monkeypatch.setattr(ratio, "POINTS", points)
    rng = random.Random(3)
    pairs = [made(rng) for _ in range(1500 if points > 300 else 300)]
    want = plain(pairs)
    assert ratio.ratios(*zip(*pairs, strict=True), [-1.0] * len(pairs)).tolist() == want
    least = [rng.random() for _ in pairs]
    got = ratio.ratios(*zip(*pairs, strict=True), least)
    assert [max(g, x) for g, x in zip(got.tolist(), least, strict=True)] == [max(w, x) for w, x in zip(want, least, strict=True)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="ab é\n", max_size=30), st.text(alphabet="ab é\n", max_size=30)), min_size=1, max_size=8))
def test_any_pairs(pairs):
    assert ratio.ratios(*zip(*pairs, strict=True), [-1.0] * len(pairs)).tolist() == plain(pairs)


def test_common_letters_start_no_block():
    long = "a" * 150 + "Q" + "b" * 150
    pairs = [(long, "b" * 150 + "Q" + "a" * 150), ("a" * 300, "a" * 300), ("xa" * 100, "ya" * 100), (long, long[::-1]), ("Q" + "a" * 250, "a" * 250 + "Q")]
    assert ratio.ratios(*zip(*pairs, strict=True), [-1.0] * len(pairs)).tolist() == plain(pairs)


def test_udf_keeps_nulls_and_order(spark):
    pairs = [("abc", "abd"), (None, "x"), ("abc", "abd"), ("", ""), ("x", None), ("dba", "cba")]
    got = [r[0] for r in spark.createDataFrame(pd.DataFrame(pairs, columns=["a", "b"])).coalesce(1).select(udfs.seq_ratio("a", "b")).collect()]
    assert got == [None if None in p else plain([p])[0] for p in pairs]
