"""Operators on embeddings against brute force, and their edge cases."""

from __future__ import annotations

import math

import numpy as np
import pytest

from millrace.llm import embeddings, topk

NAN = float("nan")
VECTORS = [(1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [NAN, 1.0]), (7, [1.0, None]), (8, [1.0, 0.0]), (9, [math.inf, 0.0]), (10, []), (11, [2.0]), (None, [1.0, 0.0])]


@pytest.fixture(scope="session")
def crowd(spark):
    rng = np.random.default_rng(1)
    far = rng.normal(size=(300, 16))
    near = far[:60].repeat(3, 0) + rng.normal(size=(180, 16)) * 0.12
    hub = far[0] + rng.normal(size=(120, 16)) * 0.05
    rows = np.concatenate([far, near, hub, far[:5]])
    return spark.createDataFrame([(i, x) for i, x in enumerate(rows.tolist())], "vec_id long, embedding array<double>").selectExpr("*", "'x' AS id", "1 AS weight", "2 AS cell"), rows


def test_near_duplicates(crowd, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 64)
    frame, rows = crowd
    unit = rows / np.linalg.norm(rows, axis=1)[:, None]
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    got = {r.vec_id: r for r in embeddings.near_duplicates(frame).collect()}
    found = sum(r.n_links for r in got.values())
    assert found >= 0.9 * near.sum() and all(got[i].n_links <= near[i].sum() for i in got)
    root = np.arange(len(rows))
    for _ in range(len(rows)):
        new = np.array([min(root[i], root[near[i]].min(initial=root[i])) for i in range(len(rows))])
        if (new == root).all():
            break
        root = new
    assert np.mean([got[i].component_id == root[i] for i in got]) > 0.95
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_near_duplicate_edges(spark):
    frame = spark.createDataFrame(VECTORS, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in embeddings.near_duplicates(frame).collect())
    linked = [(1, 3, 1, True), (2, 3, 1, False), (8, 3, 1, False), (11, 3, 1, False)]
    assert got == sorted(linked + [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 9, 10)])
    assert embeddings.near_duplicates(frame.limit(0)).count() == 0


def plain_top(rows, asked, k):
    ints = {i: np.floor(np.array(x) * 1024) for i, x in rows.items()}
    for q in asked:
        best = sorted((-int(ints[q] @ x), i) for i, x in ints.items() if i != q)[:k]
        yield from ((q, n, i, -s) for n, (s, i) in enumerate(best, 1))


def test_top_k(crowd, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 8)
    monkeypatch.setattr(topk, "DATA_BLOCK", 50)
    frame, rows = crowd
    want = sorted(plain_top(dict(enumerate(rows)), range(0, len(rows), 20), 10))
    assert sorted(tuple(r) for r in topk.top_k(frame, "vec_id % 20 = 0", 10).collect()) == want


def test_top_k_sends_what_groups_need(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(60, 24)) * 4
    rows = np.concatenate([centres[rng.integers(0, 60, 2900)] + rng.normal(size=(2900, 24)) * 0.1, rng.normal(size=(100, 24))])
    frame, told = spark.createDataFrame([(i, x) for i, x in enumerate(rows.tolist())], "vec_id long, embedding array<double>"), {}
    got = sorted(tuple(r) for r in topk.top_k(frame, "vec_id % 10 = 0", 10, told=told).collect())
    assert got == sorted(plain_top(dict(enumerate(rows)), range(0, 3000, 10), 10))
    assert told["vectors"] == 3000 and told["groups"] > 10 and told["sent"] < 0.2 * told["groups"] * 3000


def test_groups_of_queries_are_joined_by_what_they_need():
    points, asked = np.array([[0.0], [1.0], [10.0], [11.0]]), np.array([5, 5, 5, 5])
    everything = np.full((4, 4), 100.0)
    assert topk.joined_groups(points, asked, everything).tolist() == [0, 0, 0, 0]
    assert topk.joined_groups(points, asked, np.diag([100.0] * 4)).tolist() == [0, 1, 2, 3]
    assert topk.joined_groups(points, asked, np.repeat(np.diag([100.0, 100.0]), 2, axis=0)).tolist() == [0, 0, 2, 2]


@pytest.mark.parametrize("pivots", [64, 256, 1024, 4096])
def test_recall_with_any_number_of_pivots(pivots):
    """Pairs with a cosine of exactly 0.9 in 64 unrelated dimensions that share two of their nearest pivots."""
    rng = np.random.default_rng(7)
    x, z, points = (embeddings._unit(rng.normal(size=(n, 64))) for n in (2000, 2000, pivots))
    z = embeddings._unit(z - (z * x).sum(1)[:, None] * x)
    order = [np.argsort(-(v @ points.T), axis=1, kind="stable")[:, : embeddings.near_for(pivots)] for v in (x, 0.9 * x + math.sqrt(0.19) * z)]
    assert ((order[0][:, :, None] == order[1][:, None, :]).any(2).sum(1) >= 2).mean() > 0.99


def test_near_duplicates_of_floats(spark):
    rng = np.random.default_rng(8)
    rows = rng.normal(size=(400, 12)).astype("f4")
    rows[200:300] = rows[:100] + rng.normal(size=(100, 12)).astype("f4") * np.float32(0.1)
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(rows.tolist())], "vec_id long, embedding array<float>").selectExpr("*", "1 AS h1", "2 AS list")
    unit = embeddings._unit(rows.astype(float))
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    got = {r.vec_id: r.n_links for r in embeddings.near_duplicates(frame).collect()}
    assert sum(got.values()) >= 0.99 * near.sum() and all(n <= near[i].sum() for i, n in got.items())


def test_top_k_edges(spark):
    frame = spark.createDataFrame(VECTORS, "vec_id long, embedding array<double>")
    good = {1: [1.0, 0.0], 2: [1.0, 0.01], 3: [0.0, 1.0], 5: [0.0, 0.0], 8: [1.0, 0.0], 10: [0.0, 0.0], 11: [2.0, 0.0]}
    assert sorted(tuple(r) for r in topk.top_k(frame, "vec_id > 0", 4).collect()) == sorted(plain_top(good, good, 4))
    assert topk.top_k(frame.limit(0), "true", 4).count() == 0
