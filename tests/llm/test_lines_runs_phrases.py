"""Line dedup, periodic runs and collocations against plain versions, and their edge cases."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import collocations, lines, periodic, queries
from millrace.llm.scan import word_hashes

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


# Lines


def plain_lines(rows, least=40, often=5):
    """(doc_id, n_lines, n_dropped, kept text) of rows (doc_id, text)."""
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    holders = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least:
                holders[key(line)].add(doc)
    last = {k: max(v) for k, v in holders.items() if len(v) >= often}
    out = []
    for doc, text in rows:
        parts = (text or "").split("\n")
        kept = [p for p in parts if last.get(key(p), doc) == doc]
        out.append((doc, len(parts), len(parts) - len(kept), "\n".join(kept)))
    return sorted(out)


def test_lines_query(spark, texts):
    got = sorted(tuple(r) for r in queries.op13_lines(spark, DATA).collect())
    want = [(d, n, k, sha(t)) for d, n, k, t in plain_lines(list(texts.items()))]
    assert got == want and sum(r[2] for r in want) > 0


@pytest.mark.parametrize(("batches", "fan_out"), [(1, 2), (7, 2), (7, 3)])
def test_lines_in_batches(spark, batches, fan_out):
    rng = np.random.default_rng(4)
    long = [f"{'Shared ' if k % 2 else 'élément É '}line number {k} " + "x" * 30 for k in range(12)]
    rows = [(int(i) * 3 % 101 + 1, "\n".join([f"own {i}", *(("\t" if rng.random() < 0.3 else "") + (w.upper() if rng.random() < 0.2 else w) + " " * int(rng.integers(0, 3)) for w in rng.choice(long, rng.integers(0, 9))), "short", ""])) for i in range(100)]
    rows += [rows[3], (rows[4][0], long[0] + "\nanother text of one doc_id")]
    got = lines.drop_lines(spark.createDataFrame(rows, "doc_id long, text string"), batches=batches, fan_out=fan_out)
    assert sorted(tuple(r) for r in got.collect()) == plain_lines(rows)


def test_line_runs_levels_and_settled_keys(spark):
    runs = lines.LineRuns(spark, enough=2, fan_out=2)
    batch = lambda *docs: spark.createDataFrame([(1, 1, d) for d in docs] + [(2, 2, docs[0])], "h1 long, h2 long, doc_id long")
    runs.add(batch(90, 91))
    assert [len(x) for x in runs.levels] == [1]
    runs.add(batch(80, 81))
    assert [len(x) for x in runs.levels] == [0, 1]
    kept = {r.h1: (r.n, r.largest) for r in spark.table(runs.levels[1][0]).collect()}
    assert kept == {1: (2, 91), 2: (2, 90)}  # the first key was settled: what came later isn't counted any more
    runs.add(batch(95))
    runs.add(batch(70))
    assert [len(x) for x in runs.levels] == [0, 0, 1]
    assert sorted(tuple(r) for r in runs.frequent().collect()) == [(1, 1, 95), (2, 2, 95)]
    runs.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run_")]


def test_lines_edges(edges, nothing, spark):
    rows = [(r.doc_id, r.text) for r in edges.collect() if r.doc_id is not None]
    assert sorted(tuple(r) for r in lines.drop_lines(edges).collect()) == plain_lines(rows)
    assert lines.drop_lines(nothing).count() == 0
    many = [(i, "\n".join(["the same line of forty letters and a few more", *([f"{i} {k}" for k in range(30000)] if i == 3 else [])])) for i in range(6)]
    got = sorted(tuple(r) for r in lines.drop_lines(spark.createDataFrame(many, "doc_id long, text string")).collect())
    assert got == plain_lines(many) and got[3][1:3] == (30001, 1)


# Runs


def plain_runs(words, least=24, times=3):
    """All maximal runs, by comparing the words with themselves at every distance."""
    n, codes, best = len(words), np.unique(words, return_inverse=True)[1] if words else np.zeros(0), {}
    for q in range(1, n // times + 1):
        same = np.r_[False, codes[:-q] == codes[q:], False]
        edges = np.flatnonzero(same[1:] != same[:-1])
        for start, end in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            length = end - start + q
            if length >= max(least, times * q) and (start, length) not in best:
                best[start, length] = q  # the smallest period comes first
    return sorted((s, n, q) for (s, n), q in best.items())


def plain_planted(doc, text):
    words = WORD.findall(text or "")
    h, n = zlib.crc32(str(doc).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    return words


def plain_row(doc, words):
    runs = plain_runs(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
    milli = 1000 * best[1] // best[2] if runs else None
    return doc, len(runs), *best, milli, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone))


def test_runs_query(spark, texts):
    got = sorted(tuple(r) for r in queries.op11_runs(spark, DATA).collect())
    assert got == sorted(plain_row(d, plain_planted(d, t)) for d, t in texts.items())
    assert sum(r[1] for r in got) > 10


@pytest.mark.parametrize(("least", "times"), [(24, 3), (6, 3), (12, 4)])
def test_runs_of(least, times):
    rng = np.random.default_rng(7)
    given = [[], ["a"], ["a"] * 23, ["a"] * 24, ["a"] * 500, list("ab") * 40, list("aab") * 20 + list("ab") * 30 + list("aab") * 9]
    for _ in range(300):
        words = []
        while len(words) < 150:
            part = [f"w{x}" for x in rng.integers(0, int(rng.integers(1, 5)), int(rng.integers(1, 12)))]
            words += part * int(rng.integers(1, 8)) + part[: int(rng.integers(0, len(part)))]
        given.append(words)
    nested = ["x", "y", "y", "y", "y"] * 6  # runs within runs
    given += [nested * 5, [*nested, "z"] * 4, ["pre", *nested * 3, "post"]]
    hashed = [word_hashes(" ".join(w).encode()) for w in given]
    assert periodic.runs_of(hashed, least, times) == [plain_runs(w, least, times) for w in given]
    assert [periodic.runs_of([h], least, times)[0] for h in hashed[-40:]] == [plain_runs(w, least, times) for w in given[-40:]]


def test_a_line_with_many_left_words_is_no_quadratic_work():
    words = [w for k in range(20000) for w in (f"own{k}", *(f"common{i}" for i in range(20)))]
    assert periodic.runs_of([word_hashes(" ".join(words).encode())]) == [[]]
    assert periodic.runs_of([word_hashes(b"word " * 200_000)]) == [[(0, 200_000, 1)]]


def test_runs_edges(edges, nothing, spark):
    got = {r.doc_id: (r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic.find_runs(edges).collect()}
    assert got[1] == got[2] == got[7] == (0, [], "") and got[6] == (5000, [(0, 5000, 1)], "word") and got[3] == (1, [], "one") and None not in got
    assert periodic.find_runs(edges).where("doc_id = 4").count() == 2 and periodic.find_runs(nothing).count() == 0
    null = queries._planted(spark.createDataFrame([(n, t) for n in range(30) for t in (None, "", " \n")], "doc_id long, text string"))
    assert {r.n_words for r in periodic.find_runs(null).collect()} == {0}
    with pytest.raises(ValueError, match="three"):
        periodic.find_runs(edges, times=2)


# Collocations


def plain_phrases(rows, least=10, top=2000, contained=50):
    counts, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = Counter()
        for p, a in found.items():
            if len(p) == 3:
                for part in (p[:2], p[1:]):
                    inside[part] = max(inside[part], a)
        scored = []
        for p, a in found.items():
            if p in inside and 100 * inside[p] >= contained * a:
                continue
            score, _, left, right = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def test_collocations_query(spark, docs):
    rows = [(r.lang, r.text) for r in docs.select("lang", "text").collect()]
    assert sorted(tuple(r) for r in queries.op12_collocations(spark, DATA).collect()) == plain_phrases(rows)


@pytest.mark.parametrize("listed", [1 << 21, 40, 12])
@pytest.mark.parametrize("tiles", [collocations.Tiles(), collocations.Tiles(band=4, cells=64, held=300, part=10, fan=2)])
def test_collocations_in_small_tiles_and_beyond_the_listed_ids(spark, listed, tiles):
    rng = np.random.default_rng(11)
    vocabulary = [f"{w}{i}" for i in range(60) for w in ("Éa", "wo", "日")]
    weights = 1 / np.arange(1, len(vocabulary) + 1)
    rows = []
    for k in range(120):
        words = rng.choice(vocabulary, int(rng.integers(0, 120)), p=weights / weights.sum())
        text = "".join(w + rng.choice([" ", "  ", "\t", ". ", ",", "\n", " New York City "], p=[0.6, 0.1, 0.1, 0.05, 0.05, 0.05, 0.05]) for w in words)
        rows.append((["en", "fr", None][k % 3] if k % 7 else "en", text))
    want = plain_phrases(rows, least=4, top=50)
    got = collocations.collocations(spark.createDataFrame(rows, "lang string, text string").repartition(5), least=4, top=50, listed=listed, tiles=tiles)
    assert sorted(tuple(r) for r in got.collect()) == want and len({r[0] for r in want}) == 3


def test_collocations_edges(edges, nothing, spark):
    assert collocations.collocations(nothing.withColumn("lang", F.lit("en"))).count() == 0
    odd = edges.select("*", F.lit(None).cast("string").alias("lang"))
    assert sorted(tuple(r) for r in collocations.collocations(odd).collect()) == plain_phrases([(None, r.text) for r in odd.collect()])
    long = spark.createDataFrame([("en", "one two three " * 200_000), ("en", None), (None, "!!! ... \n")], "lang string, text string")  # a piece that can't be cut
    assert sorted(tuple(r) for r in collocations.collocations(long).collect()) == plain_phrases([tuple(r) for r in long.collect()])
