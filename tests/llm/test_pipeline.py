"""The stages of the pipeline, one after the other on the small tables, each against its own input."""

from __future__ import annotations

import re
import tracemalloc

import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from millrace.llm import components, simhash, tokens

DATA = "/root/testdata/sf0.01"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    tables = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        tables.append(docs.toPandas())
    start = spark.read.parquet(f"{DATA}/documents.parquet").toPandas()
    good, single, masked, mixed, packed = tables
    label = spark.read.parquet(f"{DATA}/labels.parquet").toPandas().set_index("doc_id").quality
    kept = label.index.isin(good.doc_id)
    assert kept[label == 1].mean() > 0.97 and list(good.columns) == list(start.columns)
    sets = {r.doc_id: simhash.shingles(r.text, 5) for r in good.itertuples()}
    left = sorted(single.doc_id)
    seen: dict = {}
    for i in left:
        for s in sets[i]:
            seen.setdefault(s, []).append(i)
    pairs = {(a, b) for x in seen.values() for a in x for b in x if a < b}
    assert not [p for p in pairs if len(sets[p[0]] & sets[p[1]]) >= 0.8 * len(sets[p[0]] | sets[p[1]])]
    for gone in set(good.doc_id) - set(left):  # each that went is like one of a smaller doc_id
        assert any(len(sets[gone] & sets[o]) >= 0.8 * len(sets[gone] | sets[o]) for o in sets if o < gone)
    assert sorted(masked.doc_id) == left and not any(re.search(r"@mail\d", t) for t in masked.text)
    assert list(mixed.columns) == list(start.columns) and set(mixed.doc_id) <= set(left) and mixed.groupby("doc_id").size().max() <= 3
    assert packed.groupby("sequence_id").length.sum().max() <= 1024 and set(packed.doc_id) == set(mixed.doc_id)


def test_packing_forgets_words(spark):
    """What a worker remembers for packing ends with the stage's task."""
    docs = spark.createDataFrame([(1, "a few words of one text"), (2, None)], "doc_id long, text string").repartition(1)
    assert dict(corpus_pipeline.STAGES)["packing"](spark, docs, DATA).count() == 2

    def remembered(_):
        from millrace.llm import tokens

        return [e.words for e in tokens._encoders.values()]

    cores = spark.sparkContext.defaultParallelism
    assert not any(spark.sparkContext.parallelize(range(cores), cores).mapPartitions(remembered).collect())


def test_stages_on_odd_rows(spark):
    """Repeated rows, one doc_id with two texts, rows without doc_id or text, a clashing column: what each stage keeps."""
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(3, long, "a"), (2, long + " x", "b"), (2, "another text of the same id that is like no other", "a"), (5, "one and the same", "a"), (5, "one and the same", "a"), (7, None, None), (8, "", "b"), (None, long.upper(), "a"), (None, "without an id but a text of its own", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS component", "2 AS place", "3 AS shard", "4 AS size")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["simhash"](spark, docs, DATA)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or -1, r.text or "") for r in kept.collect()) == [(-1, rows[8][1]), (2, rows[2][1]), (2, rows[1][1]), (5, "one and the same"), (7, "")]
    drawn = stages["mixing"](spark, docs, DATA)
    assert drawn.columns == docs.columns and {(r.doc_id, r.text) for r in drawn.collect()} <= {r[:2] for r in rows if r[1]}
    whole = [(i, f"{i} " + " ".join(f"a{i}b{j}" for j in range(400)), "a") for i in range(40)] + [(1, "a second text " * 100, "a")]
    once = stages["mixing"](spark, spark.createDataFrame(whole, "doc_id long, text string, source string"), DATA).collect()
    assert sorted((r.doc_id, r.text) for r in once) == sorted(r[:2] for r in whole)  # one source: its target is its size
    assert sum(stages["quality"](spark, docs, DATA).groupBy().count().first()) <= len(rows) and stages["pii"](spark, docs, DATA).count() == len(rows)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), DATA).count() == 0, name


def test_near_copies_by_fingerprints(spark):
    """Pairs of similarity 0.8 that share none of the bands, the odd ones of some thousand: their SimHashes bring them together."""
    rows = []
    for seed in (2709, 3498, 7183):
        rng = np.random.default_rng(seed)
        new = lambda n: [f"w{x}" for x in rng.integers(0, 1 << 40, n)]  # noqa: E731, B023
        common = new(80)
        rows += [(len(rows) + k, " ".join([*common * 10, *new(10)])) for k in (0, 1)]
        sets, prints = ([f(text, 5) for _, text in rows[-2:]] for f in (simhash.shingles, simhash.fingerprint))
        assert len(sets[0] & sets[1]) >= 0.8 * len(sets[0] | sets[1]) and (prints[0] ^ prints[1]).bit_count() <= 4
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in dict(corpus_pipeline.STAGES)["simhash"](spark, docs, DATA).collect()) == [0, 2, 4]


def test_workers_hold_little(spark):
    """What a worker allocates at once: encoding 4 MB of text took 51 MB, a cell of 100,000 fingerprints 123 MB."""
    rng = np.random.default_rng(1)
    words = np.array([f"w{i}" for i in range(2000)])
    encoder, texts = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json")), pa.array([" ".join(rng.choice(words, 400)) for _ in range(2000)])
    fps = rng.integers(0, 1 << 60, 100_000, dtype=np.uint64)
    for most, work in ((30, lambda: encoder.encode(texts)), (80, lambda: list(simhash._linked(fps, np.full(len(fps), 2), np.arange(len(fps)), 60, (0, 1))))):
        tracemalloc.start()
        work()
        peak = tracemalloc.get_traced_memory()[1] >> 20
        tracemalloc.stop()
        assert peak <= most


def test_what_workers_do_not_get(spark):
    """The key and the plans' rows start no Python workers of their own; of the quality stage they get texts only and send no rows back."""
    docs, stages = spark.read.parquet(f"{DATA}/documents.parquet"), dict(corpus_pipeline.STAGES)
    plan = lambda name: stages[name](spark, docs, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "ExistingRDD" not in plan("pii") and "ExistingRDD" not in plan("packing")
    assert "MapInArrow" not in plan("quality")


@pytest.mark.parametrize(("links", "rounds"), [([(1, 2), (3, 1), (7, 9), (4, 4), (None, 5)], 1), ([(1, 2), (2, 3), (3, 4), (9, 8), (8, 7)], 4), ([], 1)])
def test_components_end_with_stars(spark, links, rounds):
    """Links that are stars already need no round; before, two were made."""
    got = components.components(spark.createDataFrame(links, "a long, b long"), rounds).collect()
    ends = {x for link in links for x in link if None not in link and link[0] != link[1]}
    least = {1: 1, 2: 1, 3: 1, 4: 1, 7: 7, 8: 7, 9: 7}
    assert sorted((r.node, r.component) for r in got) == sorted((x, least[x]) for x in ends)
