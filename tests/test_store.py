"""Committed tables, large JSON files, and streams that write to them."""

from __future__ import annotations

import json
import os
import random
import threading

import pytest
from pyspark.sql import functions as F

from millrace import shared
from millrace.operators import score
from millrace.sources import files, nested, sinks
from millrace.sources.store import TableStore
from millrace.streaming import jobs

SCHEMA = "rfp string, model string, n int"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_versions(spark, tmp_path):
    store = TableStore(spark, f"file://{tmp_path}/t", ["rfp", "model"], buckets=4)
    make = lambda v: spark.createDataFrame(v, SCHEMA)
    assert store.version() == 0 and store.read(schema=SCHEMA).count() == 0
    with pytest.raises(ValueError, match="no version yet"):
        store.read()
    many = [(f"r{i}", "m", i) for i in range(40)] + [(None, "m", 7)]
    assert store.upsert(make(many)) == 1
    before = store.read()
    assert store.upsert(make([("r1", "m", -1), ("r1", "m", -2), ("new", "m", 0), (None, "m", 8)]).coalesce(1), token="a") == 2
    want = [(a, b, {"r1": -2, None: 8}.get(a, n)) for a, b, n in many] + [("new", "m", 0)]
    assert rows(store.read()) == sorted(want, key=str) and rows(before) == rows(store.read(1)) == sorted(many, key=str)
    assert store.upsert(make([("r1", "m", 99)]), token="a") == 2  # tried again: nothing
    assert store.upsert(make([("r1", "m", 99), ("r50", "m", 1)]), token="b", replace=False) == 3
    assert rows(store.read()) == sorted([*want, ("r50", "m", 1)], key=str)
    assert store.upsert(make([])) == 4 and rows(store.read()) == sorted([*want, ("r50", "m", 1)], key=str)
    assert store.upsert(make([("r1", "m", 0)]).select("n", "model", "rfp"), remove=F.col("rfp") == "r1") == 5
    assert "r1" not in {r.rfp for r in store.read().collect()}
    with pytest.raises(ValueError, match="columns are"):
        store.upsert(make([]).drop("n"))
    with pytest.raises(ValueError, match="in 4 buckets"):
        TableStore(spark, f"file://{tmp_path}/t", ["rfp"], buckets=4).read()
    now = rows(store.read())
    assert store.vacuum(keep=1) > 0 and rows(store.read()) == now
    with pytest.raises(ValueError, match="no version 1"):
        store.read(1)


def test_a_failed_commit_leaves_the_old_version(spark, tmp_path):
    store = TableStore(spark, f"file://{tmp_path}/t", ["rfp", "model"], buckets=2)
    good = spark.createDataFrame([("a", "m", 1), ("b", "m", 2)], SCHEMA)
    store.upsert(good)
    bad = good.withColumn("n", F.when(F.col("rfp") == "b", F.raise_error(F.lit("lost"))).otherwise(5).cast("int"))
    with pytest.raises(Exception, match="lost"):
        store.upsert(bad, token="x")
    assert rows(store.read()) == [("a", "m", 1), ("b", "m", 2)] and store.version() == 1
    assert store.upsert(good.withColumn("n", F.col("n") + 1), token="x") == 2
    assert rows(store.read()) == [("a", "m", 2), ("b", "m", 3)]


def test_readers_see_one_version_while_commits_run(spark, tmp_path):
    store = TableStore(spark, f"file://{tmp_path}/t", ["rfp", "model"], buckets=4)
    table = lambda v: spark.range(200).select(F.concat(F.lit("r"), "id").alias("rfp"), F.lit("m").alias("model"), F.lit(v).cast("int").alias("n"))
    store.upsert(table(0))
    done, seen = threading.Event(), []

    def write() -> None:
        try:
            for v in (1, 2, 3):
                store.upsert(table(v))
        finally:
            done.set()

    writer = threading.Thread(target=write)
    writer.start()
    while not done.is_set():
        seen.append(tuple(store.read().agg(F.count("*"), F.count_distinct("n")).first()))
    writer.join()
    assert seen and set(seen) == {(200, 1)} and {r.n for r in store.read().collect()} == {3}


def test_upsert_takes_the_last_row(spark):
    repeated = spark.createDataFrame([("a", v) for v in range(5)] + [(None, 9)], "k string, v int").coalesce(1)
    assert rows(score.upsert(repeated.limit(0), repeated, ["k"])) == [("a", 4), (None, 9)]
    assert rows(score.upsert(repeated, spark.createDataFrame([(None, 1)], "k string, v int"), ["k"])) == [("a", 4), (None, 1)]
    assert [r.k for r in score.upsert(repeated, spark.createDataFrame([("c", 1), ("b", 1)], "k string, v int"), ["k"]).collect()] == [None, "a", "b", "c"]


ODD = ['x\\"y', "back\\\\", "{[,]}", "é日", "", "tail\\\\\\\\", 'q"\\', "line\nfeed", "a:b,c"]


@pytest.mark.parametrize("block", [1, 7, 64, 1 << 20])
@pytest.mark.parametrize("indent", [None, 2])
def test_json_in_blocks(spark, tmp_path, block, indent):
    rng = random.Random(block)
    value = lambda d: {rng.choice(ODD) + str(i): value(d - 1) for i in range(rng.randint(0, 3))} if d and rng.random() < 0.7 else rng.choice([*ODD, None, 3.5, True, [1, {"a": ["}"]}]])
    whole = {f"{rng.choice(ODD)}{i}": value(3) for i in range(12 if block == 1 else 60)}
    (tmp_path / "in.json").write_text(("\n  " if indent else "") + json.dumps(whole, indent=indent, ensure_ascii=False) + "\n", encoding="utf-8")
    states = nested.block_states(spark, str(tmp_path / "in.json"), max(block, 1))
    got = [(at, *nested.json.JSONDecoder().raw_decode(t.decode().strip())) for b in states for at, t in nested.Block(*b).entries() if t.strip()]
    assert [k for _, k, _ in sorted(got)] == list(whole)
    if block > 1:
        assert {r.key: json.loads(r.value) for r in nested.json_entries(spark, str(tmp_path / "in.json"), block).collect()} == whole


def test_json_of_many_files_and_odd_ones(spark, tmp_path):
    folder = tmp_path / "f"
    (folder / "sub").mkdir(parents=True)
    (folder / "a.json").write_text('{"k": {"m": 1}, "k": {"m": 2}}')  # the last entry of a key counts
    (folder / "sub" / "b.json").write_text("{}")
    (folder / "list.json").write_text("[1, 2]")
    (folder / ".hidden").write_text("{")
    assert rows(nested.json_entries(spark, f"file://{folder}")) == [("k", '{"m": 2}')]
    for text in ("{", '{"a": "', "no", "", '{"a": {}'):
        (tmp_path / "bad.json").write_text(text)
        with pytest.raises(ValueError, match="not JSON"):
            nested.json_entries(spark, str(tmp_path / "bad.json"))
    for text in ('{"a": tru}', '{"a" 1}', "{1: 2}"):
        (tmp_path / "bad.json").write_text(text)
        with pytest.raises(Exception, match="not JSON"):
            nested.json_entries(spark, str(tmp_path / "bad.json")).collect()


def test_intermediate_tables_can_be_cleared(spark):
    kept = shared.stored(spark.range(5), "some")
    folder = kept.inputFiles()[0].removeprefix("file://").rsplit("/", 2)[0]
    assert kept.count() == 5 and os.path.isdir(folder) and spark.sparkContext.applicationId in folder
    shared.clear(spark)
    shared.clear(spark)
    assert not os.path.exists(folder)


def test_results_as_a_folder_of_parts(spark, tmp_path):
    runs = spark.range(300).select(F.concat(F.lit("r"), F.col("id") % 100).alias("rfp"), F.concat(F.lit("m"), F.floor(F.col("id") / 100)).alias("model"), (F.col("id") % 2 == 0).alias("success"), F.create_map(F.lit("Budget"), F.concat(F.lit('"{'), "id")).alias("output"))
    path = f"file://{tmp_path}/parts"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be one part
    sinks.save_results(runs, path)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = sorted((tmp_path / "parts").glob("*.json"))
    keys = [list(json.loads(p.read_text())) for p in parts]
    assert len(parts) > 1 and sum(keys, []) == sorted(f"r{i}" for i in range(100))
    assert rows(files.benchmark_runs(spark, path).select("rfp", "model", "success", "output")) == rows(runs)
    with pytest.raises(FileExistsError):
        sinks.save_results(runs, path)
    sinks.save_results(runs.limit(0), f"{path}-none")
    assert files.benchmark_runs(spark, f"{path}-none").count() == 0


def test_empty_files_are_documents(spark, tmp_path):
    there = f"file://{tmp_path}/texts"
    sinks.save_texts(spark.createDataFrame([("a.txt", "x"), ("b é.txt", ""), ("c.txt", None), ("100%25.txt", "")], "rfp string, text string"), there)
    (tmp_path / "texts" / "d.md").write_text("")
    assert rows(files.text_files(spark, there)) == [("100%25.txt", ""), ("a.txt", "x"), ("b é.txt", ""), ("c.txt", "")]


def test_replayed_batches_add_nothing(spark, tmp_path):
    level = lambda m, c, v: (m, c, 4, 3, 1, 75.0, float(v), 3.8, 3.0, 60.0)
    folder, store = f"{tmp_path}/in", jobs.level_store(spark, f"file://{tmp_path}/levels")
    for k in range(3):
        spark.createDataFrame([level("m", k, 1), level("m", k + 1, 2)], files.CAPACITY).coalesce(1).write.mode("append").parquet(folder)
    for k in range(2):  # another run of the stream reads all files again
        jobs.commit_levels(jobs.level_stream(spark, folder, 1), store, f"{tmp_path}/log{k}", f"run {k}").awaitTermination()
    found = rows(store.read().select("model", "concurrency"))
    assert found == [("m", k) for k in range(4)]
    version = store.version()
    batch = spark.createDataFrame([level("m", 9, 1)], files.CAPACITY)
    store.upsert(batch, token="run 1/0", replace=False)  # a batch that was committed and comes again
    assert store.version() == version and rows(store.read().select("model", "concurrency")) == found


def test_gauges_follow_the_newest_job(spark, tmp_path):
    job = lambda m, n, v, ok, t: (m, 1, n, ok, float(v), t)
    folder, store = f"{tmp_path}/in", jobs.gauge_store(spark, f"file://{tmp_path}/gauges")
    made = lambda v: spark.createDataFrame(v, "model string, concurrency long, job_id long, success boolean, latency_s double, t string").withColumn("ts", F.to_timestamp("t")).drop("t").coalesce(1).write.mode("append").parquet(folder)
    follow = lambda expires=None: jobs.follow_gauges(jobs.log_stream(spark, folder, 1), store, f"{tmp_path}/log", expires).awaitTermination()
    made([job("a", 1, 5, True, "2024-01-01 10:00:00"), job("b", 2, 6, True, "2024-01-01 10:00:00"), job("a", 3, 7, False, "2024-01-01 11:00:00")])
    follow()
    assert rows(store.read().select("model", "job_id", "latency_s")) == [("a", 1, 5.0), ("b", 2, 6.0)]
    made([job("a", 4, 9, True, "2024-01-01 09:00:00"), job("a", 5, 8, True, "2024-01-01 10:00:00")])  # one is late, one as new but of a larger number
    follow()
    assert rows(store.read().select("model", "job_id", "latency_s")) == [("a", 5, 8.0), ("b", 2, 6.0)]
    made([job("a", 6, 1, True, "2024-01-03 10:00:00")])
    follow("1 day")
    assert rows(store.read().select("model", "job_id", "latency_s")) == [("a", 6, 1.0)]


def test_the_driver_holds_no_names_of_texts(spark, tmp_path, monkeypatch):
    from pyspark.sql import DataFrame

    there = f"file://{tmp_path}/texts"
    sinks.save_texts(spark.createDataFrame([(f"{i}%25 é.txt", "x" * i) for i in range(50)], "rfp string, text string"), there)
    for hidden in (".a.txt", "_b.txt", "c.csv"):
        (tmp_path / "texts" / hidden).write_text("no")
    (tmp_path / "texts" / "d.txt").mkdir()
    (tmp_path / "texts" / "e.txt").write_bytes(b"a\xffb")
    by_spark = sorted(map(tuple, files.text_files(spark, str(tmp_path / "texts")).collect()))
    monkeypatch.setattr(DataFrame, "inputFiles", lambda self: pytest.fail("names on the driver"))
    monkeypatch.setattr(files, "NAMES_SENT", 7)
    got = files.text_files(spark, there)
    assert sorted(map(tuple, got.collect())) == by_spark == sorted([("e.txt", "ab"), *((f"{i}%25 é.txt", "x" * i) for i in range(50))])
