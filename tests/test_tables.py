import random

import pytest
from pyspark.sql import functions as F

from guidepost.sources.tables import KeyedTable
from guidepost.streaming import jobs as S

SCHEMA = "id long, v string, ver int"


def data_files(path):
    return {p: p.stat().st_mtime_ns for p in path.rglob("data/**/*.parquet")}


def test_a_batch_rewrites_only_the_buckets_it_touches(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path), ["id"], buckets=16)
    rows = {i: ("first", 0) for i in range(400)}
    assert t.upsert(spark.createDataFrame([(i, *r) for i, r in rows.items()], SCHEMA)) == list(range(16))
    before = data_files(tmp_path)
    batch = [(3, "new", 2), (3, "late", 1), (900, "added", 1), (5, "old", -1)]
    touched = t.upsert(spark.createDataFrame(batch, SCHEMA), ["ver"])
    written = {p for p in data_files(tmp_path) if p not in before}
    assert 1 <= len(touched) <= 3 and len(written) == len(touched)
    assert all(data_files(tmp_path)[p] == m for p, m in before.items() if p in data_files(tmp_path))
    rows |= {3: ("new", 2), 900: ("added", 1)}
    assert {r.id: (r.v, r.ver) for r in t.read().collect()} == rows and t.versions() == [1, 2]
    assert {r.id: r.v for r in t.read(1).collect()} == {i: "first" for i in range(400)}
    t.upsert(spark.createDataFrame([(3, "newest", 3)], SCHEMA), ["ver"])
    t.upsert(spark.createDataFrame([(3, "last", 4)], SCHEMA), ["ver"])
    assert t.versions() == [3, 4] and len(data_files(tmp_path)) == 16 + 1  # one bucket has two versions
    assert {r.id: r.v for r in t.read().collect() if r.id == 3} == {3: "last"}


def test_a_batch_run_again_gives_the_same_version(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path), ["id"], buckets=4)
    add = lambda stored, new: stored.unionByName(new).groupBy("id").agg(F.max("v").alias("v"), F.sum("ver").cast("int").alias("ver"))
    t.merge(spark.createDataFrame([(i, "a", 1) for i in range(20)], SCHEMA), add, 1)
    for _ in range(2):
        t.merge(spark.createDataFrame([(i, "b", 10) for i in range(5)], SCHEMA), add, 2)
        assert {r.id: r.ver for r in t.read().collect()} == {i: 11 if i < 5 else 1 for i in range(20)}
    t.upsert(spark.createDataFrame([], SCHEMA), version=3)  # an empty batch is a version too
    assert t.versions() == [2, 3] and t.read().count() == 20
    with pytest.raises(ValueError):
        KeyedTable(spark, str(tmp_path / "none"), ["id"]).read()


def test_new_columns_and_null_keys(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path), ["id"], buckets=4)
    t.upsert(spark.createDataFrame([(1, "a", 1), (2, "b", 1)], SCHEMA))
    t.upsert(spark.createDataFrame([(2, "c", 2, 7)], SCHEMA + ", more int"))
    assert {(r.id, r.v, r.more) for r in t.read().collect()} == {(1, "a", None), (2, "c", 7)}


def walked(flags):
    m, misses, beats = 80.0, 0, 0
    for f in flags:
        m = max(0.0, m - 8) if f == "MISS" else min(100.0, m + 3) if f == "BEAT" else m
        misses, beats = misses + (f == "MISS"), beats + (f == "BEAT")
    return m, misses, beats


def test_meter_stream_spreads_a_hot_key(spark, tmp_path):
    r = random.Random(4)
    rows = [(1 if i % 3 == 0 else 100 + i % 40, i, r.choice(["MISS", "BEAT", "BEAT", "IN-LINE", None])) for i in range(6000)]
    df = spark.createDataFrame(rows, "k long, ts long, flag string")
    blocks = S.range_blocks(df, "k", ["ts"]).where("k = 1").groupBy("block").count().collect()
    assert len(blocks) > 1 and max(b["count"] for b in blocks) < 2000
    table = KeyedTable(spark, f"{tmp_path}/t", ["k"], 8)
    for n in range(3):  # three batches in the order of time; keys from 120 on only in the last
        part = df.where((F.col("ts") >= 2000 * n) & (F.col("ts") < 2000 * (n + 1)) & ((F.lit(n) == 2) | (F.col("k") < 120)))
        part.write.parquet(f"{tmp_path}/src/n={n}")
        stream = spark.readStream.schema(df.schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/src")
        S.drain(S.meter_stream(stream, table, ["ts"]), f"{tmp_path}/ckpt")
    got = {x.k: (x.meter, x.misses, x.beats) for x in table.read().collect()}
    keys = {k for k, _, _ in rows}
    assert got == {k: walked([f for q, t, f in rows if q == k and (t >= 4000 or k < 120)]) for k in keys}


def test_listener_keeps_the_counters_of_all_batches(spark, tmp_path):
    """More micro-batches than the progress history of a query holds."""
    for i in range(130):
        (tmp_path / "src").mkdir(exist_ok=True)
        (tmp_path / "src" / f"{i}.json").write_text('{"v": %d}\n{"v": 1}\n' % i)
    listener = S.HealthListener(spark, f"{tmp_path}/health", every=50)
    spark.streams.addListener(listener)
    try:
        src = spark.readStream.schema("v int").option("maxFilesPerTrigger", 1).json(f"{tmp_path}/src")
        tagged = S.observe_health(src.withColumn("drop_reason", F.when(F.col("v") >= 100, "large")))
        q = tagged.writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/ckpt").trigger(availableNow=True).start()
        q.awaitTermination()
        assert listener.wait(q.runId) and len(q.recentProgress) <= 100
    finally:
        spark.streams.removeListener(listener)
    got = {r.counter: (r.n, r.batches) for r in S.health_totals(spark, f"{tmp_path}/health").collect()}
    assert got["input"] == (260, 130) and got["dropped"][0] == 30 and got["accepted"][0] == 230
