"""Streaming jobs drained over the given tables, with batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources.documents import visible_text
from ..sources.tables import KeyedTable
from ..streaming import jobs as S
from . import views as V
from .registry import query, view

_FLAG = "CASE event_type WHEN 'error' THEN 'MISS' WHEN 'purchase' THEN 'BEAT' ELSE 'IN-LINE' END"
view("outcomes", f"SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, {_FLAG} AS flag FROM events")
_METER = """
WITH walk(user_id, i, meter, misses, beats) AS (
  SELECT DISTINCT user_id, 0::BIGINT, 80.0::DOUBLE, 0::BIGINT, 0::BIGINT FROM outcomes
  UNION ALL SELECT w.user_id, o.i, CASE o.flag WHEN 'MISS' THEN greatest(0, w.meter - 8) WHEN 'BEAT' THEN least(100, w.meter + 3) ELSE w.meter END, w.misses + (o.flag = 'MISS')::BIGINT, w.beats + (o.flag = 'BEAT')::BIGINT
  FROM walk w JOIN outcomes o ON o.user_id = w.user_id AND o.i = w.i + 1)
SELECT user_id, max_by(meter, i) AS meter, max(misses) AS misses, max(beats) AS beats FROM walk GROUP BY 1"""


def stream_of(spark, sf, table):
    """The table's file as an unbounded source, timestamps zoned."""
    schema = V.table(spark, sf, table).schema
    df = spark.readStream.schema(schema).parquet(f"{sf.rstrip('/')}/{table}*.parquet")
    return df.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema if f.dataType.typeName() == "timestamp_ntz"})


def flagged(df):
    return df.select("user_id", "event_id", "ts", F.when(F.col("event_type") == "error", "MISS").when(F.col("event_type") == "purchase", "BEAT").otherwise("IN-LINE").alias("flag"))


@query("st3_meter", _METER)
def _(spark, sf):
    """Batch form: one clamped-shift map per (user, minute), composed in order."""
    e = flagged(V.table(spark, sf, "events")).withColumn("minute", F.date_trunc("minute", "ts"))
    return S.meter_batch(e, "user_id", "minute", ["ts", "event_id"])


def in_parts(spark, df, part, n, name):
    """Write the rows of each ``part`` 0 to ``n - 1`` in turn and give the stream over all
    that has arrived, so that each is drained as batches of its own."""
    src = scratch_path(spark, name)
    for i in range(n):
        df.where(part == i).write.parquet(f"{src}/p={i}")
        yield spark.readStream.schema(df.schema).option("recursiveFileLookup", True).parquet(src)


@query("st3_meter_stream", _METER)
def _(spark, sf):
    """Stream form over a keyed table; the events arrive in three batches, by time."""
    e = flagged(V.table(spark, sf, "events")).withColumn("ts", F.col("ts").cast("timestamp"))
    at = e.agg(F.percentile_approx("ts", [1 / 3, 2 / 3]).alias("q")).first()["q"] or [None, None]
    part = F.when(F.col("ts") <= F.lit(at[0]), 0).when(F.col("ts") <= F.lit(at[1]), 1).otherwise(2)
    table, ckpt = KeyedTable(spark, scratch_path(spark, "meter"), ["user_id"], 16), scratch_path(spark, "meter-ckpt")
    for stream in in_parts(spark, e, part, 3, "meter-src"):
        S.drain(S.meter_stream(stream, table, ["ts", "event_id"]), ckpt)
    return table.read().select("user_id", "meter", "misses", "beats")


@query("st1_stream_dedup", """
SELECT user_id % 40 AS topic, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY 1, 2""")
def _(spark, sf):
    """Items with one content key arrive once while the watermark has not passed them."""
    e = stream_of(spark, sf, "events").select("ts", "user_id", "event_type", F.concat(F.lit("https://x.example.com/"), "user_id", F.lit("?utm_source="), F.col("event_id") % 5).alias("url"), F.upper("event_type").alias("title"))
    path = scratch_path(spark, "dedup")
    S.run_to_end(S.dedupe_stream(e, "ts", "60 days"), path)
    return spark.read.parquet(f"{path}/data").groupBy((F.col("user_id") % 40).alias("topic"), "event_type").agg(F.count("*").alias("n"))


@query("st2_page_change", "SELECT url, 1::INT AS batch_id FROM (SELECT url, arg_max(page_id, page_id) AS page_id FROM pages GROUP BY 1) WHERE page_id % 3 = 0")
def _(spark, sf):
    """Two snapshots of the pages arrive one after the other; edited pages are reported."""
    p = V.table(spark, sf, "pages").select("page_id", "url", visible_text(F.col("html"), None).alias("page_text"))
    edited = F.when(F.col("page_id") % 3 == 0, F.concat("page_text", F.lit(" updated"))).otherwise(F.col("page_text"))
    both = p.withColumn("snap", F.lit(0)).unionByName(p.withColumns({"page_text": edited, "snap": F.lit(1)}))
    table, out, ckpt = KeyedTable(spark, scratch_path(spark, "pages"), ["url"], 16), scratch_path(spark, "pages-out"), scratch_path(spark, "pages-ckpt")
    for stream in in_parts(spark, both, F.col("snap"), 2, "pages-src"):
        S.drain(S.page_changes(stream, table, out), ckpt)
    return spark.read.schema("url string, prev_hash string, cur_hash string, batch_id int").option("recursiveFileLookup", True).parquet(out).select("url", "batch_id")


@query("st4_event_upsert", "SELECT user_id, event_type, count(*) AS n, max_by(event_id, ts) AS event_id FROM events GROUP BY ALL")
def _(spark, sf):
    """Latest event per (user, type) through a keyed table, one version per batch.

    The events arrive in two batches, odd ids after even ones, so each batch also
    brings events older than the stored ones.
    """
    e = V.table(spark, sf, "events").select("user_id", "event_type", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    table, ckpt = KeyedTable(spark, scratch_path(spark, "upsert"), ["user_id", "event_type"], 16), scratch_path(spark, "upsert-ckpt")
    for stream in in_parts(spark, e, F.col("event_id") % 2, 2, "upsert-src"):
        S.drain(S.upsert_stream(stream, table, ["ts", "event_id"]), ckpt)
    n = V.table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return table.read().join(n, ["user_id", "event_type"]).select("user_id", "event_type", "n", "event_id")


@query("st5_health", "SELECT count(*) AS input, count(*) FILTER (event_type <> 'error') AS accepted, count(*) FILTER (event_type = 'error') AS dropped FROM events")
def _(spark, sf):
    """Counters of each micro-batch, written to a table by a listener and added up."""
    e = V.table(spark, sf, "events").select("event_id", "event_type")
    src, path = scratch_path(spark, "health-src"), scratch_path(spark, "health")
    e.repartition(6, "event_id").write.parquet(src)
    listener = S.HealthListener(spark, path)
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 2).parquet(src)
        tagged = stream.withColumn("drop_reason", F.when(F.col("event_type") == "error", "error"))
        q = S.observe_health(tagged).writeStream.format("noop").option("checkpointLocation", scratch_path(spark, "health-ckpt")).trigger(availableNow=True).start()
        q.awaitTermination()
        if not listener.wait(q.runId):
            raise TimeoutError("the counters of the run did not arrive")
    finally:
        spark.streams.removeListener(listener)
    return S.health_totals(spark, path).groupBy().pivot("counter", ["input", "accepted", "dropped"]).agg(F.first("n"))
