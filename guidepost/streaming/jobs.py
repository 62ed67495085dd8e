"""Structured Streaming jobs: dedupe, page changes, credibility meter, event upsert, health."""

from __future__ import annotations

import threading

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..functions.values import item_key
from ..operators.joins import snapshot_diff
from ..sources.tables import KeyedTable

# Fixed values of the meter.
START, MISS_STEP, BEAT_STEP, FLOOR, CEILING = 80.0, -8.0, 3.0, 0.0, 100.0


def run_to_end(stream: DataFrame, path: str, mode: str = "append") -> None:
    """Drain what has arrived into parquet and stop."""
    q = (
        stream.writeStream.format("parquet").outputMode(mode).option("path", f"{path}/data")
        .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    )
    q.awaitTermination()


def dedupe_stream(items: DataFrame, ts: str, horizon: str = "2 days", url: str = "url", title: str = "title") -> DataFrame:
    """First item per content key within the horizon; state older than that is dropped."""
    keyed = items.withColumn("uid", item_key(F.col(url), F.col(title)))
    return keyed.withWatermark(ts, horizon).dropDuplicatesWithinWatermark(["uid"])


def page_changes(pages: DataFrame, table: KeyedTable, out_path: str, text: str = "page_text", order: str = "page_id"):
    """``foreachBatch`` handler: compare each batch with the digests kept by key and move
    these on. Only the buckets that the batch touches are read and written; a batch that
    is run again reads the version it read before and writes the same result."""
    key = table.keys[0]

    def handle(batch: DataFrame, batch_id: int) -> None:
        def move_on(stored: DataFrame, now: DataFrame) -> DataFrame:
            changed, state = snapshot_diff(stored, now, key, "digest")
            changed.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")
            return state

        table.merge(batch.groupBy(key).agg(F.max_by(F.sha1(text), order).alias("digest")), move_on, batch_id + 1)

    return pages.writeStream.foreachBatch(handle)


def clamp_map(flag: Column) -> Column:
    """One outcome as a map x -> min(hi, max(lo, x + add))."""
    miss, beat = flag == "MISS", flag == "BEAT"
    return F.struct(
        F.when(miss, MISS_STEP).when(beat, BEAT_STEP).otherwise(0.0).alias("add"),
        F.when(miss, FLOOR).otherwise(F.lit(float("-inf"))).alias("lo"),
        F.when(beat, CEILING).otherwise(F.lit(float("inf"))).alias("hi"))


def _then(f: Column, g: Column) -> Column:
    """Composition g after f; clamped shifts are closed under it."""
    bound = lambda x: F.least(g["hi"], F.greatest(g["lo"], x + g["add"]))
    return F.struct((f["add"] + g["add"]).alias("add"), bound(f["lo"]).alias("lo"), bound(f["hi"]).alias("hi"))


def range_blocks(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows with the number of their ``block``: ranges of (key, order) of about equal size,
    so that a key with a third of all rows has a third of the blocks."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(n, key, *order).withColumn("block", F.spark_partition_id())


def meter_maps(outcomes: DataFrame, key: str, block: str, order: list[str], flag: str = "flag") -> DataFrame:
    """All outcomes of a key as one map ``m``, with ``misses`` and ``beats``.

    The clamps make plain sums wrong, but clamped shifts compose: each (key, block)
    is folded to one small map in its own task and the maps are folded in block
    order, so a key with a third of all rows is spread over its blocks.
    """
    ident = F.struct(F.lit(0.0).alias("add"), F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"))
    step = outcomes.select(key, block, F.struct(*order, clamp_map(F.col(flag)).alias("m"), F.col(flag).alias("flag")).alias("s"))
    fold = lambda arr, get: F.aggregate(arr, ident, lambda a, x: _then(a, get(x)))
    blocks = step.groupBy(key, block).agg(
        fold(F.sort_array(F.collect_list("s")), lambda x: x["m"]).alias("m"),
        F.count_if(F.col("s.flag") == "MISS").alias("misses"), F.count_if(F.col("s.flag") == "BEAT").alias("beats"))
    return blocks.groupBy(key).agg(fold(F.sort_array(F.collect_list(F.struct(block, "m"))), lambda x: x["m"]).alias("m"), F.sum("misses").alias("misses"), F.sum("beats").alias("beats"))


def moved_meter(start: Column) -> Column:
    """Where the map ``m`` takes a meter."""
    return F.least(F.col("m.hi"), F.greatest(F.col("m.lo"), start + F.col("m.add")))


def meter_batch(outcomes: DataFrame, key: str, block: str, order: list[str], flag: str = "flag") -> DataFrame:
    """Final meter per key from the whole history."""
    return meter_maps(outcomes, key, block, order, flag).select(key, moved_meter(F.lit(START)).alias("meter"), "misses", "beats")


def meter_stream(outcomes: DataFrame, table: KeyedTable, order: list[str], flag: str = "flag"):
    """``foreachBatch`` handler that keeps a running meter per key in a keyed table.

    A batch becomes one map per key (in the order of ``order`` inside the batch), which
    moves the stored meter on. No key's events meet in one task, and only the buckets of
    keys that the batch has are rewritten.
    """
    key = table.keys[0]

    def move_on(stored: DataFrame, maps: DataFrame) -> DataFrame:
        if "m" in stored.columns:  # nothing stored yet
            stored = stored.select(key, F.lit(START).alias("meter"), "misses", "beats")
        old = stored.select(key, "meter", F.col("misses").alias("old_misses"), F.col("beats").alias("old_beats"))
        start, zero = F.coalesce("meter", F.lit(START)), F.lit(0)
        now = F.when(F.col("m").isNull(), F.col("meter")).otherwise(moved_meter(start))
        total = lambda c: (F.coalesce(c, zero) + F.coalesce(f"old_{c}", zero)).alias(c)
        return old.join(maps, key, "full").select(key, now.alias("meter"), total("misses"), total("beats"))

    def handle(batch: DataFrame, batch_id: int) -> None:
        table.merge(meter_maps(range_blocks(batch, key, order), key, "block", order, flag), move_on, batch_id + 1)

    return outcomes.writeStream.foreachBatch(handle)


def upsert_stream(events: DataFrame, table: KeyedTable, order: list[str]):
    """``foreachBatch`` handler that merges each batch into a keyed table."""
    return events.writeStream.foreachBatch(lambda batch, batch_id: table.upsert(batch, order, batch_id + 1))


def observe_health(items: DataFrame, reason: str = "drop_reason", name: str = "health") -> DataFrame:
    """Attach input, accepted and dropped counters that arrive with each progress event."""
    return items.observe(name, F.count(F.lit(1)).alias("input"), F.count_if(F.col(reason).isNull()).alias("accepted"), F.count_if(F.col(reason).isNotNull()).alias("dropped"))


class HealthListener(StreamingQueryListener):
    """Writes the counters of every micro-batch to a table, however many there are.

    Rows gather in the driver until there are ``every`` of them or a query ends. A batch
    that is run again after a failure has a second row; :func:`health_totals` counts it once.
    """

    def __init__(self, spark: SparkSession, path: str, metric: str = "health", every: int = 500):
        self.spark, self.path, self.metric, self.every = spark, path, metric, every
        self._rows: list[tuple] = []
        self._ended: set[str] = set()
        self._change = threading.Condition()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        found = p.observedMetrics.get(self.metric)
        if found is not None:
            self._rows.append((str(p.id), str(p.runId), p.name, p.batchId, p.timestamp, {k: int(v) for k, v in found.asDict().items()}))
        if len(self._rows) >= self.every:
            self._flush()

    def onQueryTerminated(self, event) -> None:
        self._flush()
        with self._change:
            self._ended.add(str(event.runId))
            self._change.notify_all()

    def _flush(self) -> None:
        rows, self._rows = self._rows, []
        if rows:
            self.spark.createDataFrame(rows, HEALTH).coalesce(1).write.mode("append").parquet(self.path)

    def wait(self, run_id: str, seconds: float = 60) -> bool:
        """Until the counters of a run that has ended are written."""
        with self._change:
            return self._change.wait_for(lambda: str(run_id) in self._ended, seconds)


HEALTH = "query_id string, run_id string, name string, batch_id long, at string, counters map<string,long>"


def health_totals(spark: SparkSession, path: str) -> DataFrame:
    """``query_id``, ``batches`` and the sum of each counter over all micro-batches."""
    rows = spark.read.schema(HEALTH).parquet(path)
    last = rows.groupBy("query_id", "batch_id").agg(F.max_by("counters", "at").alias("counters"))
    each = last.select("query_id", "batch_id", F.explode("counters").alias("counter", "n"))
    return each.groupBy("query_id", "counter").agg(F.sum("n").alias("n"), F.countDistinct("batch_id").alias("batches"))


def drain(writer, checkpoint: str) -> None:
    """Run a ``foreachBatch`` writer over what has arrived since ``checkpoint``."""
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
