"""A bounded sample of labelled documents for training a classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guidepost.llm.common import begin, crc_mod, give_back, utf8


def training_rows(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_fold: int, max_rows: int, balanced: bool) -> DataFrame:
    """``text`` (bytes) and ``y`` (0 or 1) of at most ``max_rows`` documents outside the
    held-out fold, the same ones on every run.

    Rows without id or label are left out; of several labels of one document the larger
    counts, and of several texts under one id the smallest. ``balanced`` takes up to half
    of the rows from either class.
    """
    ids = (
        labels.select(F.col("doc_id").alias("doc_id"), F.col(label).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & (crc_mod(F.col("doc_id"), folds) != held_fold))
        .groupBy("doc_id").agg(F.max("y").alias("y"))
        .withColumn("order", F.xxhash64("doc_id"))
    )
    # labels may name documents that are not there: those with a text are counted
    ids = ids.join(docs.select(F.col("doc_id").alias("doc_id")).where(F.col("text").isNotNull()).distinct(), "doc_id", "left_semi")
    pick = lambda d, n: d.orderBy("order", "doc_id").limit(n)
    if balanced:
        ids = pick(ids.where("y = 1"), max_rows // 2).unionByName(pick(ids.where("y = 0"), max_rows - max_rows // 2))
    else:
        ids = pick(ids, max_rows)
    # at most max_rows rows of three numbers
    return (
        docs.select(F.col("doc_id").alias("doc_id"), utf8(F.col("text")).alias("text"))
        .join(F.broadcast(ids), "doc_id")
        .groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))
        .select("doc_id", "text", "y")
    )


def label_rate(labels: DataFrame, label: str, folds: int, held_fold: int) -> float:
    """Share of ones among the labels outside the held-out fold, smoothed by half a label."""
    y = F.col(label).cast("int")
    n, ones = labels.where(F.col("doc_id").isNotNull() & y.isin(0, 1) & (crc_mod(F.col("doc_id"), folds) != held_fold)).agg(F.count("*"), F.sum(y)).first()
    return ((ones or 0) + 0.5) / (n + 1.0)


def trained_in_one_task(rows: DataFrame, fit, schema: str) -> list:
    """``fit(texts, y)`` on the bounded sample, inside one task; its rows."""

    def run(batches):
        import pyarrow as pa

        begin("training")
        texts, y, ids = [], [], []
        for b in batches:
            ids += b.column("doc_id").to_pylist()
            texts += b.column("text").to_pylist()
            y += b.column("y").to_pylist()
        order = sorted(range(len(ids)), key=ids.__getitem__)
        out = fit([texts[i] for i in order], [y[i] for i in order])
        yield pa.RecordBatch.from_pydict(out)
        out = texts = b = None
        give_back()

    return rows.coalesce(1).mapInArrow(run, schema).collect()
