"""Near-duplicate vectors: random hyperplanes, exact cosines, connected components.

Vectors of one label meet where the signs of their products with a table's hyperplanes
agree. The number of signs grows with the logarithm of the rows per label, so buckets
keep their size, and the number of tables follows from it and from ``MISS``, the chance
allowed for a pair right at the threshold to meet in no table. Every pair that meets is
checked by its cosine in double precision, and counted only in the first table where
it meets.

Equal vectors of a label form one class beforehand. Signs are computed once; tables
are counted and split on rows of ids and signs alone, and vectors join those that share
a bucket with another. Small buckets share a group of rows. Buckets beyond ``BLOCK``
vectors are split: their vectors are dealt into blocks by a hash, and each pair of
blocks is a group of its own. Inside a group, links are counted by matrix products and never listed:
it returns for each vector its links and the least vector of its component there, which
keeps all components whole. Those pairs are joined into components over all tables by
propagation in Spark.

Vectors that are null, zero, or hold nulls, NaN or infinities, and rows with a null
label or id link with nothing; their component is their own id. Rows that repeat are
vectors of their own that link with each other; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guidepost.llm.components import components
from guidepost.session import cut_lineage

THRESHOLD = 0.93
MISS = 1e-4
#: Rows that a group of small buckets aims at.
GROUP = 4096
#: Vectors per bucket that the number of signs aims at, and most vectors in a block.
AIM = 48
BLOCK = 1024


def sizes(per_label: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int]:
    """Signs per table and number of tables."""
    signs = min(24, max(4, math.ceil(math.log2(max(per_label, 1) / AIM))))
    meet = (1 - math.acos(threshold) / math.pi) ** signs
    return signs, max(1, math.ceil(math.log(miss) / math.log1p(-meet)))


def planes(dim: int, signs: int, tables: int) -> np.ndarray:
    return np.random.default_rng(20_240_611).standard_normal((dim, signs * tables))


def keys(x: np.ndarray, on: np.ndarray, signs: int) -> np.ndarray:
    """Signs of each vector against the planes ``on``, in whole bytes a table."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return np.packbits((x @ on > 0).reshape(len(x), -1, signs), axis=2).reshape(len(x), -1)


def classes(vectors: DataFrame, vec_id: str, embedding: str, label: str) -> tuple[DataFrame, DataFrame]:
    """(one row per input row with its class, one row per class of equal vectors)."""
    v = F.col(embedding).cast("array<double>")
    ok = F.col(vec_id).isNotNull() & F.col(label).isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    key = F.when(F.coalesce(ok, F.lit(False)), F.sha2(F.concat_ws(",", F.transform(v, lambda x: F.hex((x + F.lit(0.0)).cast("string"))), F.col(label).cast("string")).cast("binary"), 256))
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(embedding).alias("v"), key.alias("key"))
    one = rows.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("v").alias("v"))
    return rows.select("vec_id", "key"), one


def _linked(part: pd.DataFrame, width: int, threshold: float) -> pd.DataFrame:
    """Links and local component of the vectors of one pair of blocks."""
    x = np.stack(part["v"].to_numpy()).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # squares of huge or tiny numbers stay finite
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    table = int(part["t"].iloc[0])
    key = np.frombuffer(b"".join(part["sig"]), np.uint8).reshape(len(x), -1, width)[:, :table].astype(np.int32) @ (256 ** np.arange(width, dtype=np.int32))
    ids, n = part["rep"].to_numpy(), part["n"].to_numpy()
    block, first, second = part["block"].to_numpy(), part["b1"].iloc[0], part["b2"].iloc[0]
    near = np.zeros((len(x), len(x)), bool)
    np.greater_equal(x @ x.T, threshold, out=near)
    np.fill_diagonal(near, False)
    if first != second:  # pairs inside one block have a task of their own
        near &= block[:, None] != block[None, :]
    links = np.zeros(len(x), np.int64)
    rows, cols = np.nonzero(near)
    for lo in range(0, len(rows), 200_000):
        r, c = rows[lo : lo + 200_000], cols[lo : lo + 200_000]
        new = ~(key[r] == key[c]).any(axis=1) if table else np.ones(len(r), bool)
        np.add.at(links, r[new], n[c[new]])
    label = np.arange(len(x))
    order = np.argsort(ids, kind="stable")
    rank = np.empty(len(x), np.int64)
    rank[order] = label
    least = rank.copy()
    while True:
        new = least.copy()
        np.minimum.at(new, rows, least[cols])
        new = np.minimum(new, new[order[new]])
        if (new == least).all():
            break
        least = new
    some = np.flatnonzero(near.any(axis=1))
    return pd.DataFrame({"rep": ids[some], "links": links[some], "root": ids[order[least[some]]]})


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, miss: float = MISS, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` of every row. Vectors of
    different length under one label never link."""
    rows, one = classes(vectors, vec_id, embedding, label)
    one = cut_lineage(one)
    shape = one.groupBy("label", F.size("v").alias("dim")).agg(F.count("*").alias("c")).agg(F.max("c").alias("c"), F.sum("c").alias("all")).first()
    signs, tables = sizes(shape["c"] or 0, threshold, miss)
    width = -(-signs // 8)

    def signed(batches):
        on = {}
        for pdf in batches:
            for dim, part in pdf.groupby(pdf["v"].map(len)):
                if dim not in on:
                    on = {dim: planes(dim, signs, tables)}
                k = keys(np.stack(part["v"].to_numpy()).astype(np.float64), on[dim], signs)
                yield pd.DataFrame({"rep": part["rep"].to_numpy(), "n": part["n"].to_numpy(), "label": part["label"].to_numpy(), "dim": dim, "sig": [row.tobytes() for row in k]})

    kind = one.schema["label"].dataType.simpleString()
    ident = one.schema["rep"].dataType.simpleString()
    met = cut_lineage(one.select("label", "rep", "n", "v").mapInPandas(signed, f"rep {ident}, n long, label {kind}, dim int, sig binary"))
    # (table, signs there) of every vector, without the vector
    at = met.select("*", F.explode(F.sequence(F.lit(0), F.lit(tables - 1))).alias("t"))
    at = at.withColumn("key", F.substring(F.col("sig"), F.col("t") * width + 1, F.lit(width)))
    bucket = ["t", "key", "dim", "label"]
    count = at.groupBy(*bucket).agg(F.count("*").alias("c")).where("c > 1").withColumn("blocks", F.ceil(F.col("c") / BLOCK).cast("int"))
    got = at.join(count, bucket).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    got = got.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    got = got.withColumns({"b1": F.least("block", "other"), "b2": F.greatest("block", "other")})
    spread = F.xxhash64(*bucket, "b1", "b2")
    groups = max(1, math.ceil((shape["all"] or 0) * tables / GROUP))
    got = got.withColumn("part", F.when(F.col("blocks") == 1, F.pmod(spread, F.lit(groups))).otherwise(spread))
    got = got.select("part", *bucket, "b1", "b2", "block", "rep", "n", "sig").join(one.select("rep", "v"), "rep")

    def task(part: pd.DataFrame) -> pd.DataFrame:
        done = [_linked(p, width, threshold) for _, p in part.groupby([*bucket, "b1", "b2"], sort=False)]
        return pd.concat(done, ignore_index=True)

    linked = got.groupBy("part").applyInPandas(task, f"rep {ident}, links long, root {ident}")
    linked = cut_lineage(linked.groupBy("rep", "root").agg(F.sum("links").alias("links")))
    comp = components(linked.select(F.col("rep").alias("src"), F.col("root").alias("dst"))).select(F.col("node").alias("rep"), "component")
    links = linked.groupBy("rep").agg(F.sum("links").alias("links"))
    of_class = one.select("key", "rep", "n").join(links, "rep", "left").join(comp, "rep", "left")
    of_class = of_class.select("key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.join(of_class, "key", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
