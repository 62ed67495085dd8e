"""Vector and keyword retrieval over chunks."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import normalize_whitespace
from ..session import cut_lineage
from .text import hits

#: Rows in a block of queries and of the corpus.
QUERY_BLOCK, CORPUS_BLOCK = 512, 4096
#: Rows (query, list) that a task writes at once.
PROBE_ROWS = 16384


def cosine_topk(corpus: DataFrame, vector: str, query: Sequence[float], k: int, ident: str) -> DataFrame:
    """Top ``k`` rows by cosine similarity to one query vector; null vectors excluded.

    The query is a literal and the product stays in the JVM; ``orderBy`` with
    ``limit`` keeps ``k`` rows per partition before the final merge.
    """
    q = np.asarray(query, dtype=float)
    norm = float(np.sqrt((q * q).sum()))
    lit = F.array(*[F.lit(float(x)) for x in q])
    v = F.transform(vector, lambda x: x.cast("double"))
    dot = F.aggregate(F.zip_with(v, lit, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    size = F.sqrt(F.aggregate(F.transform(v, lambda x: x * x), F.lit(0.0), lambda a, x: a + x))
    scored = corpus.filter(F.col(vector).isNotNull()).withColumn("similarity", dot / (size * norm))
    return scored.orderBy(F.desc("similarity"), ident).limit(k)


def cosine_topk_many(corpus: DataFrame, queries: DataFrame, k: int, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Top ``k`` corpus rows of every query row ``(query_id, vector)``.

    Both sides are dealt into blocks of bounded size; each block of queries meets each
    block of the corpus in one row, as one matrix product that keeps ``k`` rows per
    query, and a limited window merges the blocks. Nothing passes through the driver.
    """
    ids = {"query_id": queries.schema["query_id"].dataType.simpleString(), "vec_id": corpus.schema[ident].dataType.simpleString()}
    q, n_q = _blocks(queries.select(F.col("query_id").alias("id"), F.col(vector).alias("v")), QUERY_BLOCK, "qs")
    c, _ = _blocks(corpus.select(F.col(ident).alias("id"), F.col(vector).alias("v")), CORPUS_BLOCK, "cs")
    met = c.select("cs", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_q - 1).cast("bigint"))).alias("block")).join(q, "block")
    out = met.select("qs", "cs").mapInArrow(_top_of_blocks(k), f"query_id {ids['query_id']}, vec_id {ids['vec_id']}, similarity double")
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _blocks(rows: DataFrame, size: int, name: str) -> tuple[DataFrame, int]:
    """(block, array of (id, v)) with about ``size`` rows each, and their number."""
    rows = rows.filter(F.col("v").isNotNull())
    n = max(1, -(-rows.count() // size))
    return rows.groupBy(F.pmod(F.xxhash64("id"), F.lit(n)).alias("block")).agg(F.collect_list(F.struct("id", "v")).alias(name)), n


def _top_of_blocks(k: int) -> Callable:
    """Of Arrow rows (block of queries, block of the corpus) the top ``k`` of each query; one
    row after the other is read from its buffers, no block becomes Python objects."""

    def unit(block: pa.ListScalar) -> tuple[np.ndarray, np.ndarray]:
        vectors = block.values.field("v")
        sizes = np.unique(vectors.value_lengths().to_numpy(zero_copy_only=False))
        if len(sizes) > 1:
            raise ValueError(f"vectors of unequal length: {sizes[:10]}")
        x = vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(vectors), -1)
        return np.asarray(block.values.field("id").to_pylist()), x / np.linalg.norm(x, axis=1, keepdims=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds = [b.schema.field(side).type.value_type.field("id").type for side in ("qs", "cs")]
            for qs, cs in zip(b["qs"], b["cs"]):
                (qid, q), (cid, c) = unit(qs), unit(cs)
                sim = q @ c.T
                found = []
                for i in range(len(qid)):
                    least = np.partition(sim[i], -k)[-k] if k < len(cid) else -np.inf
                    near = np.flatnonzero(sim[i] >= least)
                    found.append(near[np.lexsort((cid[near], -sim[i][near]))[:k]])
                at, to = np.repeat(np.arange(len(qid)), [len(x) for x in found]), np.concatenate(found)
                yield pa.RecordBatch.from_arrays([pa.array(qid[at].tolist(), kinds[0]), pa.array(cid[to].tolist(), kinds[1]), pa.array(sim[at, to])], ["query_id", "vec_id", "similarity"])

    return run


def hashing_model(dim: int = 384) -> Callable[[Sequence[str]], np.ndarray]:
    """Deterministic stand-in for a sentence model: signed hashed bag of words."""

    def encode(texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for i, t in enumerate(texts):
            hashes = [zlib.crc32(w.encode()) for w in re.findall(r"\w+", (t or "").lower())]
            for h in hashes:
                out[i, h % dim] += 1.0 if h & 0x80000000 else -1.0
            if hashes and not out[i].any():  # all signs cancel: words count without them
                for h in hashes:
                    out[i, h % dim] += 1.0
        return out

    return encode


def embed(df: DataFrame, text: str, out: str = "embedding", model: Callable[[], Callable] = hashing_model) -> DataFrame:
    """Unit vectors of a text column in Arrow batches; the model is built once per task."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = model()
        for f in frames:
            x = encode(f[text].tolist())
            n = np.linalg.norm(x, axis=1, keepdims=True)
            f[out] = list((x / np.where(n == 0, 1, n)).astype("float32"))
            yield f

    return df.mapInPandas(run, schema)


def build_ivf(corpus: DataFrame, vector: str, lists: int, seed: int = 7):
    """(corpus with ``list_id``, centroids): coarse lists from k-means on unit vectors."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    v = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(F.transform(v, lambda x: x * x), F.lit(0.0), lambda a, x: a + x))
    rows = corpus.filter(F.col(vector).isNotNull()).withColumn("__u", array_to_vector(F.transform(v, lambda x: x / norm)))
    model = KMeans(k=lists, seed=seed, featuresCol="__u", predictionCol="list_id", maxIter=10).fit(rows)
    return model.transform(rows).drop("__u"), np.asarray(model.clusterCenters())


def ivf_topk(index: DataFrame, centroids: np.ndarray, vector: str, query: Sequence[float], k: int, probes: int, ident: str) -> DataFrame:
    """Search the ``probes`` lists nearest to the query; a filter on ``list_id`` prunes the rest."""
    q = np.asarray(query, dtype=float)
    near = np.argsort(-(centroids @ q) / np.linalg.norm(centroids, axis=1))[:probes]
    return cosine_topk(index.filter(F.col("list_id").isin([int(i) for i in near])), vector, q, k, ident)


#: Rows that the coarse lists are fitted on, for each list; all rows are indexed.
FIT_ROWS = 256
#: Queries that the number of probed lists is measured with.
TUNE_QUERIES = 256


def ivf_lists(rows: int) -> int:
    """Lists for a table of this size: the square root of its rows, from 4 to 4,096."""
    return int(min(4096, max(4, round(rows**0.5))))


def write_ivf(corpus: DataFrame, path: str, k: int = 10, aim: float = 0.95, vector: str = "embedding", ident: str = "vec_id", seed: int = 7) -> None:
    """Inverted lists on storage: ``path/lists`` partitioned by ``list_id``, ``path/centroids``.

    The number of lists follows from the rows. Their centres are fitted on a sample of
    ``FIT_ROWS`` rows a list; then every row goes to its list, and a large list to several
    files. How many lists a search must probe is measured, not guessed: for up to
    ``TUNE_QUERIES`` rows the true ``k`` neighbours are found exactly, and the least number
    of probed lists that holds a share of ``aim`` of them is kept with the index.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    v = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(F.transform(v, lambda x: x * x), F.lit(0.0), lambda a, x: a + x))
    rows = corpus.filter(F.col(vector).isNotNull()).select(F.col(ident).alias("vec_id"), v.alias("embedding"), array_to_vector(F.transform(v, lambda x: x / norm)).alias("__u"))
    n = rows.count()
    lists = ivf_lists(n)
    part = rows if n <= FIT_ROWS * lists else rows.sample(FIT_ROWS * lists / n, seed)
    model = KMeans(k=lists, seed=seed, featuresCol="__u", predictionCol="list_id", maxIter=10).fit(part)
    # ranges by list and id: a list of a third of all rows is dealt to a third of the tasks
    model.transform(rows).drop("__u").repartitionByRange("list_id", "vec_id").write.partitionBy("list_id").parquet(f"{path}/lists")
    centres = np.asarray(model.clusterCenters())
    index = rows.sparkSession.read.parquet(f"{path}/lists")
    asks = index.orderBy(F.xxhash64("vec_id")).limit(TUNE_QUERIES).select(F.col("vec_id").alias("query_id"), "embedding")
    true = cosine_topk_many(index, asks, k).join(index.select("vec_id", "list_id"), "vec_id").select("query_id", "list_id")
    place = probed(asks, centres, len(centres)).select("query_id", "list_id", "place")
    need = true.join(place, ["query_id", "list_id"]).agg(F.percentile("place", aim).alias("p")).first()["p"]
    probes = max(1, int(np.ceil(need or 0)) + 1)
    sizes = {r["list_id"]: r["n"] for r in index.groupBy("list_id").agg(F.count("*").alias("n")).collect()}  # one row a list
    kept = [(i, [float(x) for x in c], sizes.get(i, 0), probes) for i, c in enumerate(centres)]
    rows.sparkSession.createDataFrame(kept, "list_id int, centre array<double>, n long, probes int").coalesce(1).write.parquet(f"{path}/centroids")


def probed(queries: DataFrame, centres: np.ndarray, probes: int) -> DataFrame:
    """(query_id, embedding, list_id, place) of the nearest lists of every query."""
    unit = centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-300)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            step = max(1, min(QUERY_BLOCK, PROBE_ROWS // probes))
            for lo in range(0, len(f), step):
                part = f.iloc[lo : lo + step]
                near = np.argsort(-(np.stack(part["embedding"].to_numpy()) @ unit.T), axis=1, kind="stable")[:, :probes]
                at = np.repeat(np.arange(len(part)), near.shape[1])
                yield pd.DataFrame({"query_id": part["query_id"].to_numpy()[at], "embedding": part["embedding"].to_numpy()[at], "list_id": near.reshape(-1).astype("int32"), "place": np.tile(np.arange(near.shape[1], dtype="int32"), len(part))})

    q = queries.filter(F.col("embedding").isNotNull()).select("query_id", F.col("embedding").cast("array<double>").alias("embedding"))
    kind = q.schema["query_id"].dataType.simpleString()
    return q.mapInPandas(run, f"query_id {kind}, embedding array<double>, list_id int, place int")


def ivf_topk_many(spark: SparkSession, path: str, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
    """Approximate top ``k`` of every query row ``(query_id, embedding)`` from stored lists.

    Queries go to the lists they probe; only these lists' folders are read, and inside a
    list blocks of queries meet blocks of rows as matrix products.
    """
    kept = spark.read.parquet(f"{path}/centroids").orderBy("list_id").collect()  # one row a list
    centres, sizes = np.array([r["centre"] for r in kept]), {r["list_id"]: r["n"] for r in kept}
    asks = cut_lineage(probed(queries, centres, probes or kept[0]["probes"]).drop("place"))
    n_asked = {r["list_id"]: r["n"] for r in asks.groupBy("list_id").agg(F.count("*").alias("n")).collect()}
    blocks = lambda counts, size: F.create_map(*[F.lit(x) for i, c in counts.items() for x in (i, max(1, -(-c // size)))])
    if not n_asked:
        return asks.select("query_id", F.col("query_id").alias("vec_id"), F.lit(0.0).alias("similarity"), F.lit(0).alias("rank"))
    index = spark.read.parquet(f"{path}/lists").filter(F.col("list_id").isin(list(n_asked)))
    pack = lambda df, ident, counts, size, out: df.groupBy("list_id", F.pmod(F.xxhash64(ident), F.element_at(blocks(counts, size), F.col("list_id"))).alias(f"{out}_block")).agg(F.collect_list(F.struct(F.col(ident).alias("id"), F.col("embedding").alias("v"))).alias(out))
    qs = pack(asks, "query_id", n_asked, QUERY_BLOCK, "qs")
    cs = pack(index, "vec_id", {i: sizes[i] for i in n_asked}, CORPUS_BLOCK, "cs")
    ids = {"q": queries.schema["query_id"].dataType.simpleString(), "c": index.schema["vec_id"].dataType.simpleString()}
    out = qs.join(cs, "list_id").select("qs", "cs").mapInArrow(_top_of_blocks(k), f"query_id {ids['q']}, vec_id {ids['c']}, similarity double")
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def question_keywords(question: str, n: int = 5) -> list[str]:
    words = re.sub(r"[^\w\s]", "", question.lower()).split()
    return [w for w in words if len(w) > 3][:n]


def keyword_topk(chunks: DataFrame, question: str, k: int, order: Sequence[str], company: str | None = None) -> DataFrame:
    """Top ``k`` chunks by share of the question's keywords present; all chunks are scored."""
    words = question_keywords(question)
    if not words:
        return chunks.limit(0).withColumn("similarity", F.lit(0.0))
    d = chunks if company is None else chunks.filter(F.col("company_id") == company)
    d = d.withColumn("n_hits", hits(F.lower("chunk_text"), words)).filter("n_hits > 0")
    return d.withColumn("similarity", F.col("n_hits") / float(len(words))).orderBy(F.desc("n_hits"), *order).limit(k)


def retrieval_citations(found: DataFrame, floor: float = 0.2) -> DataFrame:
    """Citations of the hits whose similarity passes the floor."""
    page = F.when(F.col("source_page").isNotNull(), F.concat(F.lit(" | Page "), F.col("source_page").cast("string"))).otherwise("")
    period = F.when(F.col("period").isNotNull(), F.concat(F.lit(" | "), "period")).otherwise("")
    return found.filter(F.col("similarity") > floor).withColumn("citation", F.concat(F.coalesce("source_document", F.lit("Document")), page, period))


def fact_summary(companies: DataFrame, latest: DataFrame, hit_rates: DataFrame) -> DataFrame:
    """One summary sentence per company from structured facts."""
    j = companies.select("company_id", "name").join(latest, "company_id", "left").join(hit_rates, "company_id", "left")
    num = lambda c: F.coalesce(F.floor(c).cast("bigint").cast("string"), F.lit("n/a"))
    text = F.concat(normalize_whitespace(F.col("name")), F.lit(": revenue "), num(F.col("revenue")), F.lit(", margin "), num(F.col("opm")), F.lit("%, "),
                    F.coalesce(F.col("n").cast("string"), F.lit("0")), F.lit(" claims checked, "), F.coalesce(F.col("misses").cast("string"), F.lit("0")), F.lit(" missed"))
    return j.select("company_id", text.alias("summary"))
