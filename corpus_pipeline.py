"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's documents. All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from guidepost.llm import bpe, jaccard, mixing, quality_classifier, toxicity
from guidepost.llm.common import store, table
from guidepost.llm.queries import byte_bpe_path
from guidepost.session import scratch_path

#: Documents with a toxicity of at least this, or a quality below it, go.
THRESHOLD = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the string kernel doesn't find toxic."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity.score_column(model, F.col("text")) < THRESHOLD)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of good quality by subword embeddings."""
    model = quality_classifier.train(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality_classifier.score_column(model, F.col("text")) >= THRESHOLD)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of near duplicates; of rows
    that repeat an id and its text one, those with other texts by their own components;
    rows without an id all."""
    comp = jaccard.row_components(docs).where("doc_id is not null")
    stay = comp.where("first is null or first = struct(doc_id, t1, t2)").select("doc_id", "t1", "t2").distinct()
    key = ["doc_id", "t1", "t2"]
    rest = [c for c in docs.columns if c != "doc_id"]
    row = docs.select("doc_id", F.struct(*rest).alias("r"), *[h.alias(c) for c, h in jaccard.text_digest(F.col("text")).items()])
    once = row.join(stay, key, "left_semi").groupBy(*key).agg(F.min("r").alias("r")).select("doc_id", *[F.col("r")[c].alias(c) for c in rest])
    return once.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    got = mixing.mix(docs, carry=docs.columns)
    return got.where("copies > 0").select(*[F.col(f"carried.{c}").alias(c) for c in docs.columns], F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("copy")).drop("copy")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document and the text read back, as count and digests."""
    return bpe.digests(bpe.round_trip(docs, byte_bpe_path()))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", one_of_each_group),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode),
]

#: Trained models, components and BPE can't be stated in SQL; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    root = scratch_path(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        docs = store(stage(spark, docs, sf_dir), f"{root}/{i}")
    return STAGES[-1][1](spark, docs, sf_dir)
