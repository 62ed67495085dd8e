"""The pipeline's stages against what their operators say, and the queries' contracts."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from guidepost.llm import jaccard, queries, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_keep_whole_rows(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    n = [docs.count()]
    for i, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, sf)
        if i < len(P.STAGES) - 1:
            assert out.columns == COLUMNS, name
        out.write.parquet(f"{tmp_path}/{i}")
        docs, before = spark.read.parquet(f"{tmp_path}/{i}"), docs
        n.append(docs.count())
        if i == 2:
            want = {r.component_id for r in jaccard.join_components(before).collect()}
            assert {r.doc_id for r in docs.select("doc_id").collect()} == want and n[-1] == len(want)
        if i == 3:
            got = docs.groupBy("doc_id").count().collect()
            assert max(r["count"] for r in got) <= 2
    assert n[0] >= n[1] >= n[2] >= n[3] and n[4] == n[5]
    assert P.run(spark, sf).count() == n[5]


def test_toxic_rows_go(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    stay = {r.doc_id for r in toxicity.score(docs, model).where(F.col("score") < P.THRESHOLD).collect()}
    assert {r.doc_id for r in P.drop_toxic(spark, docs, sf).collect()} == stay


def test_stages_on_odd_rows(spark, sf, odd_docs, no_docs):
    docs = odd_docs.select(*COLUMNS)
    for name, stage in P.STAGES:
        assert stage(spark, docs, sf).count() >= 0, name
        assert stage(spark, no_docs, sf).count() == 0, name


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_match_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    cur = con.execute(queries.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    key = lambda rows: sorted(rows, key=repr)
    assert key(tuple(r[c] for c in names) for r in df.collect()) == key(cur.fetchall())
