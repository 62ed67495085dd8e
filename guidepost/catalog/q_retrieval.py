"""Vector and keyword retrieval queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import retrieval as R
from ..operators.ordered import latest_prev_wide
from ..session import scratch_path
from . import views as V
from .q_scoring import annual, deviations
from .q_text import chunks
from .registry import query


def first_vector(spark, sf):
    e = V.table(spark, sf, "embeddings")
    return e.agg(F.min_by("embedding", "vec_id")).first()[0]


_COS = "list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[])"


@query("v1_cosine_topk", f"SELECT vec_id, label, {_COS.format(a='embedding', b='(SELECT min_by(embedding, vec_id) FROM embeddings)')} AS similarity FROM embeddings WHERE embedding IS NOT NULL ORDER BY similarity DESC, vec_id LIMIT 20", rounds="similarity")
def _(spark, sf):
    q = first_vector(spark, sf)
    return R.cosine_topk(V.table(spark, sf, "embeddings"), "embedding", q, 20, "vec_id").select("vec_id", "label", "similarity")


@query("v1b_company_topk", f"SELECT vec_id, {_COS.format(a='embedding', b='(SELECT min_by(embedding, vec_id) FROM embeddings)')} AS similarity FROM embeddings WHERE label = 3 ORDER BY similarity DESC, vec_id LIMIT 10", rounds="similarity")
def _(spark, sf):
    """Same search under the company filter, pushed to the scan."""
    q = first_vector(spark, sf)
    return R.cosine_topk(V.table(spark, sf, "embeddings").filter("label = 3"), "embedding", q, 10, "vec_id").select("vec_id", "similarity")


@query("v1c_many_queries", f"""
WITH q AS (SELECT min(vec_id) AS query_id, min_by(embedding, vec_id) AS qv FROM embeddings GROUP BY label)
SELECT query_id, vec_id, {_COS.format(a='embedding', b='qv')} AS similarity, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round({_COS.format(a='embedding', b='qv')}, 12) DESC, vec_id) AS INT) AS rank FROM embeddings, q QUALIFY rank <= 5""", rounds="similarity")
def _(spark, sf):
    e = V.table(spark, sf, "embeddings")
    q = e.groupBy("label").agg(F.min("vec_id").alias("query_id"), F.min_by("embedding", "vec_id").alias("embedding"))
    return R.cosine_topk_many(e, q, 5)


@query("v2_embed", """
SELECT doc_id, lang, 384 AS dim, CASE WHEN regexp_matches(coalesce(text, ''), '[\\p{L}\\p{N}_]') THEN 1.0 ELSE 0.0 END::DOUBLE AS norm FROM documents""")
def _(spark, sf):
    """Unit vectors of every document; rows, dimension and length are reported."""
    d = R.embed(V.table(spark, sf, "documents").select("doc_id", "lang", "text"), "text")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
    return d.select("doc_id", "lang", F.size("embedding").alias("dim"), F.round(norm, 4).alias("norm"))


def fiftieth(spark, sf):
    """All vectors whose id is divisible by 50, as queries."""
    return V.table(spark, sf, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def searched(spark, sf):
    path = scratch_path(spark, "ivf")
    R.write_ivf(V.table(spark, sf, "embeddings"), path)
    return R.ivf_topk_many(spark, path, fiftieth(spark, sf), 10)


@query("v3_ivf")
def _(spark, sf):
    """Approximate neighbours of every fiftieth vector from inverted lists on storage; what
    they may miss is measured by ``v3_recall``."""
    return searched(spark, sf).select("query_id", "vec_id", "similarity", "rank")


@query("v3_recall", "SELECT count(*) AS n_queries, true AS enough, true AS none_better FROM embeddings WHERE vec_id % 50 = 0 AND embedding IS NOT NULL")
def _(spark, sf):
    """Is the mean recall of the stored lists at least 0.9 against the exact search, and is
    no neighbour they find nearer than the exact ones?"""
    exact = R.cosine_topk_many(V.table(spark, sf, "embeddings"), fiftieth(spark, sf), 10).select("query_id", "vec_id", F.col("similarity").alias("true"), F.lit(1).alias("hit"))
    met = exact.join(searched(spark, sf).select("query_id", "vec_id", "similarity"), ["query_id", "vec_id"], "full")
    least = F.min("true").over(Window.partitionBy("query_id"))
    per = met.withColumn("least", least).groupBy("query_id").agg((F.count_if(F.col("hit").isNotNull() & F.col("similarity").isNotNull()) / F.count("hit")).alias("recall"), F.max(F.when(F.col("hit").isNull(), F.col("similarity") - F.col("least"))).alias("over"))
    return per.agg(F.count("*").alias("n_queries"), (F.avg("recall") >= 0.9).alias("enough"), (F.coalesce(F.max("over"), F.lit(0.0)) <= 1e-9).alias("none_better"))


_ASK = "What about ther, tion and mente for schen?"
_WORDS = R.question_keywords(_ASK)


@query("v4_keyword_topk", f"""
SELECT doc_id, chunk_index, n_hits / {len(_WORDS)}.0::DOUBLE AS similarity FROM (SELECT doc_id, chunk_index, {' + '.join(f"CAST(contains(lower(chunk_text), '{w}') AS INT)" for w in _WORDS)} AS n_hits FROM chunks)
WHERE n_hits > 0 ORDER BY n_hits DESC, doc_id, chunk_index LIMIT 40""", rounds="similarity")
def _(spark, sf):
    return R.keyword_topk(chunks(spark, sf), _ASK, 40, ["doc_id", "chunk_index"]).select("doc_id", "chunk_index", "similarity")


@query("v4b_citations", f"""
SELECT doc_id, chunk_index, source || '.pdf | Page ' || (chunk_index + 1) || ' | ' || lang AS citation FROM (SELECT *, {' + '.join(f"CAST(contains(lower(chunk_text), '{w}') AS INT)" for w in _WORDS)} AS n_hits FROM chunks)
WHERE n_hits > 0 AND n_hits / {len(_WORDS)}.0 > 0.2 ORDER BY n_hits DESC, doc_id, chunk_index LIMIT 40""")
def _(spark, sf):
    c = chunks(spark, sf).withColumns({"source_document": F.concat("source", F.lit(".pdf")), "source_page": F.col("chunk_index") + 1, "period": F.col("lang")})
    return R.retrieval_citations(R.keyword_topk(c, _ASK, 40, ["doc_id", "chunk_index"])).select("doc_id", "chunk_index", "citation")


@query("v5_fact_summary", """
SELECT c.company_id, c.name || ': revenue ' || coalesce(CAST(CAST(floor(l.revenue) AS BIGINT) AS VARCHAR), 'n/a') || ', margin ' || coalesce(CAST(CAST(floor(l.opm) AS BIGINT) AS VARCHAR), 'n/a') || '%, ' || coalesce(h.n, 0) || ' claims checked, ' || coalesce(h.m, 0) || ' missed' AS summary
FROM companies c LEFT JOIN latest_prev l USING (company_id) LEFT JOIN (SELECT company_id, count(*) AS n, count(*) FILTER (WHERE flag = 'MISS') AS m FROM deviations GROUP BY 1) h USING (company_id)""")
def _(spark, sf):
    latest = latest_prev_wide(annual(spark, sf, ["revenue", "opm"]), ["revenue", "opm"]).select("company_id", "revenue", "opm")
    rates = deviations(spark, sf).groupBy("company_id").agg(F.count("*").alias("n"), F.count_if(F.col("flag") == "MISS").alias("misses"))
    return R.fact_summary(V.companies(spark, sf), latest, rates)
