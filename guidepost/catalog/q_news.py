"""News gates, de-duplication, digest and health queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import news as N
from ..session import cut_lineage, scratch_path
from ..sources import sinks as K
from . import views as V
from .q_text import NORM_SQL, _gs_sql, contains_any, contains_sum
from .registry import query, view

LEX = N.NewsLexicon(
    companies={"C_EN": ["thther", "inging"], "C_DE": ["undich", "schsch"], "C_ES": ["quelos", "ciónar"], "C_FR": ["eauxch", "elleen"]},
    dimensions={"d_one": ["thethe", "schen", "entedel", "dela"], "d_two": ["tiona", "schver", "reeau", "enle"], "d_three": ["inthe", "lichge", "osla", "aier"]},
    rules={"d_one": ["thand", "ichder"], "d_two": ["erthing", "keitung"], "d_three": ["quela", "menten"]},
    material=["ingti", "heits", "iónes", "enteau"], press=["zzpress", "andthesh "], specific=["stth", "onth", "ungun", "aren", "auxau", "lasel", "ichge", "enver", "uxai", "ionan"],
    noise=["hahaha", "thhahe", "gegege"], positive=["ing ", "keit ", "ado "], negative=["ed ", "lich ", "tion "], watch=["ough", "schen", "eau "],
    sector=["ment", "ver"], world=["whst", "dadel", "eauvi"],
    impact=((None, ("therthher", "undund"), "Watch"), ("d_two", ("ouen", "enle"), "Neutral"), ("d_one", ("ndes", "este"), "Negative"), (None, ("ereres", "unglich"), "Positive"), ("d_three", ("atan", "vien"), "Watch")),
)
AS_OF = "2024-06-30"
_T = "lower(concat_ws(' ', title, summary, content, source))"
_URL = "lower('https://' || source || '.example.com/' || lang || '/' || (doc_id % 700) || '?id=' || (doc_id % 350))"
_ALL = {d: [*LEX.dimensions[d], *LEX.rules[d]] for d in LEX.dimensions}


def _impact_sql():
    out = []
    for dim, words, verdict in LEX.impact:
        cond = contains_any("t", words)
        out.append(f"WHEN {cond}" + (f" AND list_contains(dimensions, '{dim}')" if dim else "") + f" THEN '{verdict}'")
    return "CASE " + " ".join(out) + " ELSE linguistic_sentiment END"


view("news_enriched", f"""
SELECT *, {_impact_sql()} AS sentiment,
  CASE WHEN title = '' OR url = '' THEN 'missing_title_or_url' WHEN press THEN 'press_release' WHEN len(dimensions) = 0 THEN 'no_dimension' WHEN relevance_score < 4 THEN 'low_relevance'
    WHEN noise_hits >= 2 THEN 'hard_noise_pattern' WHEN n_comp = 0 AND specificity < 2 THEN 'no_company_no_specificity' WHEN stage2_confidence < 0.45 THEN 'low_stage2_confidence' END AS drop_reason,
  CASE WHEN {contains_any('t', LEX.world)} THEN 'global' WHEN {contains_any('t', LEX.sector)} THEN 'sector' WHEN n_comp > 0 THEN 'company' ELSE 'sector' END AS market_scope
FROM (SELECT *, dim_score * 2 + materiality + CASE WHEN n_comp > 0 THEN 2 ELSE 0 END AS relevance_score,
    greatest(0, least(1, (dim_score + materiality + n_comp + specificity - noise_hits - CASE WHEN press THEN 2 ELSE 0 END) / 12.0::DOUBLE)) AS stage2_confidence,
    list_transform(dims, lambda d: d.name) AS dimensions, dims[1].name AS dimension_primary,
    CASE WHEN watch AND abs(gap) <= 1 THEN 'Watch' WHEN gap >= 2 THEN 'Positive' WHEN gap <= -2 THEN 'Negative' ELSE 'Neutral' END AS linguistic_sentiment
  FROM (SELECT *, CAST(coalesce(list_sum(list_transform(dims, lambda d: -d.neg)), 0) AS INT) AS dim_score, len(company_tags) AS n_comp FROM (
    SELECT doc_id, lang, source, {NORM_SQL.format(c='title')} AS title, url, published_date, summary, content, t, {_gs_sql('t', _ALL)} AS dims, {contains_sum('t', LEX.material)} AS materiality, {contains_sum('t', LEX.noise)} AS noise_hits,
      least({contains_sum('t', LEX.specific)}, 4) AS specificity, {contains_any('t', LEX.press)} AS press, {contains_any('t', LEX.watch)} AS watch, {contains_sum('t', LEX.positive)} - {contains_sum('t', LEX.negative)} AS gap,
      list_filter([{', '.join(f"CASE WHEN {contains_any('t', ws)} THEN '{c}' END" for c, ws in LEX.companies.items())}], lambda x: x IS NOT NULL) AS company_tags
    FROM (SELECT doc_id, lang, source, title, summary, content, published_date, {_URL} AS url, {_T} AS t FROM news))))""")
_SIGN = f"sha1(lower(title) || '|' || substr(lower({NORM_SQL.format(c='summary')}), 1, 140) || '|' || published_date)"
view("news_accepted", f"""
SELECT doc_id, lang, source, title, url, published_date, company_tags, dimensions, dimension_primary, relevance_score, stage2_confidence, sentiment, market_scope, sha1(url || '|' || lower(title)) AS uid, {_SIGN} AS content_signature,
  CASE WHEN s = '' THEN 'No summary available from source payload.' WHEN length(s) <= 280 THEN s ELSE rtrim(substr(s, 1, 277)) || '...' END AS summary_2line, '[' || source || ' | ' || url || ' | ' || published_date || ']' AS citation
FROM (SELECT *, {NORM_SQL.format(c='summary')} AS s FROM news_enriched WHERE drop_reason IS NULL)""")


def enriched(spark, sf):
    return N.enrich(V.news(spark, sf), LEX, AS_OF)


def accepted(spark, sf):
    return N.accept(enriched(spark, sf))


def tags(c):
    return F.array_join(c, ",")


@query("n1_gates", """
SELECT doc_id, drop_reason, array_to_string(company_tags, ',') AS companies, array_to_string(dimensions, ',') AS dimensions, CAST(relevance_score AS INT) AS relevance_score, market_scope FROM news_enriched""")
def _(spark, sf):
    """Every gate in one projection over the items; no shuffle."""
    return enriched(spark, sf).select("doc_id", "drop_reason", tags("company_tags").alias("companies"), tags("dimensions").alias("dimensions"), "relevance_score", "market_scope")


@query("n2_stage2", "SELECT doc_id, CAST(dim_score AS INT) AS dim_score, CAST(materiality AS INT) AS materiality, CAST(specificity AS INT) AS specificity, CAST(noise_hits AS INT) AS noise_hits, stage2_confidence FROM news_enriched", rounds="stage2_confidence")
def _(spark, sf):
    return enriched(spark, sf).select("doc_id", "dim_score", "materiality", "specificity", "noise_hits", "stage2_confidence")


@query("t19_sentiment", "SELECT doc_id, linguistic_sentiment, sentiment FROM news_enriched")
def _(spark, sf):
    return enriched(spark, sf).select("doc_id", "linguistic_sentiment", "sentiment")


@query("w14_keep_first", """
SELECT doc_id, uid, content_signature FROM (SELECT * FROM news_accepted QUALIFY row_number() OVER (PARTITION BY uid ORDER BY doc_id) = 1) QUALIFY row_number() OVER (PARTITION BY published_date, content_signature ORDER BY doc_id) = 1""")
def _(spark, sf):
    slim = accepted(spark, sf).select("doc_id", "uid", "content_signature", "published_date")
    return N.exact_dedupe(slim, ["doc_id"]).select("doc_id", "uid", "content_signature")


_TOK = "list_sort(list_distinct(list_filter(string_split_regex({c}, '\\s+'), lambda w: w <> '')))"
view("title_sets", f"SELECT published_date AS day, tokens, min(doc_id) AS id FROM (SELECT doc_id, published_date, {_TOK.format(c='title')} AS tokens FROM news) WHERE len(tokens) > 0 GROUP BY 1, 2")


@query("n4a_token_subset_pairs", """
SELECT a.day, least(a.id, b.id) AS src, greatest(a.id, b.id) AS dst FROM title_sets a JOIN title_sets b ON a.day = b.day AND a.id <> b.id WHERE list_has_all(b.tokens, a.tokens)""")
def _(spark, sf):
    """Containment pairs, looked up through each title's least common token only."""
    return N.subset_pairs(N.title_sets(V.news(spark, sf), "doc_id", "published_date", "title"))


@query("n4_fuzzy_dedup")
def _(spark, sf):
    """Titles surviving the same-day fuzzy rule; tested against brute force."""
    n = V.news(spark, sf).select("doc_id", "published_date", "title")
    return N.fuzzy_dedupe(n, "doc_id", "published_date", "title")


@query("r16_evidence_gate", """
SELECT field, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN trim(title) = '' THEN 'title' END, CASE WHEN trim(source) = '' THEN 'source' END, CASE WHEN dimension_primary IS NULL THEN 'dimension_primary' END,
  CASE WHEN lang = 'de' THEN 'citation' END, CASE WHEN len(dimensions) = 0 THEN 'dimensions' END], lambda x: x IS NOT NULL)) AS field FROM news_enriched) GROUP BY 1""")
def _(spark, sf):
    """Missing-field counts; citations are blanked for one language so that rows fail."""
    d = enriched(spark, sf).withColumn("citation", F.when(F.col("lang") == "de", " ").otherwise("[x]"))
    return N.evidence_gate(d)[1]


@query("r16_valid", "SELECT doc_id FROM news_enriched WHERE trim(title) <> '' AND dimension_primary IS NOT NULL AND lang <> 'de'")
def _(spark, sf):
    d = enriched(spark, sf).withColumn("citation", F.when(F.col("lang") == "de", " ").otherwise("[x]"))
    return N.evidence_gate(d)[0].select("doc_id")


@query("s8_union_sources", """
SELECT bucket, count(*) AS n_items, count(author) AS with_author, min(title_len) AS min_len FROM (
  SELECT 'DOCS' AS bucket, NULL AS author, length(title) AS title_len FROM news UNION ALL SELECT 'PAGES', url, length(title) FROM page_texts UNION ALL SELECT 'CALLS', role, length(text) FROM conversations) GROUP BY 1""")
def _(spark, sf):
    from ..sources.documents import page_title

    docs = V.news(spark, sf).select("title", "url", "content")
    pages = V.table(spark, sf, "pages").select(page_title(F.col("html")).alias("title"), "url", F.col("url").alias("author"))
    calls = V.table(spark, sf, "conversations").select(F.col("text").alias("title"), F.col("role").alias("author"))
    items, _stats = N.union_sources({"DOCS": docs, "PAGES": pages, "CALLS": calls})
    return items.groupBy("bucket").agg(F.count("*").alias("n_items"), F.count("author").alias("with_author"), F.min(F.length("title")).cast("bigint").alias("min_len"))


@query("n5_guard", f"""
SELECT doc_id, relevance_score::INT AS relevance_score FROM news_accepted WHERE NOT {contains_any("lower(title || ' ' || summary_2line)", ["hahaha", "ggg"])} AND (len(company_tags) > 0 OR {contains_any("lower(title || ' ' || summary_2line)", ["the", "der"])})
  AND relevance_score >= 5 AND (list_contains(company_tags, 'C_EN') OR market_scope <> 'company')""")
def _(spark, sf):
    return N.serving_guard(accepted(spark, sf), ["the", "der"], ["hahaha", "ggg"], 5, "C_EN").select("doc_id", "relevance_score")


@query("a11_top_dims", "SELECT dimension, count(*) AS n FROM (SELECT unnest(dimensions) AS dimension FROM news_enriched) GROUP BY 1 ORDER BY n DESC, dimension LIMIT 6")
def _(spark, sf):
    return enriched(spark, sf).select(F.explode("dimensions").alias("dimension")).groupBy("dimension").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dimension").limit(6)


@query("a11b_scope_sentiment", "SELECT market_scope, sentiment, count(*) AS n FROM news_enriched WHERE drop_reason IS NULL GROUP BY 1, 2")
def _(spark, sf):
    return accepted(spark, sf).groupBy("market_scope", "sentiment").agg(F.count("*").alias("n"))


@query("a12_health", "SELECT source AS bucket, coalesce(drop_reason, 'accepted') AS outcome, count(*) AS n FROM news_enriched GROUP BY GROUPING SETS ((source, coalesce(drop_reason, 'accepted')), (coalesce(drop_reason, 'accepted')), ())")
def _(spark, sf):
    """Outcome counts per bucket, overall and total; rolled up from the finest counts."""
    fine = enriched(spark, sf).groupBy(F.col("source").alias("bucket"), F.coalesce("drop_reason", F.lit("accepted")).alias("outcome")).agg(F.count("*").alias("n"))
    b, o = F.col("bucket"), F.col("outcome")
    out = fine.groupingSets([[b, o], [o], []], b, o).agg(F.sum("n").alias("n"), F.grouping(o).alias("g"))
    return out.select("bucket", F.when(F.col("g") == 1, F.lit("accepted").substr(1, 0)).otherwise(F.col("outcome")).alias("o2"), "n").select("bucket", F.nullif("o2", F.lit("")).alias("outcome"), "n")


@query("a15_digest", """
SELECT section, CAST(row_number() OVER (PARTITION BY section ORDER BY published_date DESC, relevance_score DESC, doc_id) AS INT) AS rank, doc_id, citation FROM (
  SELECT *, unnest(CASE WHEN len(company_tags) > 0 THEN company_tags WHEN market_scope = 'global' THEN ['global'] ELSE ['sector'] END) AS section FROM news_accepted)
QUALIFY rank <= CASE WHEN section IN ('sector', 'global') THEN 15 ELSE 12 END""")
def _(spark, sf):
    e = N.digest_entries(accepted(spark, sf), 12, {"sector": 15, "global": 15})
    return e.select("section", "rank", "doc_id", "citation")


@query("n7_daily")
def _(spark, sf):
    """The whole daily run; its flat rows replace the days they hold, and the nested
    digest goes to JSON. Tested against brute force, as the fuzzy step has no SQL form."""
    entries, _n, _m = N.daily_run(enriched(spark, sf), "doc_id", 12, {"sector": 15, "global": 15})
    entries, path = cut_lineage(entries), scratch_path(spark, "digest")
    K.replace_partitions(entries.select("section", "rank", "doc_id", "title", "citation", "published_date"), f"{path}/flat", "published_date")
    K.write_json(N.digest(entries), f"{path}/json")
    flat = spark.read.parquet(f"{path}/flat").select(F.col("published_date").cast("string").alias("day"), "section", "rank", "doc_id", "citation")
    nested = spark.read.json(f"{path}/json").select("section", F.explode("items").alias("i")).select("section", F.col("i.rank").cast("int").alias("rank"), F.col("i.url").alias("url"))
    return flat.join(nested, ["section", "rank"])


@query("n7_health")
def _(spark, sf):
    """Items by source after each step of the daily run."""
    return N.daily_run(enriched(spark, sf), "doc_id")[1]


@query("n7_report")
def _(spark, sf):
    """Health report of the daily run; some titles are blanked so that the evidence gate
    drops items. Tested against the steps one by one."""
    d = cut_lineage(enriched(spark, sf).drop("scoring_text").withColumn("title", F.when(F.col("doc_id") % 7 == 4, " ").otherwise(F.col("title"))))
    _entries, counts, missing = N.daily_run(d, "doc_id", 12, {"sector": 15, "global": 15})
    return N.health_report(d, counts, missing)


_EV = "SELECT event_id, event_type, 'src_' || (user_id % 7) AS source, 'bucket_' || (event_id % 3) AS source_bucket, CASE WHEN value >= 50 THEN 'large' ELSE 'small' END AS dimension_primary, CASE WHEN user_id % 4 = 0 THEN ['C' || (user_id % 20), 'C' || (user_id % 11)] ELSE ['C' || (user_id % 20)] END AS companies, CASE WHEN event_type = 'purchase' THEN ['revenue', 'orders'] ELSE [] END AS metrics FROM events"
view("news_events", _EV)


def news_events(spark, sf):
    u = F.col("user_id")
    c = lambda m: F.concat(F.lit("C"), u % m)
    return V.table(spark, sf, "events").select(
        "event_id", "event_type", F.concat(F.lit("src_"), u % 7).alias("source"), F.concat(F.lit("bucket_"), F.col("event_id") % 3).alias("source_bucket"),
        F.when(F.col("value") >= 50, "large").otherwise("small").alias("dimension_primary"), F.when(u % 4 == 0, F.array(c(20), c(11))).otherwise(F.array(c(20))).alias("companies"),
        F.when(F.col("event_type") == "purchase", F.array(F.lit("revenue"), F.lit("orders"))).otherwise(F.array().cast("array<string>")).alias("metrics"))


@query("n6_event_fanout", """
SELECT kind, rel, name, count(*) AS n FROM (SELECT event_id, 'Source' AS kind, 'FROM_SOURCE' AS rel, source AS name FROM news_events UNION SELECT event_id, 'SourceBucket', 'IN_SOURCE_BUCKET', source_bucket FROM news_events
  UNION SELECT event_id, 'Dimension', 'ALIGNS_WITH', dimension_primary FROM news_events UNION SELECT event_id, 'Topic', 'TAGGED_AS', event_type FROM news_events
  UNION SELECT event_id, 'Company', 'AFFECTED_BY', unnest(companies) FROM news_events UNION SELECT event_id, 'Metric', 'IMPACTS_METRIC', unnest(metrics) FROM news_events) GROUP BY 1, 2, 3""")
def _(spark, sf):
    return N.event_graph(news_events(spark, sf))[1].groupBy("kind", "rel", "name").agg(F.count("*").alias("n"))
