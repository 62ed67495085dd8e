"""Deterministic views over the given tables, each with a SQL twin.

The tables are a generic star schema plus documents, so these views give the
shapes the library works on: one company per supplier, fiscal facts from line
items, claims from prior actuals, risk flags from events, news from documents.
Every view reads its whole table, so work grows with the data.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import periods as P
from .registry import view

METRICS = [
    "revenue", "expenses", "operating_profit", "opm", "interest", "net_profit",
    "borrowings", "equity", "total_assets", "occupancy", "revpar", "icr",
]

# claim metric type -> (fact metric, check, index used by the value pattern)
CLAIM_METRICS = {
    "Revenue": ("revenue", "check_6_supply", 1),
    "EBITDA Margin": ("opm", "check_4_fnb", 2),
    "Debt Reduction": ("borrowings", "check_5_debt", 3),
    "Occupancy": ("occupancy", "check_3_driver", 4),
    "RevPAR": ("revpar", "check_1_revpar", 5),
    "Interest Coverage": ("icr", "check_5_debt", 6),
    "New Room Additions": ("total_assets", "check_2_keys", 7),
}
HEDGES = ["will", "confident", "expect", "plan", "hope"]
RISK_CATEGORIES = [
    "debt", "margin_compression", "supply_overhang", "operational", "governance",
    "management_mismatch", "key_person", "regulatory", "demand",
]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def companies(spark, sf):
    s, n, r = (table(spark, sf, t) for t in ("supplier", "nation", "region"))
    return (
        s.join(n, s.s_nationkey == n.n_nationkey)
        .join(r, n.n_regionkey == r.r_regionkey)
        .select(
            F.concat(F.lit("C"), "s_suppkey").alias("company_id"),
            F.col("s_suppkey").alias("skey"),
            F.col("s_name").alias("name"),
            F.col("r_name").alias("segment"),
            F.col("n_name").alias("market"),
        )
    )


view("companies", """
SELECT 'C' || s_suppkey AS company_id, s_suppkey AS skey, s_name AS name, r_name AS segment, n_name AS market
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")


def quarter_sums(spark, sf):
    """One row per (company, fiscal quarter): exact decimal sums, one scan, one shuffle."""
    li = table(spark, sf, "lineitem")
    price = F.col("l_extendedprice")
    money = lambda c: c.cast("decimal(18,4)")
    return (
        li.select(
            F.col("l_suppkey").alias("skey"),
            P.fiscal_year(F.col("l_shipdate")).alias("fy"),
            P.fiscal_quarter(F.col("l_shipdate")).alias("q"),
            money(price * (1 - F.col("l_discount"))).alias("rev"),
            money(price * F.col("l_tax")).alias("tax"),
            money(F.when(F.col("l_linestatus") == "O", price).otherwise(0.0)).alias("open_amt"),
            money(F.when(F.col("l_returnflag") == "R", price).otherwise(0.0)).alias("ret_amt"),
            money(F.col("l_quantity")).alias("qty"),
        )
        .groupBy("skey", "fy", "q")
        .agg(*[F.sum(c).cast("decimal(28,4)").alias(c) for c in ("rev", "tax", "open_amt", "ret_amt", "qty")])
    )


view("quarter_sums", """
SELECT l_suppkey AS skey, CAST(year(l_shipdate) + CASE WHEN month(l_shipdate) >= 4 THEN 1 ELSE 0 END AS INT) AS fy,
  CAST(((month(l_shipdate) + 8) % 12) // 3 + 1 AS INT) AS q,
  sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS rev,
  sum(CAST(l_extendedprice * l_tax AS DECIMAL(18,4))) AS tax,
  sum(CAST(CASE WHEN l_linestatus = 'O' THEN l_extendedprice ELSE 0 END AS DECIMAL(18,4))) AS open_amt,
  sum(CAST(CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0 END AS DECIMAL(18,4))) AS ret_amt,
  sum(CAST(l_quantity AS DECIMAL(18,4))) AS qty
FROM lineitem GROUP BY 1, 2, 3""")


def facts_wide(spark, sf):
    """Quarterly and annual statement rows; the year is rolled up from the quarters."""
    sums = ("rev", "tax", "open_amt", "ret_amt", "qty")
    both = (
        quarter_sums(spark, sf)
        .withColumn("q", F.explode(F.array(F.col("q"), F.lit(None).cast("int"))))
        .groupBy("skey", "fy", "q")
        .agg(*[F.sum(c).cast("double").alias(c) for c in sums])
    )
    cost_pct = 62 + (F.col("skey") * 5 + F.col("fy")) % 34
    return (
        both.select(
            "skey", F.concat(F.lit("C"), "skey").alias("company_id"), "fy", "q",
            F.when(F.col("q").isNull(), "annual").otherwise("quarterly").alias("period_type"),
            F.when(F.col("q").isNull(), P.fy_label(F.col("fy"))).otherwise(P.quarter_label(F.col("fy"), F.col("q"))).alias("period"),
            (F.col("fy") * 4 + F.coalesce(F.col("q"), F.lit(4))).alias("ord"),
            F.col("rev").alias("revenue"),
            (F.col("rev") * cost_pct / 100).alias("expenses"),
            (F.col("tax") * (1 + F.col("skey") % 8)).alias("interest"),
            F.col("open_amt").alias("borrowings"),
            F.col("ret_amt").alias("equity"),
            (F.col("open_amt") + F.col("ret_amt") + F.col("rev")).alias("total_assets"),
            F.col("qty").alias("occupancy"),
            (F.col("rev") / F.when(F.col("qty") != 0, F.col("qty"))).alias("revpar"),
        )
        .withColumn("operating_profit", F.col("revenue") - F.col("expenses"))
        .withColumn("opm", 100 * F.col("operating_profit") / F.when(F.col("revenue") != 0, F.col("revenue")))
        .withColumn("net_profit", F.col("operating_profit") - F.col("interest"))
        .withColumn("icr", F.col("operating_profit") / F.when(F.col("interest") != 0, F.col("interest")))
    )


view("facts_wide", """
SELECT *, 100 * operating_profit / nullif(revenue, 0) AS opm, operating_profit - interest AS net_profit,
  operating_profit / nullif(interest, 0) AS icr
FROM (SELECT *, revenue - expenses AS operating_profit FROM (
  SELECT skey, 'C' || skey AS company_id, fy, q,
    CASE WHEN q IS NULL THEN 'annual' ELSE 'quarterly' END AS period_type,
    CASE WHEN q IS NULL THEN '' ELSE 'Q' || q || ' ' END || 'FY' || lpad(CAST(fy % 100 AS VARCHAR), 2, '0') AS period,
    CAST(fy * 4 + coalesce(q, 4) AS INT) AS ord,
    rev AS revenue, rev * (62 + (skey * 5 + fy) % 34) / 100 AS expenses, tax * (1 + skey % 8) AS interest,
    open_amt AS borrowings, ret_amt AS equity, open_amt + ret_amt + rev AS total_assets, qty AS occupancy,
    rev / nullif(qty, 0) AS revpar
  FROM (SELECT skey, fy, q, CAST(sum(rev) AS DOUBLE) AS rev, CAST(sum(tax) AS DOUBLE) AS tax,
      CAST(sum(open_amt) AS DOUBLE) AS open_amt, CAST(sum(ret_amt) AS DOUBLE) AS ret_amt, CAST(sum(qty) AS DOUBLE) AS qty
    FROM quarter_sums GROUP BY GROUPING SETS ((skey, fy, q), (skey, fy)))))""")

_FACT_IDS = ["skey", "company_id", "fy", "q", "period_type", "period", "ord"]


def financials(spark, sf, metrics=None, wide=None):
    """Long fact table (company, period, metric, value); missing cells dropped.

    ``wide`` passes statement rows that a caller has computed already.
    """
    wide = facts_wide(spark, sf) if wide is None else wide
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics or METRICS])
    return wide.select(*_FACT_IDS, F.inline(F.filter(cells, lambda c: c["value"].isNotNull())))


view("financials", f"""
SELECT skey, company_id, fy, q, period_type, period, ord, metric, value
FROM (UNPIVOT facts_wide ON {', '.join(METRICS)} INTO NAME metric VALUE value)""")


def actual_revisions(spark, sf, wide=None):
    """Facts as reported: every seventh (company, year) row was revised once later."""
    f = financials(spark, sf, wide=wide)
    return (
        f.withColumn("rev_no", F.explode(F.when((F.col("skey") + F.col("fy")) % 7 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
        .select(
            "company_id", "period", "period_type", "ord", "metric",
            F.when(F.col("rev_no") == 1, F.col("value") * 101 / 100).otherwise(F.col("value")).alias("value"),
            F.col("rev_no").alias("created_at"),
            F.concat_ws("|", "company_id", "period", "metric", F.col("rev_no").cast("string")).alias("id"),
            F.concat(F.col("period"), F.lit(".csv")).alias("source_document"),
            (F.col("fy") % 50).alias("source_page"),
        )
    )


view("actual_revisions", """
SELECT company_id, period, period_type, ord, metric, CASE WHEN rev_no = 1 THEN value * 101 / 100 ELSE value END AS value,
  rev_no AS created_at, company_id || '|' || period || '|' || metric || '|' || rev_no AS id,
  period || '.csv' AS source_document, CAST(fy % 50 AS INT) AS source_page
FROM (SELECT *, unnest(CASE WHEN (skey + fy) % 7 = 0 THEN [0, 1] ELSE [0] END) AS rev_no FROM financials)""")


def metric_map(spark):
    rows = [(k, m, c, i) for k, (m, c, i) in CLAIM_METRICS.items()]
    return spark.createDataFrame(rows, "metric_type string, metric string, check_type string, mi int")


view("metric_map", "SELECT * FROM (VALUES " + ", ".join(
    f"('{k}', '{m}', '{c}', {i})" for k, (m, c, i) in CLAIM_METRICS.items()) + ") t(metric_type, metric, check_type, mi)")


def _pick(options, idx):
    return F.element_at(F.array(*[F.lit(o) for o in options]), (idx + 1).cast("int"))


def claims(spark, sf, wide=None):
    """One claim per (company, year, mapped metric), derived from the prior year."""
    annual = financials(spark, sf, [m for m, _, _ in CLAIM_METRICS.values()], wide).filter("period_type = 'annual'")
    w = Window.partitionBy("company_id", "metric").orderBy("fy")
    v = F.col("prev") * (100 + (F.col("skey") * 7 + F.col("fy") * 3 + F.col("mi") * 5) % 41 - 20) / 100
    ranged = (F.col("skey") + F.col("fy")) % 5 == 0
    absent = (F.col("skey") + F.col("fy") + F.col("mi")) % 11 == 0
    return (
        annual.withColumn("prev", F.lag("value").over(w))
        .filter(F.col("prev").isNotNull())
        .join(F.broadcast(metric_map(spark)), "metric")
        .select(
            F.substring(F.sha1(F.concat_ws("|", "company_id", "period", "metric_type")), 1, 16).alias("claim_id"),
            "company_id", "skey", "fy", "ord", "metric_type", "check_type",
            P.quarter_label(F.col("fy"), F.lit(1)).alias("statement_quarter"),
            F.when(F.col("mi") % 2 == 0, F.concat(F.lit("FY "), F.col("fy").cast("string"))).otherwise(F.col("period")).alias("target_period"),
            F.when(ranged & ~absent, v * 0.9).alias("guidance_low"),
            F.when(ranged & ~absent, v * 1.1).alias("guidance_high"),
            F.when(~ranged & ~absent, v).alias("guidance_point"),
            _pick(HEDGES, (F.col("skey") + F.col("fy") + F.col("mi")) % 5).alias("confidence_language"),
            F.concat(F.lit("call_"), "fy", F.lit(".json")).alias("source_document"),
            ((F.col("skey") + F.col("mi")) % 90 + 1).cast("int").alias("source_page"),
            F.when(F.col("mi") % 3 == 0, F.format_string("%02d:%02d", F.col("skey") % 60, F.col("fy") % 60)).alias("source_timestamp"),
        )
    )


view("claims", """
SELECT substr(sha1(company_id || '|' || period || '|' || metric_type), 1, 16) AS claim_id, company_id, skey, fy, ord, metric_type, check_type,
  'Q1 FY' || lpad(CAST(fy % 100 AS VARCHAR), 2, '0') AS statement_quarter,
  CASE WHEN mi % 2 = 0 THEN 'FY ' || fy ELSE period END AS target_period,
  CASE WHEN ranged AND NOT absent THEN v * 0.9::DOUBLE END AS guidance_low, CASE WHEN ranged AND NOT absent THEN v * 1.1::DOUBLE END AS guidance_high,
  CASE WHEN NOT ranged AND NOT absent THEN v END AS guidance_point,
  (['will', 'confident', 'expect', 'plan', 'hope'])[(skey + fy + mi) % 5 + 1] AS confidence_language,
  'call_' || fy || '.json' AS source_document, CAST((skey + mi) % 90 + 1 AS INT) AS source_page,
  CASE WHEN mi % 3 = 0 THEN lpad(CAST(skey % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(fy % 60 AS VARCHAR), 2, '0') END AS source_timestamp
FROM (SELECT *, prev * (100 + (skey * 7 + fy * 3 + mi * 5) % 41 - 20) / 100 AS v, (skey + fy) % 5 = 0 AS ranged,
    (skey + fy + mi) % 11 = 0 AS absent
  FROM (SELECT *, lag(value) OVER (PARTITION BY company_id, metric ORDER BY fy) AS prev FROM financials WHERE period_type = 'annual')
  JOIN metric_map USING (metric) WHERE prev IS NOT NULL)""")


def risk_flags(spark, sf):
    """One flag per (company, category) whose error events add up to a material amount."""
    e = table(spark, sf, "events").filter("event_type = 'error'")
    k = F.get_json_object("props", "$.k").cast("int")
    c = companies(spark, sf).select("skey", "company_id")
    grouped = (
        e.select(F.col("user_id").alias("skey"), _pick(RISK_CATEGORIES, k % 9).alias("category"), "event_id", F.col("value").cast("decimal(18,2)").alias("v"))
        .groupBy("skey", "category")
        .agg(F.sum("v").cast("double").alias("amount"), F.min("event_id").alias("event_id"), F.count("*").alias("n"))
        .filter("amount >= 90")
    )
    return grouped.join(c, "skey").select(
        "company_id", "skey", "category",
        F.when(F.col("amount") >= 220, "critical").when(F.col("amount") >= 150, "high").otherwise("medium").alias("severity"),
        F.concat_ws(" ", "category", F.col("n").cast("string"), F.lit("events")).alias("description"),
        F.concat(F.lit("log_"), (F.col("event_id") % 7).cast("string"), F.lit(".pdf")).alias("source_document"),
        (F.col("event_id") % 40 + 1).cast("int").alias("source_page"), F.lit("FY24").alias("period"), "event_id",
    )


view("risk_flags", """
SELECT company_id, skey, category, CASE WHEN amount >= 220 THEN 'critical' WHEN amount >= 150 THEN 'high' ELSE 'medium' END AS severity,
  category || ' ' || n || ' events' AS description, 'log_' || (event_id % 7) || '.pdf' AS source_document,
  CAST(event_id % 40 + 1 AS INT) AS source_page, 'FY24' AS period, event_id
FROM (SELECT user_id AS skey, (['debt', 'margin_compression', 'supply_overhang', 'operational', 'governance', 'management_mismatch', 'key_person', 'regulatory', 'demand'])[CAST(json_extract_string(props, '$.k') AS INT) % 9 + 1] AS category,
    CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS amount, min(event_id) AS event_id, count(*) AS n
  FROM events WHERE event_type = 'error' GROUP BY 1, 2) JOIN companies USING (skey) WHERE amount >= 90""")


#: News items of one publication day.
DAY_ITEMS = 400
#: Ids of the second reports of a story start here.
AGAIN = 10_000_000_000


def news(spark, sf):
    """News items from documents, whole: days are ranges of ids, so they grow with the
    rows, and a summary is the text's first paragraph. Every ninth item is reported a
    second time later that day, every other time with a letter more in its title."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "source", "text", F.substring_index("text", "\n", 1).alias("title"))
    d = d.withColumn("day", F.floor(F.col("doc_id") / DAY_ITEMS).cast("int"))
    # one scan: an item and its second report leave the same row
    report = lambda i, t: F.struct(i.alias("doc_id"), t.alias("title"))
    first = report(F.col("doc_id"), F.col("title"))
    later = report(F.col("doc_id") + AGAIN, F.when(F.col("doc_id") % 2 == 0, F.concat("title", F.lit("s"))).otherwise(F.col("title")))
    d = d.select("lang", "source", "text", "day", F.inline(F.when(F.col("doc_id") % 9 == 4, F.array(first, later)).otherwise(F.array(first))))
    return d.select(
        "doc_id", "lang", "source", "title",
        F.concat(F.lit("HTTPS://"), "source", F.lit(".example.com/"), "lang", F.lit("/"), F.col("doc_id") % 700, F.lit("?utm_source=feed&id="), F.col("doc_id") % 350, F.lit("#top")).alias("url"),
        F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.col("day")), "yyyy-MM-dd").alias("published_date"),
        F.substring_index("text", "\n\n", 1).alias("summary"),
        F.col("text").alias("content"),
    )


view("news", f"""
SELECT doc_id, lang, source, title,
  'HTTPS://' || source || '.example.com/' || lang || '/' || (doc_id % 700) || '?utm_source=feed&id=' || (doc_id % 350) || '#top' AS url,
  strftime(DATE '2024-01-01' + CAST(day AS INT), '%Y-%m-%d') AS published_date,
  split_part(text, chr(10) || chr(10), 1) AS summary, text AS content
FROM (SELECT doc_id, lang, source, text, split_part(text, chr(10), 1) AS title, doc_id // {DAY_ITEMS} AS day FROM documents
  UNION ALL SELECT doc_id + {AGAIN}, lang, source, text, split_part(text, chr(10), 1) || CASE WHEN doc_id % 2 = 0 THEN 's' ELSE '' END, doc_id // {DAY_ITEMS} FROM documents WHERE doc_id % 9 = 4)""")


def union_all(frames):
    return reduce(lambda a, b: a.unionByName(b), frames)
