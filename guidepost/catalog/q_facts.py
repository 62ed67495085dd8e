"""Facts: reshape, periods, units, period joins, series and window queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import periods as P
from ..functions import values as X
from ..operators import joins as J
from ..operators import ordered as O
from ..operators import stats as A
from ..sources import statements as ST
from . import views as V
from .q_scoring import annual, deviations
from .registry import query, view

MONTH_SQL = "(['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'])"


@query("r1_unpivot", f"""
SELECT company_id, metric, period, value FROM financials WHERE period_type = 'annual'
AND metric IN ({', '.join(repr(m) for m in ST.STATEMENT_METRICS.values())})""")
def _(spark, sf):
    """Statement table (metric rows, period columns, a TTM column) back to long facts."""
    facts = annual(spark, sf, list(ST.STATEMENT_METRICS.values()))
    columns = ST.year_columns(facts)
    wide = ST.statement_table(facts, columns)
    wide = wide.withColumn("TTM", F.col(f"`{max(columns.values())}`") if columns else F.lit(None).cast("double"))
    return ST.melt_statement(wide, ["company_id"], "row")


@query("r2_pivot", f"SELECT company_id, period, ord, {', '.join(V.METRICS)} FROM facts_wide WHERE period_type = 'annual'")
def _(spark, sf):
    return ST.pivot_metrics(annual(spark, sf), ["company_id", "period", "ord"], V.METRICS)


@query("r3_parse_num", """
SELECT kind, count(*) AS n, count(value) AS parsed, sum(CAST(value AS DECIMAL(18,2))) AS total FROM (
  SELECT o_orderkey % 6 AS kind, CASE WHEN o_orderkey % 6 < 3 THEN o_totalprice END AS value FROM orders) GROUP BY 1""")
def _(spark, sf):
    """Text cells built from order totals, parsed back and added up exactly."""
    o, k = V.table(spark, sf, "orders"), F.col("o_orderkey") % 6
    plain = F.format_number("o_totalprice", 2)
    cell = F.when(k == 0, plain).when(k == 1, F.concat(plain, F.lit("%"))).when(k == 2, F.concat(F.lit("  "), plain)).when(k == 3, " nan ").when(k == 4, "").otherwise("(none)")
    cells = o.select(k.alias("kind"), X.parse_num(cell).alias("value"))
    return cells.groupBy("kind").agg(F.count("*").alias("n"), F.count("value").alias("parsed"), F.sum(F.col("value").cast("decimal(18,2)")).cast("decimal(38,2)").alias("total"))


@query("r4_fiscal_period", f"""
SELECT label, fiscal, half, CAST(y * 12 + m AS INT) AS key, CAST(fy * 12 + CASE WHEN m = 3 THEN 3 ELSE -12 + 3 + q * 3 END AS INT) AS fiscal_key, label AS back, n FROM (
SELECT *, {MONTH_SQL}[m] || ' ' || y AS label, CASE WHEN m = 3 THEN '' ELSE 'Q' || q || ' ' END || 'FY' || lpad(CAST(fy % 100 AS VARCHAR), 2, '0') AS fiscal,
  CASE WHEN m = 9 THEN 'H1 FY' || lpad(CAST((y + 1) % 100 AS VARCHAR), 2, '0') WHEN m = 3 THEN 'FY' || lpad(CAST(fy % 100 AS VARCHAR), 2, '0') ELSE 'Q' || q || ' FY' || lpad(CAST(fy % 100 AS VARCHAR), 2, '0') END AS half
FROM (SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, year(o_orderdate) + CASE WHEN month(o_orderdate) >= 4 THEN 1 ELSE 0 END AS fy, ((month(o_orderdate) + 8) % 12) // 3 + 1 AS q, count(*) AS n FROM orders GROUP BY ALL))""")
def _(spark, sf):
    """Column labels of every order month through the label algebra and back."""
    label = F.date_format("o_orderdate", "MMM yyyy")
    g = V.table(spark, sf, "orders").groupBy(label.alias("label")).agg(F.count("*").alias("n"))
    fiscal = P.column_label_to_fiscal(F.col("label"))
    key = P.period_key(F.col("label"))
    return g.select("label", fiscal.alias("fiscal"), P.half_year_label(F.col("label")).alias("half"), key.alias("key"),
                    P.period_key(fiscal).alias("fiscal_key"), P.key_to_column_label(key).alias("back"), "n")


_LABELS = "CASE o_orderkey % 5 WHEN 0 THEN 'FY ' || fy WHEN 1 THEN 'fy' || fy WHEN 2 THEN ' FY' || yy WHEN 3 THEN 'Q' || q || ' FY' || yy ELSE 'Q' || q || 'FY ' || fy END"


@query("r5_norm_period", f"""
SELECT label, CASE WHEN kind < 3 THEN 'FY' || yy ELSE 'Q' || q || 'FY' || yy END AS normalised,
  replace(replace(replace(upper(trim(label)), 'FY 20', 'FY'), 'FY20', 'FY'), ' ', '') AS compat, count(*) AS n
FROM (SELECT {_LABELS} AS label, o_orderkey % 5 AS kind, yy, q FROM (SELECT *, lpad(CAST(fy % 100 AS VARCHAR), 2, '0') AS yy FROM (
  SELECT o_orderkey, year(o_orderdate) + CASE WHEN month(o_orderdate) >= 4 THEN 1 ELSE 0 END AS fy, ((month(o_orderdate) + 8) % 12) // 3 + 1 AS q FROM orders))) GROUP BY ALL""")
def _(spark, sf):
    d = F.col("o_orderdate")
    fy, q, k = P.fiscal_year(d), P.fiscal_quarter(d), F.col("o_orderkey") % 5
    label = (
        F.when(k == 0, F.concat(F.lit("FY "), fy)).when(k == 1, F.concat(F.lit("fy"), fy)).when(k == 2, F.concat(F.lit(" "), P.fy_label(fy)))
        .when(k == 3, P.quarter_label(fy, q)).otherwise(F.concat(F.lit("Q"), q, F.lit("FY "), fy)))
    g = V.table(spark, sf, "orders").groupBy(label.alias("label")).agg(F.count("*").alias("n"))
    return g.select("label", P.normalise_period(F.col("label")).alias("normalised"), P.normalise_period(F.col("label"), compat=True).alias("compat"), "n")


@query("r6_call_quarter", """
SELECT CAST(y AS INT) AS y, CAST(m AS INT) AS m, 'Q' || CASE WHEN q = 1 THEN 4 ELSE q - 1 END || ' FY' || lpad(CAST((CASE WHEN q = 1 THEN fy - 1 ELSE fy END) % 100 AS VARCHAR), 2, '0') AS quarter, n
FROM (SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, year(o_orderdate) + CASE WHEN month(o_orderdate) >= 4 THEN 1 ELSE 0 END AS fy, ((month(o_orderdate) + 8) % 12) // 3 + 1 AS q, count(*) AS n FROM orders GROUP BY ALL)""")
def _(spark, sf):
    g = V.table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m")).agg(F.count("*").alias("n"))
    return g.select("y", "m", P.call_month_to_quarter(F.col("y"), F.col("m")).alias("quarter"), "n")


_UNITS = ["crore", "million", "bn", "lakhs", "%", "bps", "rooms", ""]
_KINDS = ["currency", "percentage_level", "ratio"]


@query("r7_units", """
SELECT unit, kind, count(*) AS n, count(v) AS converted, round(sum(CAST(v AS DECIMAL(28,6))), 4)::DECIMAL(28,4) AS total FROM (
SELECT unit, kind, CASE WHEN unit = 'rooms' THEN NULL WHEN unit = 'bps' THEN p / 100.0::DOUBLE WHEN kind <> 'currency' THEN p
  WHEN unit = 'crore' OR unit = '' THEN p WHEN unit = 'million' THEN p * 0.1::DOUBLE WHEN unit = 'bn' THEN p * 100.0::DOUBLE WHEN unit = 'lakhs' THEN p * 0.01::DOUBLE END AS v
FROM (SELECT o_totalprice AS p, (['crore', 'million', 'bn', 'lakhs', '%', 'bps', 'rooms', ''])[o_orderkey % 8 + 1] AS unit, (['currency', 'percentage_level', 'ratio'])[o_custkey % 3 + 1] AS kind FROM orders)) GROUP BY 1, 2""")
def _(spark, sf):
    o = V.table(spark, sf, "orders").select("o_totalprice", V._pick(_UNITS, F.col("o_orderkey") % 8).alias("unit"), V._pick(_KINDS, F.col("o_custkey") % 3).alias("kind"))
    v = X.to_base_unit(F.col("o_totalprice"), F.col("unit"), F.col("kind"))
    return o.select("unit", "kind", v.cast("decimal(28,6)").alias("v")).groupBy("unit", "kind").agg(
        F.count("*").alias("n"), F.count("v").alias("converted"), F.round(F.sum("v"), 4).cast("decimal(28,4)").alias("total"))


# ---- period joins ---------------------------------------------------------------
view("targets", """
SELECT claim_id, company_id, metric, metric_type, fy + 1 AS target_fy, 'FY' || lpad(CAST((fy + 1) % 100 AS VARCHAR), 2, '0') AS target_period, CAST((fy - 1) * 4 + 1 + skey % 4 AS INT) AS source_ord,
  CASE WHEN metric = 'borrowings' THEN 'min' ELSE 'max' END AS best FROM claims JOIN metric_map USING (metric_type)""")


def targets(spark, sf):
    """Open promises: a claim restated for the year after, made in some quarter before."""
    return V.claims(spark, sf).join(F.broadcast(V.metric_map(spark).select("metric_type", "metric")), "metric_type").select(
        "claim_id", "company_id", "metric", "metric_type", (F.col("fy") + 1).alias("target_fy"), P.fy_label(F.col("fy") + 1).alias("target_period"),
        ((F.col("fy") - 1) * 4 + 1 + F.col("skey") % 4).cast("int").alias("source_ord"), F.when(F.col("metric") == "borrowings", "min").otherwise("max").alias("best"))


@query("j3_period_lookup", """
SELECT t.claim_id, t.company_id, t.metric, t.target_period, f.value AS actual, CASE WHEN f.value IS NULL THEN 'PENDING' ELSE 'AVAILABLE' END AS status, l.last_period,
  t.target_fy > l.last_fy AS after_latest
FROM targets t LEFT JOIN (SELECT * FROM financials WHERE period_type = 'annual') f ON f.company_id = t.company_id AND f.metric = t.metric AND f.period = t.target_period
LEFT JOIN (SELECT company_id, metric, max(fy) AS last_fy, max_by(period, fy) AS last_period FROM financials WHERE period_type = 'annual' GROUP BY 1, 2) l ON l.company_id = t.company_id AND l.metric = t.metric""")
def _(spark, sf):
    f = annual(spark, sf, [m for m, _, _ in V.CLAIM_METRICS.values()])
    last = f.groupBy("company_id", "metric").agg(F.max("fy").alias("last_fy"), F.max_by("period", "fy").alias("last_period"))
    cell = f.select("company_id", "metric", F.col("period").alias("target_period"), F.col("value").alias("actual"))
    j = targets(spark, sf).join(cell, ["company_id", "metric", "target_period"], "left").join(last, ["company_id", "metric"], "left")
    return j.select("claim_id", "company_id", "metric", "target_period", "actual", F.when(F.col("actual").isNull(), "PENDING").otherwise("AVAILABLE").alias("status"),
                    "last_period", (F.col("target_fy") > F.col("last_fy")).alias("after_latest"))


@query("j4_forward_window", """
SELECT claim_id, company_id, metric, best, CASE best WHEN 'min' THEN min_by(value, value * 1000000::DOUBLE) ELSE max(value) END AS window_value,
  string_agg(period, ',' ORDER BY ord) AS window_periods
FROM (SELECT t.claim_id, t.company_id, t.metric, t.best, f.value, f.period, f.ord, row_number() OVER (PARTITION BY t.claim_id ORDER BY f.ord) AS rn
  FROM targets t LEFT JOIN (SELECT * FROM financials WHERE period_type = 'quarterly') f ON f.company_id = t.company_id AND f.metric = t.metric AND f.ord > t.source_ord) WHERE rn <= 4 GROUP BY 1, 2, 3, 4""")
def _(spark, sf):
    """Next four reported quarters after the statement and the best value in them."""
    f = V.financials(spark, sf, [m for m, _, _ in V.CLAIM_METRICS.values()]).filter("period_type = 'quarterly'")
    pts = J.series(f, ["company_id", "metric"], "ord", "value", "period")
    out = J.forward_window(targets(spark, sf), pts, ["company_id", "metric"], "source_ord", F.lit(4), F.col("best"))
    return out.select("claim_id", "company_id", "metric", "best", "window_value", F.nullif(F.array_join("window_periods", ","), F.lit("")).alias("window_periods"))


@query("j5_asof_backward", """
SELECT t.claim_id, t.company_id, t.metric, t.source_ord, f.ord AS asof_key, f.value AS asof_value, f.period AS asof_period
FROM targets t ASOF LEFT JOIN (SELECT * FROM financials WHERE period_type = 'quarterly') f ON f.company_id = t.company_id AND f.metric = t.metric AND f.ord <= t.source_ord""")
def _(spark, sf):
    """Latest quarter at or before the statement, carried forward block by block."""
    f = V.financials(spark, sf, [m for m, _, _ in V.CLAIM_METRICS.values()]).filter("period_type = 'quarterly'").select("company_id", "metric", F.col("ord").cast("int").alias("ord"), "value", "period")
    t = targets(spark, sf).select("claim_id", "company_id", "metric", "source_ord")
    return J.asof_backward(t, f, ["company_id", "metric"], "source_ord", "ord", ["value", "period"], block=lambda c: F.floor(c / 8))


view("call_files", f"""
SELECT company_id, CAST((cm - 1) // 12 * 12 + (cm - 1) % 12 + 1 AS INT) AS at, ((cm - 1) // 12) || '_' || {MONTH_SQL}[(cm - 1) % 12 + 1] || '.json' AS file
FROM (SELECT 'C' || skey AS company_id, (fy - 1) * 12 + 3 + q * 3 + 1 + (skey + fy * 4 + q) % 5 AS cm FROM quarter_sums)""")


def call_files(spark, sf):
    """One call transcript per company and quarter, held one to five months after it ends."""
    q = V.quarter_sums(spark, sf).select(F.concat(F.lit("C"), "skey").alias("company_id"), ((F.col("fy") - 1) * 12 + 3 + F.col("q") * 3 + 1 + (F.col("skey") + F.col("fy") * 4 + F.col("q")) % 5).cast("int").alias("at"))
    year = F.floor((F.col("at") - 1) / 12)
    return q.withColumn("file", F.concat(year.cast("string"), F.lit("_"), P.month_name((F.col("at") - 1) % 12 + 1), F.lit(".json")))


@query("j7_nearest", """
SELECT q.company_id, q.period, q.lo, q.hi, min_by(f.file, abs(f.at - (q.lo + q.hi) / 2.0) * 1000000 + f.at) AS file
FROM (SELECT 'C' || skey AS company_id, 'Q' || q || ' FY' || lpad(CAST(fy % 100 AS VARCHAR), 2, '0') AS period, CAST((fy - 1) * 12 + 4 + q * 3 - 1 AS INT) AS lo,
  CAST((fy - 1) * 12 + 4 + q * 3 + CASE q WHEN 1 THEN 2 ELSE 3 END + 1 AS INT) AS hi FROM quarter_sums) q
LEFT JOIN call_files f ON f.company_id = q.company_id AND f.at BETWEEN q.lo AND q.hi GROUP BY 1, 2, 3, 4""")
def _(spark, sf):
    """Transcript nearest the middle of each quarter's call window, widened by a month."""
    start = (F.col("fy") - 1) * 12 + 4 + F.col("q") * 3
    quarters = V.quarter_sums(spark, sf).select(
        F.concat(F.lit("C"), "skey").alias("company_id"), P.quarter_label(F.col("fy"), F.col("q")).alias("period"),
        (start - 1).cast("int").alias("lo"), (start + F.when(F.col("q") == 1, 2).otherwise(3) + 1).cast("int").alias("hi"))
    return J.nearest_in_window(quarters, call_files(spark, sf), ["company_id"], "lo", "hi", "at", "file")


@query("j13_source_resolve", """
SELECT c.company_id, c.document, coalesce(f.file, CASE WHEN c.document = 'sector.pdf' THEN 'sector.pdf' END) AS file,
  CASE WHEN f.file IS NOT NULL THEN 'company_suffix' WHEN c.document = 'sector.pdf' THEN 'exact' ELSE 'none' END AS rule
FROM (SELECT DISTINCT company_id, source_document AS document FROM claims UNION SELECT DISTINCT company_id, 'sector.pdf' FROM claims UNION SELECT DISTINCT company_id, source_document FROM risk_flags) c
LEFT JOIN (SELECT DISTINCT company_id, lower(company_id) || '_calls_' || source_document AS file, source_document AS doc FROM claims) f ON f.company_id = c.company_id AND f.doc = c.document""")
def _(spark, sf):
    cl = V.claims(spark, sf).select("company_id", F.col("source_document").alias("document")).distinct()
    sector = cl.select("company_id", F.lit("sector.pdf").alias("document")).distinct()
    risk = V.risk_flags(spark, sf).select("company_id", F.col("source_document").alias("document")).distinct()
    files = cl.select(F.concat_ws("_", F.lower("company_id"), F.lit("calls"), "document").alias("file"))
    files = files.unionByName(spark.createDataFrame([("sector.pdf",)], "file string"))
    return J.resolve_sources(cl.unionByName(sector).unionByName(risk), files)


# ---- series and windows ----------------------------------------------------------
@query("a6_series_stats", """
SELECT company_id, metric, count(*) AS n, min(value) AS min_value, max(value) AS max_value, avg(value) AS avg_value, min_by(value, ord) AS start_value, max_by(value, ord) AS end_value,
  CASE WHEN min_by(value, ord) <> 0 THEN (max_by(value, ord) - min_by(value, ord)) / abs(min_by(value, ord)) * 100 END AS total_change_pct
FROM financials WHERE period_type = 'annual' GROUP BY 1, 2""", rounds="avg_value total_change_pct", digits=4)
def _(spark, sf):
    return A.series_stats(annual(spark, sf), ["company_id", "metric"]).drop("cagr_pct")


@query("a7_cagr", """
SELECT company_id, metric, n, CASE WHEN n > 1 AND s > 0 AND e > 0 THEN (pow(e / s, 1.0::DOUBLE / (n - 1)) - 1) * 100 END AS cagr_pct
FROM (SELECT company_id, metric, count(*) AS n, min_by(value, ord) AS s, max_by(value, ord) AS e FROM financials WHERE period_type = 'annual' GROUP BY 1, 2)""", rounds="cagr_pct")
def _(spark, sf):
    return A.series_stats(annual(spark, sf), ["company_id", "metric"]).select("company_id", "metric", "n", "cagr_pct")


@query("a18_catalogue", """
SELECT company_id, period_type, count(DISTINCT metric) AS n_metrics, count(DISTINCT period) AS n_periods, count(*) AS n_cells, array_to_string(list_sort(list(DISTINCT metric)), ',') AS metric_names
FROM financials GROUP BY 1, 2""")
def _(spark, sf):
    return A.catalogue(V.financials(spark, sf), ["company_id", "period_type"])


view("market_revenue", """
SELECT 'C' || l_suppkey AS company_id, c_mktsegment AS market, CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS DOUBLE) AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""")


def market_revenue(spark, sf):
    """Revenue per (company, market): lines joined to orders, then to customers."""
    li = V.table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)").alias("rev"))
    per_order = li.groupBy("l_orderkey", "l_suppkey").agg(F.sum("rev").alias("rev"))
    o = V.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    c = V.table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("market"))
    j = per_order.join(o, per_order.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey)
    return j.groupBy(F.concat(F.lit("C"), "l_suppkey").alias("company_id"), "market").agg(F.sum("rev").cast("double").alias("revenue"))


@query("a17_concentration", """
SELECT company_id, market, revenue, revenue / sum(revenue) OVER (PARTITION BY company_id) * 100 AS share_pct, coalesce(new_supply, 0) AS new_supply,
  revenue / sum(revenue) OVER (PARTITION BY company_id) * 100 >= 22 AND coalesce(new_supply, 0) > 0 AS exposed
FROM market_revenue LEFT JOIN (SELECT c_mktsegment AS market, count(*) AS new_supply FROM customer WHERE c_acctbal < 0 GROUP BY 1) USING (market)""", rounds="share_pct")
def _(spark, sf):
    supply = V.table(spark, sf, "customer").filter("c_acctbal < 0").groupBy(F.col("c_mktsegment").alias("market")).agg(F.count("*").alias("new_supply"))
    return A.concentration(market_revenue(spark, sf), supply, 22.0)


@query("a10_jaccard", """
SELECT p.kind, a.company_id AS left_id, b.company_id AS right_id, len(list_intersect(a.m, coalesce(b.m, []))) AS shared, len(a.m) - len(list_intersect(a.m, b.m)) AS only_left, len(b.m) - len(list_intersect(a.m, b.m)) AS only_right,
  100.0::DOUBLE * len(list_intersect(a.m, b.m)) / (len(a.m) + len(b.m) - len(list_intersect(a.m, b.m))) AS jaccard_pct
FROM (SELECT kind, company_id, skey, list(DISTINCT member) AS m FROM (SELECT company_id, skey, 'risk' AS kind, category AS member FROM risk_flags UNION ALL SELECT company_id, skey, 'hedge', confidence_language || fy FROM claims) GROUP BY ALL) a
JOIN (SELECT DISTINCT kind FROM (VALUES ('risk'), ('hedge')) t(kind)) p ON p.kind = a.kind
JOIN (SELECT kind, company_id, skey, list(DISTINCT member) AS m FROM (SELECT company_id, skey, 'risk' AS kind, category AS member FROM risk_flags UNION ALL SELECT company_id, skey, 'hedge', confidence_language || fy FROM claims) GROUP BY ALL) b
  ON b.kind = a.kind AND b.skey = a.skey + 1""", rounds="jaccard_pct")
def _(spark, sf):
    """Overlap of each company with the next one, by kind of member."""
    r = V.risk_flags(spark, sf).select("company_id", F.lit("risk").alias("kind"), F.col("category").alias("member"))
    c = V.claims(spark, sf).select("company_id", F.lit("hedge").alias("kind"), F.concat("confidence_language", "fy").alias("member"))
    comp = V.companies(spark, sf)
    req = comp.select(F.col("company_id").alias("left_id"), F.concat(F.lit("C"), F.col("skey") + 1).alias("right_id"))
    out = A.set_overlap(r.unionByName(c), req, "company_id", "member", ["kind"])
    return out.filter(F.col("shared") + F.col("only_right") > 0)


view("bought", """
SELECT o_custkey % 5 AS grp, o_custkey AS customer, l_partkey % 12 AS member FROM orders JOIN lineitem ON l_orderkey = o_orderkey""")
view("bought_sets", "SELECT grp, customer, list_sort(list(DISTINCT member)) AS m FROM bought GROUP BY 1, 2")
view("bought_classes", "SELECT grp, m, min(customer) AS rep, count(*) AS n FROM bought_sets GROUP BY 1, 2")


@query("a10_all_pairs", """
SELECT grp, left_id, right_id, shared, only_left, only_right, 100.0 * shared / (shared + only_left + only_right) AS jaccard_pct, n_left, n_right FROM (
  SELECT a.grp, a.rep AS left_id, b.rep AS right_id, len(list_intersect(a.m, b.m)) AS shared, len(a.m) - len(list_intersect(a.m, b.m)) AS only_left, len(b.m) - len(list_intersect(a.m, b.m)) AS only_right, a.n AS n_left, b.n AS n_right
  FROM bought_classes a JOIN bought_classes b ON a.grp = b.grp AND a.rep < b.rep)
WHERE 100 * shared >= 80 * (shared + only_left + only_right)""", rounds="jaccard_pct")
def _(spark, sf):
    """All pairs of customers' sets of bought kinds that overlap by 80 percent, by group:
    pairs of classes of equal sets, with how many customers each class has."""
    li = V.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_partkey") % 12).alias("member"))
    b = V.table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("customer"), (F.col("o_custkey") % 5).alias("grp")).join(li, "o_orderkey")
    pairs, held = A.similar_sets(b, "customer", "member", ["grp"], 80)
    n = held.groupBy("grp", "rep").agg(F.count("*").alias("n"))
    side = lambda s: n.select("grp", F.col("rep").alias(f"{s}_id"), F.col("n").alias(f"n_{s}"))
    return pairs.join(side("left"), ["grp", "left_id"]).join(side("right"), ["grp", "right_id"])


@query("w1_latest_prev", "SELECT company_id, revenue, revenue_prev, opm, opm_prev, net_profit, net_profit_prev FROM latest_prev")
def _(spark, sf):
    return O.latest_prev_wide(annual(spark, sf, ["revenue", "opm", "net_profit"]), ["revenue", "opm", "net_profit"])


@query("w4_avg_rank", """
SELECT company_id, avg(r) AS mean_rank, count(*) AS n_kpis FROM (
  SELECT company_id, metric, rank() OVER (PARTITION BY metric ORDER BY CASE WHEN metric = 'borrowings' THEN -v ELSE v END DESC) + (count(*) OVER (PARTITION BY metric, v) - 1) / 2.0::DOUBLE AS r
  FROM (SELECT company_id, metric, max_by(value, ord) AS v FROM financials WHERE period_type = 'annual' AND metric IN ('revenue', 'opm', 'icr', 'borrowings') GROUP BY 1, 2)) GROUP BY 1""", rounds="mean_rank")
def _(spark, sf):
    latest = annual(spark, sf, ["revenue", "opm", "icr", "borrowings"]).groupBy("company_id", "metric").agg(F.max_by("value", "ord").alias("v"))
    r = A.average_rank(latest, "metric", "v", ["borrowings"])
    return r.groupBy("company_id").agg(F.avg("avg_rank").alias("mean_rank"), F.count("avg_rank").alias("n_kpis"))


@query("w5_growth", """
SELECT company_id, metric, period, CASE WHEN lag(value, 1) OVER w <> 0 THEN (value - lag(value, 1) OVER w) / lag(value, 1) OVER w * 100 END AS qoq_pct,
  CASE WHEN lag(value, 4) OVER w <> 0 THEN (value - lag(value, 4) OVER w) / abs(lag(value, 4) OVER w) * 100 END AS yoy_abs_pct
FROM financials WHERE period_type = 'quarterly' AND metric IN ('revenue', 'net_profit') WINDOW w AS (PARTITION BY company_id, metric ORDER BY ord)""", rounds="qoq_pct yoy_abs_pct")
def _(spark, sf):
    q = V.financials(spark, sf, ["revenue", "net_profit"]).filter("period_type = 'quarterly'")
    keys = ["company_id", "metric"]
    g = O.growth(O.growth(q, keys, "ord", out="qoq_pct"), keys, "ord", periods=4, base="abs", out="yoy_abs_pct")
    return g.select("company_id", "metric", "period", "qoq_pct", "yoy_abs_pct")


@query("w6_last_n", "SELECT company_id, metric, period, value, row_number() OVER (PARTITION BY company_id, metric ORDER BY ord DESC)::INT AS rn FROM financials WHERE period_type = 'quarterly' AND metric = 'opm' QUALIFY rn <= 5")
def _(spark, sf):
    q = V.financials(spark, sf, ["opm"]).filter("period_type = 'quarterly'")
    return O.last_n(q, ["company_id", "metric"], "ord", 5).select("company_id", "metric", "period", "value", "rn")


@query("w7_ttm", "SELECT company_id, metric, period, CASE WHEN count(value) OVER w = 4 THEN sum(value) OVER w END AS ttm FROM financials WHERE period_type = 'quarterly' AND metric IN ('revenue', 'net_profit') WINDOW w AS (PARTITION BY company_id, metric ORDER BY ord ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)", rounds="ttm")
def _(spark, sf):
    q = V.financials(spark, sf, ["revenue", "net_profit"]).filter("period_type = 'quarterly'")
    return O.trailing_sum(q, ["company_id", "metric"], "ord").select("company_id", "metric", "period", "ttm")


@query("w11_direction", "SELECT company_id, metric, period, CASE WHEN lag(value, 2) OVER w IS NULL THEN NULL WHEN value > lag(value, 2) OVER w THEN 'improving' ELSE 'declining' END AS direction FROM financials WHERE period_type = 'quarterly' AND metric = 'opm' WINDOW w AS (PARTITION BY company_id, metric ORDER BY ord)")
def _(spark, sf):
    q = V.financials(spark, sf, ["opm"]).filter("period_type = 'quarterly'")
    back = F.lag("value", 2).over(Window.partitionBy("company_id", "metric").orderBy("ord"))
    return q.select("company_id", "metric", "period", F.when(back.isNull(), None).when(F.col("value") > back, "improving").otherwise("declining").alias("direction"))


@query("w12_minmax", "SELECT company_id, metric, period, CASE WHEN max(value) OVER w <> min(value) OVER w THEN (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) ELSE 0.0 END AS scaled FROM financials WHERE period_type = 'annual' AND metric IN ('revenue', 'opm', 'revpar') WINDOW w AS (PARTITION BY metric, period)", rounds="scaled")
def _(spark, sf):
    """Each comparison column scaled to 0..1; extremes aggregate map-side first."""
    return O.min_max_scale(annual(spark, sf, ["revenue", "opm", "revpar"]), ["metric", "period"]).select("company_id", "metric", "period", "scaled")


@query("w13_trend_delta", """
SELECT company_id, max_by(hit, period_ord) - min_by(hit, period_ord) AS delta, array_to_string(list_slice(list(period ORDER BY period_ord), -4, -1), ',') AS last_periods
FROM (SELECT company_id, period, period_ord, 100.0::DOUBLE * count(*) FILTER (WHERE flag <> 'MISS') / count(*) AS hit FROM deviations GROUP BY 1, 2, 3) GROUP BY 1""", rounds="delta")
def _(spark, sf):
    per = deviations(spark, sf).groupBy("company_id", "period", "period_ord").agg((100 * F.avg((F.col("flag") != "MISS").cast("double"))).alias("hit"))
    names = F.transform(F.sort_array(F.collect_list(F.struct("period_ord", "period"))), lambda x: x["period"])
    g = per.groupBy("company_id").agg((F.max_by("hit", "period_ord") - F.min_by("hit", "period_ord")).alias("delta"), names.alias("p"))
    return g.select("company_id", "delta", F.array_join(F.slice("p", F.greatest(F.size("p") - 3, F.lit(1)), 4), ",").alias("last_periods"))


@query("k1_order_limit", "SELECT company_id, metric, period, value FROM financials WHERE period_type = 'annual' AND metric = 'revenue' ORDER BY ord DESC, value DESC, company_id LIMIT 50")
def _(spark, sf):
    """Newest, largest first with a tie key; the cap is the report itself."""
    return annual(spark, sf, ["revenue"]).orderBy(F.desc("ord"), F.desc("value"), "company_id").limit(50).select("company_id", "metric", "period", "value")


@query("k5_footnotes", """
SELECT company_id, row_number() OVER (PARTITION BY company_id ORDER BY kind, ref)::INT AS note, kind, ref FROM (
  SELECT company_id, 1 AS kind, source_actual || ' ' || claim_id AS ref FROM deviations WHERE flag = 'MISS' UNION ALL SELECT company_id, 2, category || ' ' || event_id FROM risk_flags)""")
def _(spark, sf):
    """Running footnote number per company, deviations first; numbered block by block."""
    d = deviations(spark, sf).filter("flag = 'MISS'").select("company_id", F.lit(1).alias("kind"), F.concat_ws(" ", "source_actual", "claim_id").alias("ref"))
    r = V.risk_flags(spark, sf).select("company_id", F.lit(2).alias("kind"), F.concat_ws(" ", "category", F.col("event_id").cast("string")).alias("ref"))
    n = O.blocked_running(d.unionByName(r).withColumn("blk", F.substring("ref", 1, 4)), ["company_id"], ["kind", "blk"], ["ref"], {"before": F.lit(1)}, totals=False)
    return n.select("company_id", (F.col("before") + 1).cast("int").alias("note"), "kind", "ref")


@query("u2_set_ops", """
SELECT op, count(*) AS n FROM (
  (SELECT 'intersect' AS op, company_id FROM claims INTERSECT SELECT 'intersect', company_id FROM risk_flags)
  UNION ALL (SELECT 'only_claims', company_id FROM claims EXCEPT SELECT 'only_claims', company_id FROM risk_flags)
  UNION ALL (SELECT 'only_flags', company_id FROM risk_flags EXCEPT SELECT 'only_flags', company_id FROM chunk_owners)
  UNION ALL (SELECT 'union', company_id FROM claims UNION SELECT 'union', company_id FROM chunk_owners)) GROUP BY 1""")
def _(spark, sf):
    from .q_scoring import chunk_owners

    a, b = V.claims(spark, sf).select("company_id"), V.risk_flags(spark, sf).select("company_id")
    c = chunk_owners(spark, sf).select("company_id")
    tag = lambda df, t: df.select(F.lit(t).alias("op"))
    parts = [tag(a.intersect(b), "intersect"), tag(a.subtract(b), "only_claims"), tag(b.subtract(c), "only_flags"), tag(a.union(c).distinct(), "union")]
    return V.union_all(parts).groupBy("op").agg(F.count("*").alias("n"))


# ---- company views -----------------------------------------------------------------
@query("j15_compare_view", """
SELECT c.company_id, c.segment, l.revenue, l.opm, l.net_profit, CASE WHEN l.interest > 0 THEN l.operating_profit / l.interest END AS coverage, r.overall_score
FROM companies c LEFT JOIN latest_prev l USING (company_id) LEFT JOIN cred r USING (company_id)""", rounds="overall_score")
def _(spark, sf):
    from ..plans import scoring as S

    m = ["revenue", "opm", "net_profit", "operating_profit", "interest"]
    l = O.latest_prev_wide(annual(spark, sf, m), m)
    j = V.companies(spark, sf).join(l, "company_id", "left").join(S.credibility(deviations(spark, sf)).select("company_id", "overall_score"), "company_id", "left")
    return j.select("company_id", "segment", "revenue", "opm", "net_profit", F.when(F.col("interest") > 0, F.col("operating_profit") / F.col("interest")).alias("coverage"), "overall_score")


@query("j16_entity_doc", """
SELECT c.company_id, coalesce(m.doc, '') AS metrics, coalesce(d.doc, '') AS deviations, coalesce(r.doc, '') AS risks, coalesce(k.n_claims, 0) AS n_claims, coalesce(q.n_quarters, 0) AS n_quarters
FROM companies c
LEFT JOIN (SELECT company_id, string_agg(metric || '@' || period, ',' ORDER BY metric) AS doc FROM (SELECT company_id, metric, max_by(period, ord) AS period FROM financials WHERE period_type = 'annual' GROUP BY 1, 2) GROUP BY 1) m USING (company_id)
LEFT JOIN (SELECT company_id, string_agg(period || ':' || metric_type || ':' || flag, ',' ORDER BY period_ord, metric_type) AS doc FROM deviations GROUP BY 1) d USING (company_id)
LEFT JOIN (SELECT company_id, string_agg(severity || ':' || category, ',' ORDER BY severity, category) AS doc FROM risk_flags GROUP BY 1) r USING (company_id)
LEFT JOIN (SELECT company_id, count(*) AS n_claims FROM claims GROUP BY 1) k USING (company_id)
LEFT JOIN (SELECT company_id, count(DISTINCT period) AS n_quarters FROM financials WHERE period_type = 'quarterly' GROUP BY 1) q USING (company_id)""")
def _(spark, sf):
    """One nested document per company; every table is grouped once on the company key."""
    join = lambda c: F.array_join(c, ",")
    fin = V.financials(spark, sf)
    m = fin.filter("period_type = 'annual'").groupBy("company_id", "metric").agg(F.max_by("period", "ord").alias("period"))
    m = m.groupBy("company_id").agg(join(F.sort_array(F.collect_list(F.concat_ws("@", "metric", "period")))).alias("metrics"))
    d = deviations(spark, sf).groupBy("company_id").agg(F.sort_array(F.collect_list(F.struct("period_ord", "metric_type", "period", "flag"))).alias("x"))
    d = d.select("company_id", join(F.transform("x", lambda x: F.concat_ws(":", x["period"], x["metric_type"], x["flag"]))).alias("deviations"))
    r = V.risk_flags(spark, sf).groupBy("company_id").agg(join(F.sort_array(F.collect_list(F.concat_ws(":", "severity", "category")))).alias("risks"))
    k = V.claims(spark, sf).groupBy("company_id").agg(F.count("*").alias("n_claims"))
    q = fin.filter("period_type = 'quarterly'").groupBy("company_id").agg(F.count_distinct("period").alias("n_quarters"))
    out = V.companies(spark, sf).select("company_id")
    for t in (m, d, r, k, q):
        out = out.join(t, "company_id", "left")
    return out.na.fill("", ["metrics", "deviations", "risks"]).na.fill(0, ["n_claims", "n_quarters"])
