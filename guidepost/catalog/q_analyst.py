"""Analyst tool queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import analyst as A
from ..plans.scoring import guided_value
from . import views as V
from .q_scoring import annual
from .registry import query, view

_EXTRA = {
    "depreciation": "interest / 2", "other_income": "revenue / 50", "fixed_assets": "borrowings * 3 / 4", "cwip": "borrowings / 8",
    "investments": "equity / 5", "shares": "skey + 10",
}


def statement_rows(spark, sf, kind):
    """Wide statement rows; balance sheets of odd companies end a year earlier."""
    w = V.facts_wide(spark, sf).filter(F.col("period_type") == kind)
    w = w.withColumns({k: F.expr(v) for k, v in _EXTRA.items()})
    late = (F.col("fy") >= 2002) & (F.col("skey") % 2 == 1)
    return w.withColumns({c: F.when(~late, F.col(c)) for c in ("borrowings", "equity", "total_assets", "fixed_assets", "cwip", "investments")})


view("statement_rows", f"""
SELECT * REPLACE (CASE WHEN late THEN NULL ELSE borrowings END AS borrowings, CASE WHEN late THEN NULL ELSE equity END AS equity, CASE WHEN late THEN NULL ELSE total_assets END AS total_assets,
  CASE WHEN late THEN NULL ELSE fixed_assets END AS fixed_assets, CASE WHEN late THEN NULL ELSE cwip END AS cwip, CASE WHEN late THEN NULL ELSE investments END AS investments)
FROM (SELECT *, {', '.join(f'{v} AS {k}' for k, v in _EXTRA.items())}, fy >= 2002 AND skey % 2 = 1 AS late FROM facts_wide)""")


def _grow(c, n):
    return f"CASE WHEN lag({c}, {n}) OVER w <> 0 THEN ({c} - lag({c}, {n}) OVER w) / abs(lag({c}, {n}) OVER w) * 100 END"


_RAT = ", ".join(f"{v} AS {k}" for k, v in A.RATIOS.items())
view("enriched_annual", f"SELECT company_id, skey, fy, period, ord, revenue, total_assets, {_RAT}, {', '.join(f'{_grow(c, 1)} AS {k}' for k, c in A.GROWTHS.items())} FROM statement_rows WHERE period_type = 'annual' WINDOW w AS (PARTITION BY company_id ORDER BY ord)")
_NAMES = [*A.RATIOS, *A.GROWTHS]
_QN = ["yoy_sales", "qoq_sales", "qoq_net_profit", "qoq_operating_profit", "trailing_4q_sales", "trailing_4q_net_profit"]


@query("x20_enrich", f"SELECT company_id, period, {', '.join(_NAMES)} FROM enriched_annual", rounds=" ".join(_NAMES))
def _(spark, sf):
    return A.enrich(statement_rows(spark, sf, "annual")).select("company_id", "period", *_NAMES)


@query("x20b_enrich_quarterly", f"""
SELECT company_id, period, {_grow('revenue', 4)} AS yoy_sales, {_grow('revenue', 1)} AS qoq_sales, {_grow('net_profit', 1)} AS qoq_net_profit, {_grow('operating_profit', 1)} AS qoq_operating_profit,
  CASE WHEN count(revenue) OVER r = 4 THEN sum(revenue) OVER r END AS trailing_4q_sales, CASE WHEN count(net_profit) OVER r = 4 THEN sum(net_profit) OVER r END AS trailing_4q_net_profit
FROM statement_rows WHERE period_type = 'quarterly' WINDOW w AS (PARTITION BY company_id ORDER BY ord), r AS (PARTITION BY company_id ORDER BY ord ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)""", rounds=" ".join(_QN))
def _(spark, sf):
    return A.enrich(statement_rows(spark, sf, "quarterly"), quarterly=True).select("company_id", "period", *_QN)


def _lin(m, lo, hi, up):
    span = f"({m} - {lo}) / ({hi} - {lo})::DOUBLE * 85"
    if up:
        return f"CASE WHEN {m} IS NULL THEN 50 WHEN {m} <= {lo} THEN 10 WHEN {m} >= {hi} THEN 95 ELSE 10 + {span} END"
    return f"CASE WHEN {m} IS NULL THEN 50 WHEN {m} >= {hi} THEN 10 WHEN {m} <= {lo} THEN 95 ELSE 95 - {span} END"


_HD = ", ".join("(" + " + ".join(_lin(*m) for m in ms) + f") / {len(ms)}.0::DOUBLE AS {k}" for k, ms in A.HEALTH.items())


@query("x11_health", f"""
SELECT *, CASE WHEN overall >= 80 THEN 'Excellent' WHEN overall >= 65 THEN 'Good' WHEN overall >= 50 THEN 'Average' WHEN overall >= 35 THEN 'Below Average' ELSE 'Poor' END AS grade
FROM (SELECT *, ({' + '.join(A.HEALTH)}) / 6 AS overall FROM (SELECT company_id, period, {_HD} FROM enriched_annual QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY total_assets IS NOT NULL DESC, ord DESC) = 1))""", rounds=" ".join([*A.HEALTH, "overall"]))
def _(spark, sf):
    return A.health_score(A.enrich(statement_rows(spark, sf, "annual")))


_DP = ["roe", "roa", "roce", "dupont_net_margin", "dupont_asset_turnover", "dupont_equity_multiplier", "verification"]


@query("x12_dupont", "SELECT company_id, period, roe, roa, roce, dupont_net_margin, dupont_asset_turnover, dupont_equity_multiplier, dupont_net_margin * dupont_asset_turnover * dupont_equity_multiplier AS verification FROM enriched_annual", rounds=" ".join(_DP))
def _(spark, sf):
    return A.dupont(A.enrich(statement_rows(spark, sf, "annual")))


_BM = ["revenue", "opm", "icr", "borrowings"]


@query("x13_benchmark", f"""
WITH cell AS (SELECT company_id, metric, coalesce(max(value) FILTER (WHERE period = 'FY02'), max_by(value, ord)) AS value FROM financials WHERE period_type = 'annual' AND metric IN ('revenue', 'opm', 'icr', 'borrowings') GROUP BY 1, 2),
ranked AS (SELECT *, rank() OVER (PARTITION BY metric ORDER BY CASE WHEN metric = 'borrowings' THEN -value ELSE value END DESC) + (count(*) OVER (PARTITION BY metric, value) - 1) / 2.0::DOUBLE AS r FROM cell)
SELECT company_id, {', '.join(f"max(value) FILTER (WHERE metric = '{m}') AS {m}, max(r) FILTER (WHERE metric = '{m}') AS {m}_rank" for m in _BM)}, avg(r) AS overall_rank FROM ranked GROUP BY 1""", rounds="overall_rank")
def _(spark, sf):
    return A.benchmark(annual(spark, sf, _BM), _BM, "FY02", ["borrowings"])


@query("x14_compare", "SELECT company_id, period, ord, value FROM financials WHERE period_type = 'annual' AND metric = 'opm' AND ord IN (SELECT DISTINCT ord FROM financials WHERE period_type = 'annual' AND metric = 'opm' ORDER BY ord DESC LIMIT 5)")
def _(spark, sf):
    return A.compare(annual(spark, sf, ["opm"]), "opm")


@query("x21_quarters", """
SELECT company_id, count(*) AS n, max(value) FILTER (WHERE rn = 1) AS latest, max(value) FILTER (WHERE rn = 2) AS previous, (max(value) FILTER (WHERE rn = 1) - max(value) FILTER (WHERE rn = 2)) / max(value) FILTER (WHERE rn = 2) * 100 AS qoq_pct,
  (max(value) FILTER (WHERE rn = 1) - max(value) FILTER (WHERE rn = 5)) / max(value) FILTER (WHERE rn = 5) * 100 AS yoy_pct, min(value) AS min_value, max(value) AS max_value, avg(value) AS avg_value,
  CASE WHEN max(value) FILTER (WHERE rn = 3) IS NULL THEN NULL WHEN max(value) FILTER (WHERE rn = 1) > max(value) FILTER (WHERE rn = 3) THEN 'improving' ELSE 'declining' END AS direction
FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY ord DESC) AS rn FROM financials WHERE period_type = 'quarterly' AND metric = 'revenue') WHERE rn <= 8 GROUP BY 1""", rounds="qoq_pct yoy_pct avg_value", digits=4)
def _(spark, sf):
    return A.quarters(V.financials(spark, sf, ["revenue"]), "revenue")


@query("x22_trend", """
SELECT company_id, n, min_value, max_value, avg_value, start_value, end_value, (end_value - start_value) / abs(start_value) * 100 AS total_change_pct, CASE WHEN n > 1 AND start_value > 0 AND end_value > 0 THEN (pow(end_value / start_value, 1.0::DOUBLE / (n - 1)) - 1) * 100 END AS cagr_pct
FROM (SELECT company_id, count(*) AS n, min(value) AS min_value, max(value) AS max_value, avg(value) AS avg_value, min_by(value, ord) AS start_value, max_by(value, ord) AS end_value FROM financials WHERE period_type = 'annual' AND metric = 'net_profit' GROUP BY 1)""", rounds="avg_value total_change_pct cagr_pct", digits=4)
def _(spark, sf):
    return A.trend(V.financials(spark, sf, ["net_profit"]), "net_profit")


@query("x17_driver", """
WITH d AS (SELECT company_id, period, ln(occupancy / lag(occupancy) OVER w) AS gv, ln(revpar / lag(revpar) OVER w) AS gr FROM facts_wide WHERE period_type = 'annual' AND occupancy > 0 AND revpar > 0 WINDOW w AS (PARTITION BY company_id ORDER BY ord))
SELECT d.company_id, d.period, gv + gr AS g_total, CASE WHEN abs(gv + gr) > 1e-12 THEN gv / (gv + gr) END AS volume_share, CASE WHEN abs(gv) >= abs(gr) THEN 'volume' ELSE 'rate' END AS driver, c.claimed_driver,
  coalesce(c.claimed_driver <> CASE WHEN abs(gv) >= abs(gr) THEN 'volume' ELSE 'rate' END, false) AS mismatch
FROM d LEFT JOIN (SELECT company_id, 'FY' || lpad(CAST(fy % 100 AS VARCHAR), 2, '0') AS period, CASE WHEN confidence_language IN ('will', 'plan') THEN 'rate' ELSE 'volume' END AS claimed_driver FROM claims WHERE check_type = 'check_3_driver') c ON c.company_id = d.company_id AND c.period = d.period
WHERE gv IS NOT NULL""", rounds="g_total volume_share")
def _(spark, sf):
    from ..functions.periods import fy_label

    said = V.claims(spark, sf).filter("check_type = 'check_3_driver'").select("company_id", fy_label(F.col("fy")).alias("period"), F.when(F.col("confidence_language").isin("will", "plan"), "rate").otherwise("volume").alias("claimed_driver"))
    return A.driver_decomposition(V.facts_wide(spark, sf).filter("period_type = 'annual'"), said)


@query("x18_mix", """
WITH s AS (SELECT 'C' || l_suppkey AS company_id, CAST(year(l_shipdate) + CASE WHEN month(l_shipdate) >= 4 THEN 1 ELSE 0 END AS INT) AS fy,
  100.0::DOUBLE * CAST(sum(CASE WHEN p_type IN ('ECONOMY', 'STANDARD') THEN CAST(l_extendedprice AS DECIMAL(18,4)) ELSE 0 END) AS DOUBLE) / CAST(sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE) AS share FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
j AS (SELECT s.*, f.opm AS margin FROM s JOIN facts_wide f ON f.company_id = s.company_id AND f.fy = s.fy AND f.period_type = 'annual')
SELECT company_id, count(*) AS n, count(*) FILTER (WHERE hit) AS warnings, regr_slope(margin, share) AS slope, corr(margin, share) AS correlation FROM (
  SELECT *, coalesce(share > lag(share) OVER w AND margin < lag(margin) OVER w AND lag(share) OVER w > lag(share, 2) OVER w AND lag(margin) OVER w < lag(margin, 2) OVER w, false) AS hit FROM j WINDOW w AS (PARTITION BY company_id ORDER BY fy)) GROUP BY 1""", rounds="slope correlation")
def _(spark, sf):
    from ..functions.periods import fiscal_year

    li = V.table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", fiscal_year(F.col("l_shipdate")).alias("fy"), F.col("l_extendedprice").cast("decimal(18,4)").alias("price"))
    per_part = li.groupBy("l_partkey", "l_suppkey", "fy").agg(F.sum("price").alias("price"))
    p = V.table(spark, sf, "part").select("p_partkey", "p_type")
    j = per_part.join(p, per_part.l_partkey == p.p_partkey)
    some = F.sum(F.when(F.col("p_type").isin("ECONOMY", "STANDARD"), F.col("price")).otherwise(F.lit(0).cast("decimal(18,4)"))).cast("double")
    shares = j.groupBy(F.concat(F.lit("C"), "l_suppkey").alias("company_id"), "fy").agg((100 * some / F.sum("price").cast("double")).alias("share"))
    margins = V.facts_wide(spark, sf).filter("period_type = 'annual'").select("company_id", "fy", F.col("opm").alias("margin"))
    return A.mix_warning(shares, margins)


@query("x19_coverage", """
SELECT f.company_id, f.period, f.icr, c.guided AS guided_icr, coalesce(c.guided >= 2, false) AS claim_mismatch FROM (SELECT * FROM facts_wide WHERE period_type = 'annual' AND icr < 2) f
LEFT JOIN (SELECT company_id, fy, coalesce(guidance_point, (guidance_low + guidance_high) / 2) AS guided FROM claims WHERE metric_type = 'Interest Coverage') c ON c.company_id = f.company_id AND c.fy = f.fy""", rounds="icr guided_icr")
def _(spark, sf):
    c = V.claims(spark, sf).filter("metric_type = 'Interest Coverage'").withColumn("guided_value", guided_value())
    return A.coverage_flag(V.facts_wide(spark, sf).filter("period_type = 'annual'"), c)
