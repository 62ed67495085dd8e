"""Analyst tools as DataFrame functions: enrichment, health, DuPont, benchmark, trends, checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordered import last_n
from ..operators.stats import average_rank, series_stats

# Standard definitions over one statement row. The names come from the tool
# catalogue; the formulas are inferred from common usage, not from a source.
RATIOS = {
    "ebitda": "operating_profit",
    "ebit": "operating_profit - depreciation",
    "ebitda_margin": "100 * operating_profit / nullif(revenue, 0)",
    "net_profit_margin": "100 * net_profit / nullif(revenue, 0)",
    "interest_coverage": "operating_profit / nullif(interest, 0)",
    "cost_to_income": "expenses / nullif(revenue, 0)",
    "depreciation_to_sales": "100 * depreciation / nullif(revenue, 0)",
    "interest_to_sales": "100 * interest / nullif(revenue, 0)",
    "profit_before_tax": "operating_profit - interest - depreciation",
    "effective_tax_rate": "100 * (operating_profit - interest - depreciation - net_profit) / nullif(operating_profit - interest - depreciation, 0)",
    "core_net_profit": "net_profit - other_income",
    "net_worth": "equity",
    "debt_to_equity": "borrowings / nullif(equity, 0)",
    "total_debt_ratio": "borrowings / nullif(total_assets, 0)",
    "equity_multiplier": "total_assets / nullif(equity, 0)",
    "fixed_assets_to_total": "100 * fixed_assets / nullif(total_assets, 0)",
    "cwip_to_fixed_assets": "100 * cwip / nullif(fixed_assets, 0)",
    "net_fixed_assets": "fixed_assets - cwip",
    "investments_to_total": "100 * investments / nullif(total_assets, 0)",
    "working_capital_proxy": "total_assets - fixed_assets - borrowings",
    "book_value_per_share": "equity / nullif(shares, 0)",
    "roe": "100 * net_profit / nullif(equity, 0)",
    "roa": "100 * net_profit / nullif(total_assets, 0)",
    "roce": "100 * (operating_profit - depreciation) / nullif(equity + borrowings, 0)",
    "asset_turnover": "revenue / nullif(total_assets, 0)",
    "fixed_asset_turnover": "revenue / nullif(fixed_assets, 0)",
    "dupont_net_margin": "100 * net_profit / nullif(revenue, 0)",
    "dupont_asset_turnover": "revenue / nullif(total_assets, 0)",
    "dupont_equity_multiplier": "total_assets / nullif(equity, 0)",
    "financial_leverage": "total_assets / nullif(equity, 0)",
}
GROWTHS = {
    "yoy_sales": "revenue", "yoy_net_profit": "net_profit", "yoy_operating_profit": "operating_profit",
    "yoy_assets": "total_assets", "yoy_debt": "borrowings", "yoy_net_worth": "equity",
}


def enrich(wide: DataFrame, keys: Sequence[str] = ("company_id",), order: str = "ord", year_lag: int = 1, quarterly: bool = False) -> DataFrame:
    """All named ratios and growths per statement row; quarterly rows add QoQ and trailing sums.

    Growth and trailing sums share one window, so the whole enrichment costs one
    sort per series.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    grow = lambda c, n: F.when(F.lag(c, n).over(w) != 0, (F.col(c) - F.lag(c, n).over(w)) / F.abs(F.lag(c, n).over(w)) * 100)
    lag = 4 if quarterly else year_lag
    cols = {k: F.expr(v) for k, v in RATIOS.items()} | {k: grow(c, lag) for k, c in GROWTHS.items()}
    if quarterly:
        last4 = w.rowsBetween(-3, 0)
        for name in ("sales", "net_profit", "operating_profit"):
            cols[f"qoq_{name}"] = grow("revenue" if name == "sales" else name, 1)
        for name, c in (("sales", "revenue"), ("net_profit", "net_profit")):
            cols[f"trailing_4q_{name}"] = F.when(F.count(c).over(last4) == 4, F.sum(c).over(last4))
    return wide.withColumns(cols)


def linear_score(v: Column, low: float, high: float, higher_is_better: bool = True) -> Column:
    """10 to 95 between the bounds, 50 when the value is missing."""
    span = (v - low) / (high - low) * 85
    if higher_is_better:
        return F.when(v.isNull(), 50.0).when(v <= low, 10.0).when(v >= high, 95.0).otherwise(10 + span)
    return F.when(v.isNull(), 50.0).when(v >= high, 10.0).when(v <= low, 95.0).otherwise(95 - span)


# Fixed bounds per health dimension: (metric, low, high, higher is better).
HEALTH = {
    "profitability": [("ebitda_margin", 15, 45, True), ("net_profit_margin", 5, 25, True), ("roe", 5, 20, True)],
    "leverage": [("debt_to_equity", 0.2, 2.0, False), ("interest_coverage", 1.5, 6.0, True)],
    "efficiency": [("cost_to_income", 0.45, 0.85, False), ("asset_turnover", 0.1, 0.6, True)],
    "growth": [("yoy_sales", 0, 40, True), ("yoy_net_profit", 0, 60, True)],
    "returns": [("roe", 5, 20, True), ("roce", 8, 25, True)],
    "coverage": [("interest_coverage", 1.5, 8.0, True)],
}


def health_score(enriched: DataFrame) -> DataFrame:
    """Six dimension scores, overall score and grade for the latest common period.

    The period is the newest one with both a profit and a balance-sheet figure, else
    the newest with a profit figure.
    """
    need = sorted({m for ms in HEALTH.values() for m, *_ in ms})
    row = F.struct("period", *need)
    both = F.col("revenue").isNotNull() & F.col("total_assets").isNotNull()
    rank = F.struct(F.when(both, 1).otherwise(0), F.col("ord"))
    d = enriched.filter("revenue is not null").groupBy("company_id").agg(F.max_by(row, rank).alias("r")).select("company_id", "r.*")
    dims = {k: sum((linear_score(F.col(m), lo, hi, up) for m, lo, hi, up in ms), F.lit(0.0)) / len(ms) for k, ms in HEALTH.items()}
    d = d.withColumns(dims)
    d = d.withColumn("overall", sum((F.col(k) for k in HEALTH), F.lit(0.0)) / len(HEALTH))
    o = F.col("overall")
    grade = F.when(o >= 80, "Excellent").when(o >= 65, "Good").when(o >= 50, "Average").when(o >= 35, "Below Average").otherwise("Poor")
    return d.select("company_id", "period", *HEALTH, "overall", grade.alias("grade"))


def dupont(enriched: DataFrame) -> DataFrame:
    """Return on equity as margin x turnover x multiplier, with the product as a check."""
    product = F.col("dupont_net_margin") * F.col("dupont_asset_turnover") * F.col("dupont_equity_multiplier")
    return enriched.select("company_id", "period", "roe", "roa", "roce", "dupont_net_margin", "dupont_asset_turnover", "dupont_equity_multiplier", product.alias("verification"))


def benchmark(facts: DataFrame, metrics: Sequence[str], period: str, lower_is_better: Sequence[str] = ()) -> DataFrame:
    """Metric matrix at ``period`` (newest value where absent), average-tie ranks and their mean."""
    f = facts.filter(F.col("metric").isin(list(metrics)))
    cell = f.groupBy("company_id", "metric").agg(F.coalesce(F.max(F.when(F.col("period") == period, F.col("value"))), F.max_by("value", "ord")).alias("value"))
    ranked = average_rank(cell, "metric", "value", lower_is_better)
    pick = lambda m, c: F.max(F.when(F.col("metric") == m, F.col(c)))
    return ranked.groupBy("company_id").agg(
        *[pick(m, "value").alias(m) for m in metrics], *[pick(m, "avg_rank").alias(f"{m}_rank") for m in metrics], F.avg("avg_rank").alias("overall_rank"))


def compare(facts: DataFrame, metric: str, last: int = 5) -> DataFrame:
    """One metric side by side over the newest ``last`` periods any company reported."""
    f = facts.filter((F.col("metric") == metric) & F.col("value").isNotNull())
    recent = f.select("ord").distinct().orderBy(F.desc("ord")).limit(last)
    return f.join(F.broadcast(recent), "ord").select("company_id", "period", "ord", "value")


def quarters(facts: DataFrame, metric: str, last: int = 8) -> DataFrame:
    """Last quarters of one metric per company: latest, changes, range and direction."""
    q = last_n(facts.filter((F.col("metric") == metric) & (F.col("period_type") == "quarterly")), ["company_id"], "ord", last)
    at = lambda i: F.max(F.when(F.col("rn") == i, F.col("value")))
    g = q.groupBy("company_id").agg(
        F.count("*").alias("n"), at(1).alias("latest"), at(2).alias("previous"), at(3).alias("two_back"), at(5).alias("year_back"),
        F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.avg("value").alias("avg_value"))
    pct = lambda b: F.when(F.col(b) != 0, (F.col("latest") - F.col(b)) / F.col(b) * 100)
    direction = F.when(F.col("two_back").isNull(), None).when(F.col("latest") > F.col("two_back"), "improving").otherwise("declining")
    return g.select("company_id", "n", "latest", "previous", pct("previous").alias("qoq_pct"), pct("year_back").alias("yoy_pct"), "min_value", "max_value", "avg_value", direction.alias("direction"))


def trend(facts: DataFrame, metric: str) -> DataFrame:
    """Multi-year series statistics of one metric without TTM columns and nulls."""
    f = facts.filter((F.col("metric") == metric) & (F.upper("period") != "TTM") & (F.col("period_type") == "annual"))
    return series_stats(f, ["company_id"])


def driver_decomposition(wide: DataFrame, claimed: DataFrame) -> DataFrame:
    """Growth of yield split into volume and rate by log shares; flags a wrong stated driver."""
    w = Window.partitionBy("company_id").orderBy("ord")
    lg = lambda c: F.ln(F.col(c) / F.lag(c, 1).over(w))
    d = wide.filter((F.col("occupancy") > 0) & (F.col("revpar") > 0)).withColumns({"g_volume": lg("occupancy"), "g_rate": lg("revpar")})
    d = d.filter("g_volume is not null").withColumn("g_total", F.col("g_volume") + F.col("g_rate"))
    driver = F.when(F.abs("g_volume") >= F.abs("g_rate"), "volume").otherwise("rate")
    d = d.select("company_id", "period", "g_total", F.when(F.abs("g_total") > 1e-12, F.col("g_volume") / F.col("g_total")).alias("volume_share"), driver.alias("driver"))
    j = d.join(claimed, ["company_id", "period"], "left")
    return j.withColumn("mismatch", F.coalesce(F.col("claimed_driver") != F.col("driver"), F.lit(False)))


def mix_warning(shares: DataFrame, margins: DataFrame, years: int = 2) -> DataFrame:
    """Share of a mix rising for ``years`` years while the margin falls, with slope and correlation."""
    j = shares.join(margins, ["company_id", "fy"])
    w = Window.partitionBy("company_id").orderBy("fy")
    streak = F.lit(True)
    for i in range(years):
        streak = streak & (F.lag("share", i).over(w) > F.lag("share", i + 1).over(w)) & (F.lag("margin", i).over(w) < F.lag("margin", i + 1).over(w))
    j = j.withColumn("hit", F.coalesce(streak, F.lit(False)))
    return j.groupBy("company_id").agg(
        F.count("*").alias("n"), F.count_if("hit").alias("warnings"), F.regr_slope("margin", "share").alias("slope"), F.corr("margin", "share").alias("correlation"))


def coverage_flag(wide: DataFrame, claims: DataFrame, floor: float = 2.0) -> DataFrame:
    """Interest cover below ``floor``, and whether management had guided above it."""
    low = wide.filter(F.col("icr") < floor).select("company_id", "fy", "period", "icr")
    g = claims.select("company_id", "fy", F.col("guided_value").alias("guided_icr"))
    return low.join(g, ["company_id", "fy"], "left").select("company_id", "period", "icr", "guided_icr", F.coalesce(F.col("guided_icr") >= floor, F.lit(False)).alias("claim_mismatch"))
