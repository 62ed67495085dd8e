"""Guided-versus-delivered scoring: deviations, credibility and scorecards.

Each function takes DataFrames holding all companies and returns one row per
claim or per company; nothing loops over companies.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import periods as P
from ..operators.ordered import blocked_running, global_rank, latest_prev_wide
from ..session import cut_lineage

# Fixed values of the scoring rules (thresholds, points, weights).
INLINE_PCT = 5.0
MISS_BANDS = (10.0, 20.0, 35.0)
BEAT_MINOR = 10.0
RISK_WEIGHTS = {"critical": 15, "high": 10, "medium": 5}
MANAGEMENT_WEIGHTS = {"critical": 10, "high": 6, "medium": 3}
CYCLICAL_WEIGHTS = {"critical": 8, "high": 5, "medium": 2}
FORWARD_WEIGHTS = {"critical": 1.0, "high": 0.6, "medium": 0.3}
MANAGEMENT_CATEGORIES = ["governance", "management_mismatch", "key_person"]
CYCLICAL_CATEGORIES = ["debt", "margin_compression", "supply_overhang", "operational"]
HARD_WORDS = ["will", "confident", "expect"]
DEMAND_SHOCKS = [("mild", 0.95, 0.50), ("base", 0.90, 0.35), ("severe", 0.80, 0.15)]
RATE_SHOCKS = [("mild", 1.05, 0.45), ("base", 1.15, 0.35), ("severe", 1.30, 0.20)]
DIMENSION_WEIGHTS = {
    "industry_position": 0.20,
    "financial_quality": 0.25,
    "management_credibility": 0.20,
    "risk_identification": 0.20,
    "stress_test_resilience": 0.15,
}
CHECKS = ["check_1_revpar", "check_2_keys", "check_3_driver", "check_4_fnb", "check_5_debt", "check_6_supply"]
METRIC_FAMILIES = [
    ("demand", ["revpar", "adr", "occupancy"]),
    ("expansion", ["room", "key", "properties", "expansion"]),
    ("balance_sheet", ["debt", "interest", "coverage", "capex"]),
    ("profitability", ["margin", "ebitda", "revenue", "pat", "profit"]),
]


def clamp(c: Column, lo=0.0, hi=100.0) -> Column:
    return F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), c))


def weight_of(col: Column, weights: Mapping[str, float], default) -> Column:
    expr = F.lit(default)
    for k, v in weights.items():
        expr = F.when(col == k, v).otherwise(expr)
    return expr


def guided_value(point="guidance_point", low="guidance_low", high="guidance_high") -> Column:
    return F.coalesce(F.col(point), (F.col(low) + F.col(high)) / 2)


def match_claims(claims: DataFrame, actuals: DataFrame, metric_map: DataFrame, compat_period: bool = False) -> DataFrame:
    """Join claims to the newest revision of the actual they point at.

    The right side is reduced with ``max_by`` (map-side combine) on the very keys
    of the join, so that exchange also serves the join. ``metric_map`` is a
    driver-built list of a few entries and is broadcast.
    """
    norm = lambda c: P.normalise_period(F.col(c), compat_period)
    newest = (
        actuals.join(F.broadcast(metric_map.select("metric")), "metric", "left_semi")
        .groupBy("company_id", "metric", norm("period").alias("pkey"))
        .agg(F.max_by(F.struct("value", "id", "source_document", "source_page", "period"), F.struct("created_at", "id")).alias("a"))
        .filter("a.value is not null")
    )
    left = (
        claims.withColumn("guided_value", guided_value())
        .filter("guided_value is not null")
        .join(F.broadcast(metric_map.select("metric_type", "metric")), "metric_type")
        .withColumn("pkey", norm("target_period"))
    )
    page = F.coalesce(F.col("source_timestamp"), F.concat(F.lit("p."), F.col("source_page").cast("string")), F.lit("p.?"))
    return left.join(newest, ["company_id", "metric", "pkey"]).select(
        "claim_id", F.col("a.id").alias("actual_id"), "company_id", "metric_type", "metric", "check_type", "confidence_language",
        F.col("pkey").alias("period"), P.period_key(F.col("pkey")).alias("period_ord"),
        "guided_value", F.col("a.value").alias("actual_value"),
        citation(F.col("source_document"), page, F.col("statement_quarter")).alias("source_guidance"),
        citation(F.col("a.source_document"), F.concat(F.lit("p."), F.coalesce(F.col("a.source_page").cast("string"), F.lit("?"))), F.col("a.period")).alias("source_actual"),
    )


def growth_actuals(actuals: DataFrame) -> DataFrame:
    """Actuals as percent growth against the previous period, under ``<metric>:growth``.

    Claims stated in growth percent must meet these and not the level metric.
    """
    w = Window.partitionBy("company_id", "metric", "period_type").orderBy("ord", "created_at")
    newest = actuals.groupBy("company_id", "metric", "period_type", "ord").agg(F.max_by(F.struct(*[c for c in actuals.columns if c not in ("company_id", "metric", "period_type", "ord")]), F.struct("created_at", "id")).alias("a"))
    flat = newest.select("company_id", "metric", "period_type", "ord", "a.*")
    prev = F.lag("value").over(w)
    g = flat.withColumn("value", F.when(prev != 0, (F.col("value") - prev) / F.abs(prev) * 100))
    return g.withColumn("metric", F.concat("metric", F.lit(":growth"))).select(*actuals.columns)


def basis_metrics(metric_map: DataFrame) -> DataFrame:
    """Metric map whose ``basis`` column sends growth claims to growth actuals."""
    return metric_map.withColumn("metric", F.when(F.col("basis") == "growth", F.concat("metric", F.lit(":growth"))).otherwise(F.col("metric")))


def citation(doc: Column, page: Column, period: Column) -> Column:
    return F.concat(F.lit("["), F.coalesce(doc, F.lit("")), F.lit(" | "), page, F.lit(" | "), F.coalesce(period, F.lit("")), F.lit("]"))


def flag_deviation(df: DataFrame, lower_is_better: Sequence[str] = (), inline_pct=INLINE_PCT, bands=MISS_BANDS) -> DataFrame:
    """Delta, percent delta, BEAT / MISS / IN-LINE and a severity per row.

    ``lower_is_better`` lists metrics whose sign is reversed for the verdict; the
    default (none) keeps the plain reading.
    """
    g, a = F.col("guided_value"), F.col("actual_value")
    zero = g == 0
    delta = F.when(zero, 0.0).otherwise(a - g)
    pct = F.when(zero, 0.0).otherwise((a - g) / F.abs(g) * 100)
    df = df.withColumn("delta", delta).withColumn("delta_pct", pct)
    verdict = F.col("delta_pct")
    if lower_is_better:
        verdict = F.when(F.col("metric").isin(list(lower_is_better)), -verdict).otherwise(verdict)
    size = F.abs(F.col("delta_pct"))
    flag = F.when(size <= inline_pct, "IN-LINE").when(verdict > 0, "BEAT").otherwise("MISS")
    low, mid, high = bands
    severity = (
        F.when(size <= inline_pct, "none")
        .when(verdict > 0, F.when(size < BEAT_MINOR, "none").otherwise("minor"))
        .when(size < low, "minor").when(size < mid, "moderate").when(size < high, "major").otherwise("critical")
    )
    return df.withColumn("flag", flag).withColumn("severity", severity)


def repeat_pattern(dev: DataFrame) -> DataFrame:
    """Text when the last up to three earlier outcomes of a metric all agree."""
    w = Window.partitionBy("company_id", "metric_type").orderBy("period_ord", "claim_id").rowsBetween(-3, -1)
    past = F.collect_list("flag").over(w)
    n, on = F.size(past), F.concat(F.lit(" on "), F.col("metric_type"))
    same = lambda f: (n >= 2) & F.forall(past, lambda x: x == f)
    return dev.withColumn(
        "pattern",
        F.when(same("MISS") & (n == 3), F.concat(F.lit("3rd consecutive MISS"), on))
        .when(same("MISS"), F.concat(n.cast("string"), F.lit(" consecutive MISSes"), on))
        .when(same("BEAT"), F.concat(n.cast("string"), F.lit(" consecutive BEATs"), on)),
    )


def delivery_profile(dev: DataFrame) -> DataFrame:
    """Every per-company count the credibility and truthfulness scores need.

    One blocked ordering of the deviations gives each row its position and its
    streak; one aggregate per (company, streak) and one per company follow, so both
    scores share a single pass. Unused columns are pruned by the optimiser.
    """
    # everything the counts test is reduced to small columns before the ordering
    slim = dev.select(
        "company_id", "period_ord", "claim_id", "check_type", "delta_pct", F.substring("claim_id", 1, 1).alias("blk"),
        (F.col("flag") != "MISS").alias("hit"), F.lower(F.trim("confidence_language")).isin(HARD_WORDS).alias("hard"),
        metric_family(F.col("metric_type")).alias("family"),
    )
    hit = F.col("hit")
    ordered = blocked_running(slim, ["company_id"], ["period_ord", "blk"], ["claim_id"], {"pos": F.lit(1), "island": hit})
    ordered = ordered.withColumn("late", F.col("pos") >= F.floor(F.col("pos_total") / 2))
    late, hard, dp = F.col("late"), F.col("hard"), F.col("delta_pct")
    sums = {
        "n": F.count("*"), "hits": F.count_if(hit), "sum_abs": F.sum(F.abs(dp)), "s1": F.sum(dp), "s2": F.sum(dp * dp),
        "first_n": F.count_if(~late), "first_hits": F.count_if(~late & hit), "second_hits": F.count_if(late & hit),
        "hard_n": F.count_if(hard), "hard_m": F.count_if(hard & ~hit),
    }
    for c in CHECKS:
        sums[f"n_{c}"] = F.count_if(F.col("check_type") == c)
        sums[f"h_{c}"] = F.count_if((F.col("check_type") == c) & hit)
    for f, _ in METRIC_FAMILIES:
        sums[f"n_{f}"] = F.count_if(F.col("family") == f)
        sums[f"m_{f}"] = F.count_if((F.col("family") == f) & ~hit)
    per = ordered.groupBy("company_id", "island").agg(F.count_if(~hit).alias("run"), *[e.alias(k) for k, e in sums.items()])
    return per.groupBy("company_id").agg(F.max("run").alias("consecutive_misses"), *[F.sum(k).alias(k) for k in sums])


def credibility(dev: DataFrame, variant: str = "code") -> DataFrame:
    """Credibility row per company from its deviations.

    ``variant='code'`` is the weighted hit-rate form; ``variant='document'`` uses
    the spread of deviations for consistency and the driver check for honesty.
    """
    return credibility_columns(delivery_profile(dev), variant).select(
        "company_id", "overall_score", *[f"{c}_score" for c in CHECKS],
        "hit_rate", "avg_deviation", F.col("n").alias("total_matched"), "consecutive_misses", "trend",
    )


def credibility_columns(agg: DataFrame, variant: str = "code") -> DataFrame:
    agg = agg.withColumns({"hit_rate": 100 * F.col("hits") / F.col("n"), "avg_deviation": F.col("sum_abs") / F.col("n")})
    agg = agg.withColumns({f"{c}_score": F.when(F.col(f"n_{c}") > 0, 100 * F.col(f"h_{c}") / F.col(f"n_{c}")) for c in CHECKS})
    pattern_points = F.when(F.col("consecutive_misses") >= 3, 0.0).otherwise(20.0)
    if variant == "code":
        score = (
            F.col("hit_rate") * 0.35
            + F.greatest(F.lit(0.0), 100 - F.col("avg_deviation")) * 0.25
            + F.greatest(F.lit(0.0), 100 - F.col("avg_deviation") * 2) * 0.20
            + pattern_points * 0.10
            + F.least(F.lit(100.0), F.col("n") * 5.0) * 0.10
        )
    else:
        spread = F.sqrt(F.greatest(F.lit(0.0), F.col("s2") / F.col("n") - F.pow(F.col("s1") / F.col("n"), F.lit(2))))
        honesty = F.coalesce(F.col("check_3_driver_score"), F.col("hit_rate"))
        score = (
            F.col("hit_rate") * 0.40
            + F.greatest(F.lit(0.0), 100 - F.col("avg_deviation")) * 0.25
            + F.greatest(F.lit(0.0), 100 - spread) * 0.20
            + honesty * 0.15
        )
    trend = (
        F.when((F.col("n") >= 4) & (F.col("second_hits") > F.col("first_hits")), "improving")
        .when((F.col("n") >= 4) & (F.col("second_hits") < F.col("first_hits")), "declining")
        .otherwise("stable")
    )
    return agg.withColumns({"overall_score": clamp(score), "trend": trend})


LATEST_METRICS = ["revenue", "opm", "operating_profit", "interest", "net_profit", "borrowings"]


def financial_quality(facts: DataFrame) -> DataFrame:
    """50 plus points for growth, margin, coverage and profit of the latest year."""
    return financial_quality_columns(latest_prev_wide(facts, LATEST_METRICS)).select(
        "company_id", "growth_points", "margin_points", "coverage_points", "profit_points",
        "revenue_growth", "opm", "coverage", "net_profit", "financial_quality",
    )


def financial_quality_columns(w: DataFrame) -> DataFrame:
    prev = F.col("revenue_prev")
    w = w.withColumns({
        "revenue_growth": F.when(prev > 0, (F.col("revenue") - prev) / prev * 100),
        "coverage": F.when(F.col("interest") > 0, F.col("operating_profit") / F.col("interest")),
    })
    g, m, c, np_ = F.col("revenue_growth"), F.col("opm"), F.col("coverage"), F.col("net_profit")
    w = w.withColumns({
        "growth_points": F.when(g.isNull(), 0).when(g > 20, 15).when(g > 10, 10).when(g > 0, 5).when(g > -10, -5).otherwise(-15),
        "margin_points": F.when(m.isNull(), 0).when(m > 25, 15).when(m > 15, 10).when(m > 10, 5).otherwise(-5),
        "coverage_points": F.when(c.isNull(), 0).when(c > 5, 10).when(c > 3, 5).when(c > 1.5, 0).otherwise(-10),
        "profit_points": F.when(np_.isNull(), 0).when(np_ > 0, 5).otherwise(-10),
    })
    total = F.lit(50) + F.col("growth_points") + F.col("margin_points") + F.col("coverage_points") + F.col("profit_points")
    return w.withColumn("financial_quality", clamp(total.cast("double")))


def penalties(flags: DataFrame) -> DataFrame:
    """All four severity-weighted sums per company in a single pass."""
    sev = F.col("severity")
    mgmt, cyc = F.col("category").isin(MANAGEMENT_CATEGORIES), F.col("category").isin(CYCLICAL_CATEGORIES)
    return flags.groupBy("company_id").agg(
        F.count("*").alias("n_flags"),
        *[F.count_if(sev == s).alias(f"n_{s}") for s in RISK_WEIGHTS],
        F.sum(weight_of(sev, RISK_WEIGHTS, 5)).alias("risk_penalty"),
        F.coalesce(F.sum(F.when(mgmt, weight_of(sev, MANAGEMENT_WEIGHTS, 3))), F.lit(0)).alias("mgmt_penalty"),
        F.coalesce(F.sum(F.when(cyc, weight_of(sev, CYCLICAL_WEIGHTS, 2))), F.lit(0)).alias("cyclical_penalty"),
        (F.count_if(sev == "critical") * FORWARD_WEIGHTS["critical"] + F.count_if(sev == "high") * FORWARD_WEIGHTS["high"]
         + F.count_if(~sev.isin("critical", "high")) * FORWARD_WEIGHTS["medium"]).alias("forward_weight"),
    )


def risk_score(companies: DataFrame, flags: DataFrame) -> DataFrame:
    p = penalties(flags)
    return companies.select("company_id").join(p, "company_id", "left").select(
        "company_id",
        *[F.coalesce(F.col(f"n_{s}"), F.lit(0)).alias(f"n_{s}") for s in RISK_WEIGHTS],
        *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("risk_penalty", "mgmt_penalty", "cyclical_penalty")],
        F.coalesce(F.col("forward_weight"), F.lit(0.0)).alias("forward_weight"),
        F.when(F.col("n_flags").isNull(), 75.0).otherwise(clamp((100 - F.col("risk_penalty")).cast("double"))).alias("risk_identification"),
    )


def metric_family(metric: Column) -> Column:
    m = F.lower(F.coalesce(metric, F.lit("")))
    expr = F.lit("other")
    for name, words in reversed(METRIC_FAMILIES):
        expr = F.when(F.greatest(*[F.contains(m, F.lit(w)) for w in words]), name).otherwise(expr)
    return expr


def truthfulness(dev: DataFrame, claims: DataFrame | None = None) -> DataFrame:
    """Miss rates, trend and hard-language penalties per company.

    ``claims`` supplies ``confidence_language`` by a left lookup when the
    deviations do not carry it already.
    """
    if claims is not None:
        dev = dev.drop("confidence_language").join(claims.select("claim_id", "confidence_language"), "claim_id", "left")
    return truthfulness_columns(delivery_profile(dev)).select(
        "company_id", "overall_miss_rate", "trend_penalty", "hard_language_miss_rate", "language_penalty",
        *[f"miss_rate_{f}" for f, _ in METRIC_FAMILIES], "truthfulness",
    )


def truthfulness_columns(p: DataFrame) -> DataFrame:
    n, n1 = F.col("n"), F.col("first_n")
    m1, m2 = n1 - F.col("first_hits"), (n - n1) - F.col("second_hits")
    # a single row is both halves at once, so its trend is zero
    trend = F.when(n1 == 0, 0.0).otherwise(F.greatest(F.lit(0.0), m2 / (n - n1) - m1 / n1) * 25)
    hard_rate = F.when(F.col("hard_n") > 0, F.col("hard_m") / F.col("hard_n")).otherwise(0.0)
    p = p.withColumns({
        "overall_miss_rate": (n - F.col("hits")) / n, "trend_penalty": trend, "hard_language_miss_rate": hard_rate,
        **{f"miss_rate_{f}": F.when(F.col(f"n_{f}") > 0, F.col(f"m_{f}") / F.col(f"n_{f}")) for f, _ in METRIC_FAMILIES},
    })
    p = p.withColumn("language_penalty", F.col("hard_language_miss_rate") * 20)
    return p.withColumn("truthfulness", clamp(100 - F.col("overall_miss_rate") * 60 - F.col("trend_penalty") - F.col("language_penalty")))


def management_credibility(companies: DataFrame, dev: DataFrame, risk: DataFrame) -> DataFrame:
    profile = truthfulness_columns(credibility_columns(delivery_profile(dev)))
    keep = ["company_id", "overall_score", "hit_rate", "avg_deviation", "consecutive_misses", "trend", "truthfulness", "overall_miss_rate"]
    j = companies.select("company_id").join(profile.select(*keep), "company_id", "left").join(risk.select("company_id", "mgmt_penalty"), "company_id", "left")
    return management_columns(j).select("company_id", "management_credibility", "overall_score", "overall_miss_rate")


def management_columns(j: DataFrame) -> DataFrame:
    bonus = F.when(F.col("trend") == "improving", 4).when(F.col("trend") == "declining", -4).otherwise(0)
    score = (
        F.coalesce("overall_score", F.lit(50.0)) * 0.45
        + F.coalesce("hit_rate", F.lit(50.0)) * 0.20
        + F.greatest(F.lit(0.0), 100 - F.coalesce("avg_deviation", F.lit(20.0))) * 0.15
        + F.coalesce("truthfulness", F.lit(50.0)) * 0.20
        + bonus
        - F.least(F.lit(12), F.coalesce("consecutive_misses", F.lit(0)) * 4)
        - F.coalesce("mgmt_penalty", F.lit(0))
    )
    return j.withColumns({"management_credibility": clamp(score), "overall_miss_rate": F.coalesce("overall_miss_rate", F.lit(0.0))})


def coverage_points(icr: Column) -> Column:
    return F.when(icr.isNull(), 50.0).when(icr >= 4, 90.0).when(icr >= 2.5, 70.0).when(icr >= 1.5, 45.0).otherwise(20.0)


def stress_cells():
    return [(dn, rn, dm, rm, dp * rp) for dn, dm, dp in DEMAND_SHOCKS for rn, rm, rp in RATE_SHOCKS]


def base_coverage(facts: DataFrame, debt_divisor: float = 1.0) -> DataFrame:
    w = latest_prev_wide(facts, ["opm", "operating_profit", "interest", "borrowings"])
    return coverage_columns(w, debt_divisor).select("company_id", "opm", "debt", "base_icr")


def coverage_columns(w: DataFrame, debt_divisor: float = 1.0) -> DataFrame:
    icr = F.when(F.col("interest") > 0, F.col("operating_profit") / F.col("interest"))
    return w.withColumns({"debt": F.col("borrowings") / debt_divisor, "base_icr": icr})


def stress_matrix(base: DataFrame) -> DataFrame:
    """Nine scenario rows per company, exploded from a literal grid (no join)."""
    grid = F.array(*[
        F.struct(F.lit(dn).alias("demand"), F.lit(rn).alias("rate"), F.lit(dm).alias("dm"), F.lit(rm).alias("rm"), F.lit(p).alias("probability"))
        for dn, rn, dm, rm, p in stress_cells()
    ])
    cells = base.select("company_id", "base_icr", F.explode(grid).alias("g"))
    icr = F.col("base_icr") * F.col("g.dm") / F.col("g.rm")
    return cells.select("company_id", "g.demand", "g.rate", "g.probability", icr.alias("stressed_icr"), coverage_points(icr).alias("cell_score"))


def stress_test(base: DataFrame, risk: DataFrame) -> DataFrame:
    """Probability-weighted stress score; the nine cells are one row expression."""
    j = base.join(risk.select("company_id", "cyclical_penalty"), "company_id", "left")
    return stress_columns(j).select("company_id", "base_icr", "weighted_icr", "breach_probability", "stress_test_resilience")


def stress_columns(j: DataFrame) -> DataFrame:
    icr = F.col("base_icr")
    score = breach = weighted = F.lit(0.0)
    for _, _, dm, rm, p in stress_cells():
        s = icr * dm / rm
        score = score + coverage_points(s) * p
        breach = breach + F.when(s < 1.5, p).otherwise(0.0)
        weighted = weighted + s * p
    opm, debt = F.col("opm"), F.col("debt")
    buffer = F.when(opm >= 25, 8).when(opm >= 15, 4).when(opm < 10, -8).otherwise(0)
    debt_points = F.when(debt <= 500, 6).when(debt > 3000, -8).otherwise(0)
    return j.withColumns({
        "weighted_icr": weighted, "breach_probability": breach,
        "stress_test_resilience": clamp(score + buffer + debt_points - F.coalesce("cyclical_penalty", F.lit(0))),
    })


def forward_risk(df: DataFrame) -> DataFrame:
    """Three heuristic probabilities from columns of the joined scorecard frame."""
    fin, risk = F.col("financial_quality"), F.col("risk_identification")
    breach, miss, wt = (F.coalesce(c, F.lit(0.0)) for c in ("breach_probability", "overall_miss_rate", "forward_weight"))
    return (
        df.withColumn("p_margin_compression", clamp(0.12 + 0.10 * wt + 0.35 * breach + (70 - fin) / 200, 0.05, 0.95))
        .withColumn("p_guidance_miss", clamp(0.10 + 0.65 * miss + (65 - risk) / 220, 0.05, 0.95))
        .withColumn("p_liquidity_stress", clamp(0.08 + 0.55 * breach + (75 - risk) / 250, 0.03, 0.95))
    )


def industry_position(facts: DataFrame, metric: str = "operating_profit") -> DataFrame:
    """Rank on the latest annual value; percentile banded to 30..85, 70 when alone."""
    latest = facts.filter(F.col("metric") == metric).groupBy("company_id").agg(F.max_by("value", "ord").alias("value"))
    return industry_columns(latest.withColumn("value", F.coalesce("value", F.lit(0.0)))).select(
        "company_id", "value", "rank", "total", "percentile", "industry_position")


def industry_columns(latest: DataFrame, value: str = "value") -> DataFrame:
    pct = 1 - (F.col("rank") - 1) / (F.col("total") - 1)
    return global_rank(latest, value).withColumns({
        "percentile": F.when(F.col("total") > 1, pct * 100).otherwise(100.0),
        "industry_position": F.when(F.col("total") > 1, 30 + pct * 55).otherwise(70.0),
    })


def composite(df: DataFrame) -> Column:
    return sum((F.col(d) * w for d, w in DIMENSION_WEIGHTS.items()), F.lit(0.0))


def peer_normalise(snapshot: DataFrame, dims: Sequence[str] | None = None) -> DataFrame:
    """z-score, competition rank and percentile of every dimension across peers."""
    dims = list(dims or [*DIMENSION_WEIGHTS, "composite"])
    # read five times below, so computed once
    long = cut_lineage(snapshot.unpivot(["company_id"], dims, "dimension", "value"))
    stats = long.groupBy("dimension").agg(
        F.avg("value").alias("peer_mean"), F.stddev_pop("value").alias("peer_std"))
    ranked = global_rank(long, "value", ["dimension"])
    return ranked.join(stats, "dimension").select(
        "company_id", "dimension", "value", "peer_mean", "peer_std",
        F.when(F.col("peer_std") < 1e-9, 0.0).otherwise((F.col("value") - F.col("peer_mean")) / F.col("peer_std")).alias("z_score"),
        F.when(F.col("total") > 1, (1 - (F.col("rank") - 1) / (F.col("total") - 1)) * 100).otherwise(100.0).alias("percentile"),
        "rank", "total",
    )


def uncertainty_band(df: DataFrame) -> DataFrame:
    """Band half-width from coverage and from the spread across dimensions."""
    dims = [F.col(d) for d in DIMENSION_WEIGHTS]
    mean = sum(dims[1:], dims[0]) / len(dims)
    var = sum(((d - mean) * (d - mean) for d in dims), F.lit(0.0)) / len(dims)
    base = F.when(F.col("confidence") == "high", 6.0).when(F.col("confidence") == "medium", 9.0).otherwise(13.0)
    width = base + F.greatest(F.lit(0.0), 4.0 - F.col("data_points")) * 1.2 + F.sqrt(var) * 0.08
    return df.withColumn("band_width", width).withColumn("band_low", clamp(F.col("composite") - width)).withColumn("band_high", clamp(F.col("composite") + width))


def data_coverage(companies: DataFrame, tables: Sequence[DataFrame]) -> DataFrame:
    """How many of the given tables have rows for a company, and a confidence label."""
    present = None
    for i, t in enumerate(tables):
        keys = t.select("company_id").distinct().withColumn("src", F.lit(i))
        present = keys if present is None else present.unionByName(keys)
    counts = present.groupBy("company_id").agg(F.count("*").alias("data_points"))
    n = F.coalesce("data_points", F.lit(0))
    return companies.select("company_id").join(counts, "company_id", "left").select(
        "company_id", n.alias("data_points"),
        F.when(n >= 3, "high").when(n >= 2, "medium").otherwise("low").alias("confidence"),
    )


def scorecard(companies, facts, claims, dev, flags, chunks, debt_divisor=1.0) -> DataFrame:
    """Five dimensions, composite, confidence, band and forward risks per company.

    ``facts`` holds annual rows. Each input is aggregated once to one row per
    company and the dimensions are columns of the joined frame. The aggregated
    frame is checkpointed: the ranking reads it several times.
    """
    keep = ["company_id", "overall_score", "hit_rate", "avg_deviation", "consecutive_misses", "trend", "truthfulness", "overall_miss_rate"]
    profile = truthfulness_columns(credibility_columns(delivery_profile(dev))).select(*keep)
    newest = facts.groupBy("company_id").agg(F.max_by("period", "ord").alias("period"))
    claimed = claims.select("company_id").distinct().withColumn("in_claims", F.lit(1))
    chunked = chunks.select("company_id").distinct().withColumn("in_chunks", F.lit(1))
    base = (
        companies.select("company_id", "segment")
        .join(latest_prev_wide(facts, LATEST_METRICS), "company_id", "left")
        .join(newest, "company_id", "left")
        .join(profile, "company_id", "left")
        .join(penalties(flags), "company_id", "left")
        .join(claimed, "company_id", "left")
        .join(chunked, "company_id", "left")
    )
    base = cut_lineage(base)
    points = sum((F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in ("period", "in_claims", "n_flags", "in_chunks")), F.lit(0)).cast("long")
    base = base.withColumns({
        "data_points": points,
        "delivery_credibility": F.coalesce("overall_score", F.lit(50.0)),
        "forward_weight": F.coalesce("forward_weight", F.lit(0.0)),
        "risk_identification": F.when(F.col("n_flags").isNull(), 75.0).otherwise(clamp((100 - F.col("risk_penalty")).cast("double"))),
    })
    base = base.withColumn("confidence", F.when(points >= 3, "high").when(points >= 2, "medium").otherwise("low"))
    base = stress_columns(coverage_columns(management_columns(financial_quality_columns(base)), debt_divisor))
    ranked = industry_columns(base.filter("period is not null").select("company_id", F.coalesce("operating_profit", F.lit(0.0)).alias("value")))
    base = base.join(ranked.select("company_id", "industry_position", F.col("rank").alias("industry_rank")), "company_id", "left")
    base = base.withColumn("industry_position", F.coalesce("industry_position", F.lit(50.0)))
    base = base.withColumn("composite", composite(base))
    return forward_risk(uncertainty_band(base))
