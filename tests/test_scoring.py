"""Hand-computed boundary rows of the scoring ladders, and ordered operators against plain windows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from guidepost.functions import periods as P
from guidepost.operators import ordered as O
from guidepost.plans import scoring as S


@pytest.mark.parametrize("guided, actual, flag, severity", [
    (100.0, 105.0, "IN-LINE", "none"), (100.0, 95.0, "IN-LINE", "none"), (100.0, 105.5, "BEAT", "none"), (100.0, 110.0, "BEAT", "minor"),
    (100.0, 94.0, "MISS", "minor"), (100.0, 90.0, "MISS", "moderate"), (100.0, 80.0, "MISS", "major"), (100.0, 65.0, "MISS", "critical"),
    (0.0, 50.0, "IN-LINE", "none"), (-100.0, -90.0, "BEAT", "minor"),
])
def test_flag_bands(spark, guided, actual, flag, severity):
    df = spark.createDataFrame([("m", guided, actual)], "metric string, guided_value double, actual_value double")
    r = S.flag_deviation(df).first()
    assert (r.flag, r.severity) == (flag, severity)


def test_lower_is_better_reverses_the_verdict(spark):
    df = spark.createDataFrame([("borrowings", 100.0, 80.0)], "metric string, guided_value double, actual_value double")
    assert S.flag_deviation(df).first().flag == "MISS"
    assert S.flag_deviation(df, ["borrowings"]).first().flag == "BEAT"


@pytest.mark.parametrize("label, key, norm", [
    ("FY24", 2024 * 12 + 3, "FY24"), ("FY 2024", 2024 * 12 + 3, "FY24"), ("Q2 FY24", 2023 * 12 + 9, "Q2FY24"), ("q4 fy2024", 2024 * 12 + 3, "Q4FY24"),
    ("FY20", 2020 * 12 + 3, "FY20"), ("FY 2020", 2020 * 12 + 3, "FY20"), ("H1 FY25", 2024 * 12 + 9, "H1FY25"), ("Mar 2025", 2025 * 12 + 3, "MAR2025"), ("2025_Feb", 2025 * 12 + 2, "2025_FEB"), ("TTM", None, "TTM"), ("FY97", 1997 * 12 + 3, "FY97"),
])
def test_period_labels(spark, label, key, norm):
    r = spark.createDataFrame([(label,)], "p string").select(P.period_key(F.col("p")).alias("k"), P.normalise_period(F.col("p")).alias("n")).first()
    assert (r.k, r.n) == (key, norm)


def test_compat_normalisation_keeps_the_old_rule(spark):
    rows = spark.createDataFrame([("FY20",), ("FY 2024",)], "p string").select(P.normalise_period(F.col("p"), compat=True)).collect()
    assert [r[0] for r in rows] == ["FY", "FY24"]


def outcomes(spark, seed, n=400):
    rnd = random.Random(seed)
    rows = [("hot" if rnd.random() < 0.4 else f"c{rnd.randrange(5)}", rnd.randrange(6), f"{rnd.getrandbits(40):010x}{i}", rnd.choice(["MISS", "BEAT", "IN-LINE"])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "company_id string, period_ord int, claim_id string, flag string").withColumn("blk", F.substring("claim_id", 1, 1))


def test_blocked_running_equals_one_window(spark):
    _, df = outcomes(spark, 1)
    out = O.blocked_running(df, ["company_id"], ["period_ord", "blk"], ["claim_id"], {"pos": F.lit(1), "miss": F.col("flag") == "MISS"})
    w = Window.partitionBy("company_id").orderBy("period_ord", "claim_id")
    plain = out.withColumn("p2", F.row_number().over(w) - 1).withColumn("m2", F.coalesce(F.sum((F.col("flag") == "MISS").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    assert plain.filter("pos <> p2 or miss <> m2").count() == 0


def test_longest_run_against_python(spark):
    rows, df = outcomes(spark, 2)
    got = {r.company_id: r.max_run for r in O.longest_run(df, ["company_id"], ["period_ord", "blk"], ["claim_id"], F.col("flag") == "MISS").collect()}
    for c in {r[0] for r in rows}:
        best = run = 0
        for r in sorted((r for r in rows if r[0] == c), key=lambda r: (r[1], r[2])):
            run = run + 1 if r[3] == "MISS" else 0
            best = max(best, run)
        assert got[c] == best


def test_global_rank_with_ties_and_a_hot_value(spark):
    rnd = random.Random(3)
    vals = [5.0] * 300 + [float(rnd.randrange(40)) for _ in range(500)] + [None] * 3
    df = spark.createDataFrame(list(enumerate(vals)), "id int, v double")
    got = {r.id: r["rank"] for r in O.global_rank(df, "v", buckets=8).collect()}
    for i, v in enumerate(vals):
        assert got[i] == (None if v is None else 1 + sum(1 for x in vals if x is not None and x > v))


def test_single_company_profile(spark):
    rows = [("a", 1, "x1", "check_5_debt", "Debt", "will", -12.0, "MISS")]
    df = spark.createDataFrame(rows, "company_id string, period_ord int, claim_id string, check_type string, metric_type string, confidence_language string, delta_pct double, flag string")
    t = S.truthfulness(df).first()
    assert t.trend_penalty == 0 and t.overall_miss_rate == 1 and t.truthfulness == 20
    c = S.credibility(df).first()
    assert c.hit_rate == 0 and c.check_5_debt_score == 0 and c.check_2_keys_score is None and c.trend == "stable"


def test_stress_probabilities_sum_to_one():
    assert abs(sum(p for *_, p in S.stress_cells()) - 1) < 1e-12
    assert abs(sum(S.DIMENSION_WEIGHTS.values()) - 1) < 1e-12


def test_scores_stay_in_range(spark, sf):
    from guidepost.catalog.q_scoring import scorecard_frame

    d = scorecard_frame(spark, sf)
    cols = [*S.DIMENSION_WEIGHTS, "composite", "band_low", "band_high"]
    assert d.filter(" or ".join(f"{c} < 0 or {c} > 100" for c in cols)).count() == 0
    assert d.filter("p_liquidity_stress < 0.03 or p_liquidity_stress > 0.95").count() == 0


def test_global_rank_cuts_buckets_again_as_values_grow(spark):
    assert [O.rank_levels(n, 64, 50_000) for n in (None, 0, 50_000, 50_001, 3_200_000, 3_200_001)] == [0, 0, 0, 1, 1, 2]
    rnd = random.Random(9)
    rows = [(i, rnd.choice("ab"), rnd.choice([7, rnd.randrange(3000)])) for i in range(4000)]
    df = spark.createDataFrame(rows, "id int, g string, v int")
    by = {}
    for _, g, v in rows:
        by.setdefault(g, []).append(v)
    for most in (5, 40, 10**6):
        for desc in (True, False):
            got = {r.id: (r["rank"], r.total) for r in O.global_rank(df, "v", ["g"], descending=desc, buckets=4, per_bucket=most).collect()}
            for g, vs in by.items():
                first = {}
                for at, v in enumerate(sorted(vs, reverse=desc)):
                    first.setdefault(v, at + 1)
                assert all(got[i] == (first[v], len(vs)) for i, k, v in rows if k == g)
    flat = {r.id: r["rank"] for r in O.global_rank(df, "v", buckets=4, per_bucket=20).collect()}
    assert all(flat[i] == 1 + sum(w > v for _, _, w in rows) for i, _, v in rows[:200])
