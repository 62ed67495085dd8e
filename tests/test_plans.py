"""Physical plan checks: no cartesian products, no Python where none belongs, pruned scans."""

import contextlib
import io

import pytest

from guidepost import catalog


def plan(spark, sf, name):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        catalog.QUERIES[name](spark, sf).explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name", ["j1_claim_actual", "x2_credibility", "a17_concentration", "g10_collision", "j4_forward_window", "j5_asof_backward", "j7_nearest", "t12_section", "n1_gates", "n4a_token_subset_pairs", "t18_promises", "x15_verify", "s15_registry"])
def test_equi_joins_and_jvm_only(spark, sf, name):
    p = plan(spark, sf, name)
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    assert not any(x in p for x in ("EvalPython", "MapInPandas", "InPandas"))


def test_filters_and_columns_reach_the_scan(spark, sf):
    p = plan(spark, sf, "v1b_company_topk")
    assert "EqualTo(label,3)" in p
    p = plan(spark, sf, "a13_coverage")
    assert "text" not in [c.strip() for line in p.splitlines() if line.startswith("ReadSchema") for c in line.split("<")[-1].rstrip(">").replace(":", ",").split(",")]


def test_row_expressions_do_not_shuffle(spark, sf):
    for name in ("n1_gates", "t8_tag", "t3_chunk", "r8_url_norm", "s7_links"):
        assert "Exchange" not in plan(spark, sf, name)
