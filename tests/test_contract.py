"""Registered queries against their SQL twins on the smallest tables.

``GUIDEPOST_ALL=1`` runs every query; by default one of each family runs here and
``tools/check.py`` covers the rest.
"""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_points

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUICK = [
    "j1_claim_actual", "x1_flag", "x2_credibility", "x10_scorecard", "w3_peer_z", "w4_avg_rank", "r1_unpivot", "r4_fiscal_period", "j4_forward_window", "j5_asof_backward", "j7_nearest",
    "s1_wide_scan", "s2_additional", "s4_doc_flatten", "s7_links", "s13_route_items", "t4_pack", "t5_sentences", "t12_section", "t15_target", "x15_verify", "n1_gates", "n4a_token_subset_pairs",
    "a12_health", "a9_edges", "g5_neighbors", "g7_components", "g4_shortest_path", "g10_collision", "v1_cosine_topk", "v1c_many_queries", "st2_page_change", "st3_meter", "st3_meter_stream", "x11_health", "x18_mix",
]
NAMES = sorted(entry_points.oracle_sql()) if os.environ.get("GUIDEPOST_ALL") else QUICK


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a == b


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, sf, name):
    df = entry_points.queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    cur = con.execute(entry_points.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted((tuple(r[names.index(c)] for c in cols) for r in cur.fetchall()), key=repr)
    assert len(got) == len(want)
    assert all(same(x, y) for g, w in zip(got, want) for x, y in zip(g, w))


def test_every_sql_has_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_entry_has_rows(spark):
    df = entry_points.entry(spark)
    assert df.columns and df.count() > 0
