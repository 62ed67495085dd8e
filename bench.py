"""Headline benchmark: prints one JSON line with seconds per query.

``BENCH_SF_DIR`` names the table folder, ``BENCH_CPUS`` the local cores. Each query
runs once to warm up and is then timed; results are drained, not collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from guidepost import catalog  # noqa: E402
from guidepost.session import local_session  # noqa: E402

HEADLINE = [
    "j1_claim_actual", "x1_flag", "a1_hit_rate", "x2_credibility", "x3_fin_quality", "x10_scorecard", "w2_rank_percentile", "w5_growth",
    "j4_forward_window", "j5_asof_backward", "j7_nearest", "a17_concentration", "x11_health", "x20_enrich", "x21_quarters",
    "s4_doc_flatten", "t3_chunk", "t5_sentences", "t8_tag", "t18_promises", "x15_verify",
    "n1_gates", "w14_keep_first", "n4_fuzzy_dedup", "a15_digest",
    "g1_graph", "k3_tier_search", "g5_neighbors", "g4_shortest_path", "g7_components", "v1_cosine_topk", "v1c_many_queries", "v4_keyword_topk",
    "s9_upsert", "st3_meter",
]


def built_graph_times(spark, sf: str) -> dict[str, float]:
    """Look-ups on a graph that was loaded before, as an analyst would make them."""
    from guidepost.catalog.q_graph import built
    from guidepost.operators import graph as G
    from guidepost.session import scratch_path

    root = scratch_path(spark, "bench-graph")
    names = ("nodes", "edges", "members")
    start = time.perf_counter()
    for name, df in zip(names, built(spark, sf)):
        df.write.parquet(f"{root}/{name}")
    out = {"graph_load": time.perf_counter() - start}
    nodes, edges, members = (spark.read.parquet(f"{root}/{n}").cache() for n in names)
    for df in (nodes, edges, members):
        df.count()
    asks = {
        "graph_node_search": lambda: G.tier_search(nodes, "FY0").collect(),
        "graph_subgraph": lambda: G.company_subgraph(nodes, edges, members, "C3", 100)[1].collect(),
    }
    for name, ask in asks.items():
        runs = []
        for _ in range(4):
            start = time.perf_counter()
            ask()
            runs.append(time.perf_counter() - start)
        out[name] = sorted(runs[1:])[1]
    return {k: round(v, 3) for k, v in out.items()}


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, "guidepost-bench")
    times = {}
    for name in names:
        fn = catalog.QUERIES[name]
        runs = []
        for _ in range(2):
            start = time.perf_counter()
            fn(spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(runs[-1], 3)
    if not sys.argv[1:]:
        times.update(built_graph_times(spark, sf))
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
