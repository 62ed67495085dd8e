import math

import numpy as np

from guidepost.llm import embedding_dedup as E

SCHEMA = "vec_id long, embedding array<float>, label int"


def expected(rows):
    ok = [(i, np.array(v, np.float32).astype(float), l) for i, v, l in rows if i is not None and l is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v, l in ok:
        near = [j for j, w, m in ok if l == m and len(v) == len(w) and v @ w >= 0.93 * np.linalg.norm(v) * np.linalg.norm(w)]
        out[i] = near
    comp = {i: i for i in out}
    for _ in range(len(out)):
        for i in out:
            comp[i] = min([comp[i], *[comp[j] for j in out[i]]])
    return {i: (len(n) - 1, comp[i]) for i, n in out.items()}


def test_links_and_components(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = []
    for g in range(40):
        c = rng.standard_normal(24)
        for _ in range(10):
            rows.append((len(rows), (c + rng.standard_normal(24) * rng.choice([0.05, 0.25, 0.4])).tolist(), g % 3))
    rows += [(1000 + i, rows[7][1], rows[7][2]) for i in range(30)] + [(2000, rows[7][1], 2 - rows[7][2]), (2001, [10 * x for x in rows[7][1]], rows[7][2])]
    for block in (E.BLOCK, 7):  # whole buckets, and buckets split into pairs of blocks
        monkeypatch.setattr(E, "BLOCK", block)
        got = {r.vec_id: (r.n_links, r.component_id) for r in E.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
        assert got == expected(rows)


def test_recall_follows_from_the_sizes():
    for n in (1, 1000, 10**6, 10**9):
        signs, tables = E.sizes(n)
        assert (1 - (1 - math.acos(0.93) / math.pi) ** signs) ** tables <= E.MISS


def test_odd_rows(spark):
    from pyspark.sql import functions as F

    v = [1.0, 2.0]
    rows = [(1, v, 1), (1, v, 1), (2, None, 1), (3, [0.0, 0.0], 1), (4, [1.0, None], 1), (5, [float("nan"), 1.0], 1), (6, [float("inf"), 1.0], 1), (7, v, None), (None, v, 1), (8, [], 1), (9, [1.0, 2.0, 3.0], 1), (10, [1e30, 2e30], 1), (11, [-0.0, 1.0], 2), (12, [0.0, 1.0], 2)]
    got = E.near_duplicates(spark.createDataFrame(rows, SCHEMA).select("*", F.lit(1).alias("rep"), F.lit(2).alias("v")))
    assert got.count() == len(rows)
    by = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got.collect()}
    assert by[1] == (2, 1, True) and by[10] == (2, 1, False) and by[12] == (1, 11, False)
    assert all(by[i] == (0, i, True) for i in (2, 3, 4, 5, 6, 7, 8, 9)) and by[None] == (0, None, False)
    assert E.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
