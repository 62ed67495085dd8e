import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from guidepost.llm import centroid_clustering as C
from guidepost.llm import vector_codes as P
from guidepost.llm.vectors import pairwise

SCHEMA = "vec_id long, embedding array<float>, label int"
ODD = ("x", "near", "bound", "need", "c", "salt", "of", "own", "cluster", "distance", "v")


def plain(x, entries, rounds):
    """Rounds of nearest entry and floored means, everything measured."""
    e = entries.copy()
    for r in range(rounds + 1):
        d = pairwise(x, e)
        a = d.argmin(axis=1)
        if r < rounds:
            for j in range(len(e)):
                if (a == j).any():
                    e[j] = x[a == j].sum(axis=0) // (a == j).sum()
    return a, d[np.arange(len(x)), a], e


def vectors(n=900, dim=64, seed=2):
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((9, dim)) / 8
    rows = [(i, (centre[i % 9] + rng.standard_normal(dim) * rng.choice([0.01, 0.1])).astype(np.float32).tolist(), [0, 0, 0, 1, None][i % 5]) for i in range(n)]
    rows += [(n + i, rows[3][1], 2) for i in range(40)] + [(n + 50, [1.0 / 128] * dim, 3), (n + 51, [0.0] * dim, 3)]
    return rows


def bad_rows(dim=64):
    ok = [0.25] * dim
    return [(None, ok, 1), (-1, None, 1), (-2, [], 1), (-3, [0.5] * (dim - 1), 1), (-4, [None] + ok[1:], 1), (-5, [float("nan")] + ok[1:], 1), (-6, [float("-inf")] + ok[1:], 1), (7, ok, None), (7, ok, None), (5000, [3e38] * dim, 4)]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit("y").alias(c) for c in ODD]).repartition(3)


def whole(v, scale):
    return np.floor(np.clip(np.array(v, np.float32).astype(float) * scale, -(2.0**25), 2.0**25)).astype(np.int64)


@pytest.mark.parametrize("k", [1, 2, 16, 40])
def test_orchard_finds_the_nearest_with_ties(k):
    rng = np.random.default_rng(k)
    c = rng.integers(-3, 4, (k, 5))
    c[k // 2] = c[0]  # equal centroids
    x = rng.integers(-3, 4, (3000, 5))
    best, dist, taken = C.Orchard(c).nearest(x)
    d = pairwise(x, c)
    assert (best == d.argmin(axis=1)).all() and (dist == d.min(axis=1)).all() and taken <= d.size


def test_orchard_skips_far_centroids():
    rng = np.random.default_rng(1)
    c = rng.integers(-1000, 1000, (64, 8))
    x = c[rng.integers(0, 64, 5000)] + rng.integers(-20, 21, (5000, 8))
    assert C.Orchard(c).nearest(x)[2] < 5000 * 64 / 2


def test_clusters_equal_plain_rounds(spark):
    rows = vectors() + bad_rows()
    kept = [(i, whole(v, 64)) for i, v, _ in rows if v is not None and len(v) == 64 and np.isfinite(np.array(v, float)).all()]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1].tolist()))
    a, d, e = plain(np.array([x for _, x in kept]), np.array([x for _, x in order[:16]]), 3)
    sums = np.bincount(a, weights=d.astype(float), minlength=16)
    want = sorted((repr(i), int(c), int(q), int(sums[c]), int(d.sum()), hashlib.sha256(",".join(map(str, e[c])).encode()).hexdigest()) for (i, _), c, q in zip(kept, a, d))
    got = sorted((repr(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in C.cluster(frame(spark, rows)).collect())
    assert got == want


def test_few_and_no_vectors(spark):
    few = vectors()[:5]
    got = C.cluster(frame(spark, few)).collect()
    assert sorted(r.cluster for r in got) == [0, 1, 2, 3, 4] and {r.inertia for r in got} == {0}
    codes = P.compress(frame(spark, few)).collect()
    assert len({r.code for r in codes}) == 5 and {r.error for r in codes} == {0}
    for f in (C.cluster, P.compress):
        none = f(spark.createDataFrame([], SCHEMA))
        assert none.count() == 0 and none.columns == f(frame(spark, few)).columns
        assert f(frame(spark, [(1, None, 1), (2, [float("nan")] * 64, 1)])).count() == 0
        assert f(frame(spark, few[:1])).count() == 1


def coded(rows, parts=8, k=16, rounds=6):
    """Codes by plain rounds, for rows that are all usable and of one length."""
    x = np.array([whole(v, 4096) for _, v, _ in rows])
    first = sorted(range(len(rows)), key=lambda j: (rows[j][0] is None, rows[j][0] or 0, x[j].tolist()))[:k]
    cut = x.reshape(len(x), parts, -1)
    got = [plain(cut[:, p], cut[first, p], rounds) for p in range(parts)]
    code = ["".join(f"{a[j]:02x}" for a, _, _ in got) for j in range(len(x))]
    error = np.sum([d for _, d, _ in got], axis=0)
    digest = hashlib.sha256(",".join(str(v) for _, _, e in got for v in e.reshape(-1)).encode()).hexdigest()
    label: dict = {}
    for (_, _, l), q in zip(rows, error):
        label[l] = label.get(l, 0) + int(q)
    return sorted((repr(i), c, int(q), label[l], digest) for (i, _, l), c, q in zip(rows, code, error))


@pytest.mark.parametrize("k", [2, 16, 24])
def test_codes_equal_plain_rounds(spark, k):
    rows = vectors() + bad_rows()
    usable = [r for r in rows if r[1] is not None and len(r[1]) == 64 and np.isfinite(np.array(r[1], float)).all()]
    report: list = []
    got = P.compress(frame(spark, rows), k=k, report=report).collect()
    assert sorted((repr(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in got) == coded(usable, k=k)
    assert len(report) == 6 and all(sum(h) == 8 * len(usable) for _, h in report)
    if k > 2:  # bounds settle most parts in the later rounds
        assert report[-1][1][0] > 4 * len(usable)


def test_lists_of_any_length_give_the_same_states():
    """Bounds stay true and assignments exact while lists shrink and grow."""
    rng = np.random.default_rng(7)
    e = rng.integers(-50, 50, (4, 12, 3))
    x = rng.integers(-60, 60, (4 * 500, 3))
    pos = np.arange(len(x)) % 4
    books, s = P.Codebooks(e), None
    s = books.first(x, 3)
    for b in (3, 1, 5, 5, 2, 11, 0, 4):
        new = books.e + rng.integers(-4, 5, books.e.shape)
        books = P.Codebooks(new, books.e)
        s = books.again(x, s.resized(b))
        d = np.stack([((x - new[pos, j]) ** 2).sum(1) for j in range(12)], axis=1)
        assert (s.near[:, 0] == d.argmin(axis=1)).all()
        assert (s.up.astype(float) ** 2 >= d.min(axis=1)).all()
        listed = np.zeros_like(d, bool)
        for j in range(b + 1):
            known = s.near[:, j] >= 0
            listed[np.flatnonzero(known), s.near[known, j]] = True
            if j:
                own = np.where(known, d[np.arange(len(x)), np.maximum(s.near[:, j], 0)], 1 << 40)
                assert (np.maximum(s.low[:, j - 1], 0) ** 2 <= own).all()
        out = np.where(listed, 1 << 62, d).min(axis=1)
        assert (np.maximum(s.outer, 0) ** 2 <= out).all()


def test_list_length_adapts():
    assert P.next_b(np.array([900, 95, 4, 1, 0, 0]), 4, 16) == 2  # never below an eighth
    assert P.next_b(np.array([0, 50, 30, 16, 2, 2]), 4, 16) == 3
    assert P.next_b(np.array([0, 1, 1, 1, 1, 96]), 4, 16) == 5  # grows where all entries were needed
    assert P.next_b(np.array([5, 0, 0, 0, 0, 0]), 4, 16) == 2 and P.next_b(np.array([5, 1]), 0, 1) == 0


def test_label_sums_by_salted_keys(spark):
    rows = spark.createDataFrame([(i, [1, 1, None, 2][i % 4], i) for i in range(400)], "vec_id long, label int, error long").repartition(4)
    sums = rows.groupBy("label").agg(F.sum("error").alias("label_error"))
    cols = ["vec_id", "label_error"]
    assert sorted(P.with_sums(rows, sums, most=0).select(*cols).collect()) == sorted(P.with_sums(rows, sums).select(*cols).collect())


def test_lengths_that_cannot_be_cut(spark):
    assert P.compress(spark.createDataFrame([(1, [1.0] * 9, 1)], SCHEMA)).count() == 0
    got = P.compress(spark.createDataFrame([(2, [1.0] * 16, 1), (3, [1.0] * 24, 1), (None, [1.0] * 24, 1), (4, [1.0] * 16, 2), (1, [1.0] * 9, 2), (0, [2.0] * 9, 2), (5, [2.0] * 9, 2)], SCHEMA)).collect()
    assert sorted(r.vec_id for r in got) == [2, 4]
