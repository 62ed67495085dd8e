import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from guidepost.operators import retrieval as R
from guidepost.operators import stats as A


def test_stored_lists_reach_their_recall(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(R, "FIT_ROWS", 20)  # the centres come from a sample, all rows are indexed
    rng = np.random.default_rng(5)
    centre = rng.standard_normal((40, 16))
    rows = [(i, (centre[i % 40 if i % 3 else 0] + 0.6 * rng.standard_normal(16)).tolist()) for i in range(2400)] + [(9000, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    R.write_ivf(df, f"{tmp_path}/ivf", k=5)
    index = spark.read.parquet(f"{tmp_path}/ivf/lists")
    kept = spark.read.parquet(f"{tmp_path}/ivf/centroids").collect()
    assert index.count() == 2400 and len(kept) == R.ivf_lists(2400) == 49 and sum(r.n for r in kept) == 2400
    q = df.where("vec_id % 50 = 0").selectExpr("vec_id as query_id", "embedding")
    want = {(r.query_id, r.vec_id) for r in R.cosine_topk_many(df, q, 5).collect()}
    found = R.ivf_topk_many(spark, f"{tmp_path}/ivf", q, 5)
    got = {(r.query_id, r.vec_id) for r in found.collect()}
    assert len(want & got) / len(want) >= 0.9 and kept[0].probes < 49
    assert {(r.query_id, r.vec_id) for r in R.ivf_topk_many(spark, f"{tmp_path}/ivf", q, 5, probes=49).collect()} == want
    assert R.ivf_topk_many(spark, f"{tmp_path}/ivf", q.where("query_id < 0"), 5).count() == 0


def test_only_probed_lists_are_read(spark, tmp_path):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i, rng.standard_normal(8).tolist()) for i in range(400)], "vec_id long, embedding array<double>")
    R.write_ivf(df, f"{tmp_path}/ivf")
    q = df.where("vec_id = 50").selectExpr("vec_id as query_id", "embedding")
    plan = R.ivf_topk_many(spark, f"{tmp_path}/ivf", q, 3, probes=2)._jdf.queryExecution().toString()
    assert "PartitionFilters: [list_id" in plan.replace("#", "") or "PartitionFilters: [list" in plan


@pytest.mark.parametrize("percent", [30, 60, 80, 100])
def test_similar_sets_against_all_pairs(spark, percent):
    r = random.Random(percent)
    sets = {i: frozenset(r.choice("aaabbcdefghij") for _ in range(r.randint(1, 9))) for i in range(120)}
    sets |= {200 + i: sets[i % 7] for i in range(40)}  # a class of many equal sets
    rows = [(i % 2, i, x) for i, s in sets.items() for x in s for _ in range(r.randint(1, 2))] + [(0, None, "a"), (0, 500, None)]
    pairs, held = A.similar_sets(spark.createDataFrame(rows, "g int, e long, m string"), "e", "m", ["g"], percent)
    rep = {}
    for i, s in sorted(sets.items()):
        rep.setdefault((i % 2, s), i)
    assert {(x.g, x.e): x.rep for x in held.collect()} == {(i % 2, i): rep[i % 2, s] for i, s in sets.items()}
    want = {(g, a, b) for (g, s), a in rep.items() for (h, t), b in rep.items() if g == h and a < b and 100 * len(s & t) >= percent * len(s | t)}
    got = pairs.collect()
    assert {(x.g, x.left_id, x.right_id) for x in got} == want and len(got) == len(want)
    assert all(x.shared == len(sets[x.left_id] & sets[x.right_id]) and x.only_left == len(sets[x.left_id] - sets[x.right_id]) for x in got)


def test_words_that_cancel_still_have_a_direction(spark):
    """Two words of one component and opposite signs: their text is not empty."""
    seen: dict = {}
    for i in range(10**6):
        h = zlib.crc32(f"w{i}".encode())
        if not (h & 0x80000000) and (other := seen.get((h % 384, 1))) is not None:
            text = f"w{i} {other}"
            break
        seen[h % 384, h >> 31] = f"w{i}"
    df = spark.createDataFrame([(0, text), (1, text + " " + text), (2, ""), (3, None), (4, "...")], "doc_id long, text string")
    norms = {r.doc_id: float(np.linalg.norm(r.embedding)) for r in R.embed(df, "text").collect()}
    assert norms == pytest.approx({0: 1.0, 1: 1.0, 2: 0.0, 3: 0.0, 4: 0.0})


def test_blocks_are_read_without_python_objects():
    """Blocks of vectors come as Arrow rows and are met one by one; ids of any type, slices."""
    rng = np.random.default_rng(3)
    side = lambda n, name: [{"id": f"{name}{i}", "v": rng.standard_normal(4).tolist()} for i in range(n)]
    kind = pa.list_(pa.struct([("id", pa.string()), ("v", pa.list_(pa.float64()))]))
    qs, cs = [side(3, "q"), side(2, "r"), side(4, "s")], [side(9, "c"), side(7, "d"), side(1, "e")]
    rows = pa.RecordBatch.from_arrays([pa.array(qs, kind), pa.array(cs, kind)], ["qs", "cs"]).slice(1)
    got = list(R._top_of_blocks(2)(iter([rows])))
    assert [b.num_rows for b in got] == [4, 4]
    for b, q, c in zip(got, qs[1:], cs[1:]):
        cos = lambda x, y: float(np.dot(x["v"], y["v"]) / np.linalg.norm(x["v"]) / np.linalg.norm(y["v"]))
        want = [(x["id"], y["id"]) for x in q for y in sorted(c, key=lambda y: -cos(x, y))[:2]]
        assert [(r["query_id"], r["vec_id"]) for r in b.to_pylist()] == want
