import random
from collections import defaultdict

import pytest

from pyspark.sql import functions as F

from guidepost.llm import mixing as M


def goals(sizes):
    """Targets by sharing the excess anew until none is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: M.WEIGHTS[i % 3] for i, s in enumerate(names)}
    left, open_, out = M.SHARE * sum(sizes.values()), set(names), {}
    while open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] >= 2 * sizes[s]]
        if not over:
            out |= share
            break
        for s in over:
            out[s] = 2 * sizes[s]
            left -= out[s]
            open_.remove(s)
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_targets_and_copies(spark):
    r = random.Random(3)
    rows = [(i, " ".join("w" for _ in range(int(r.paretovariate(1.1) * 20))), r.choice(["a", "b", "B", "é", None, "z", "a", "a", "a"])) for i in range(4000)]
    rows += [(5000 + i, "same text of five words", "a") for i in range(2000)]
    got = M.mix(frame(spark, rows)).collect()
    source = {i: s for i, _, s in rows}
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for x in got:
        s = source[x.doc_id]
        size[s] += x.size
        taken[s] += x.size * x.copies
        target[s] = x.target
        assert 0 <= x.copies <= 2
    want = goals(size)
    for s in size:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= 0.005 * want[s] + 50
    again = M.mix(frame(spark, rows)).collect()
    assert sorted((x.doc_id, x.copies) for x in got) == sorted((x.doc_id, x.copies) for x in again)


def test_rates_solve_the_dual(spark):
    counts = spark.createDataFrame([("s1", 0.5, 1000), ("s1", 1.5, 3000), ("s2", 1.0, 500), ("s3", 1.0, 0)], "key string, base double, words long")
    target = spark.createDataFrame([("s1", 4000, 2500.0), ("s2", 500, 1000.0), ("s3", 0, 0.0)], "key string, source_size long, target double")
    rate = {(r.key, r.base): r.rate for r in M.rates(counts, target).collect()}
    assert 1000 * rate["s1", 0.5] + 3000 * rate["s1", 1.5] == pytest.approx(2500)
    odds = lambda r: r / (2 - r)  # noqa: E731  tilted by one factor: odds keep their ratio
    assert odds(rate["s1", 1.5]) / odds(rate["s1", 0.5]) == pytest.approx(odds(1.5) / odds(0.5))
    assert rate["s2", 1.0] == 2 and rate["s3", 1.0] == 0


def test_odd_rows(odd_docs, no_docs):
    got = M.mix(odd_docs, carry=["text", "score"]).collect()
    assert len(got) == odd_docs.count()
    for x in got:
        assert x.size == len((x.carried.text or "").encode().split()) and x.copies <= 2 and x.carried.score == "x"
        assert x.size or not x.copies
    assert M.mix(no_docs).count() == 0


def test_no_python_in_the_plan(odd_docs):
    plan = M.mix(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_rows_without_an_id_and_of_one_id_are_spread(spark):
    rows = [(None, "same text", "a")] * 3000 + [(7, f"text {i}", "a") for i in range(3000)]
    df = frame(spark, rows).repartition(4)
    blocks = df.select("doc_id", F.pmod(M.deal_order(F.col("doc_id"), F.col("text")), F.lit(10)).alias("block")).groupBy("doc_id", "block").count().collect()
    assert len(blocks) == 20 and all(200 < r["count"] < 400 for r in blocks)
    got = M.mix(frame(spark, rows + [(i + 10, "one two three", "b") for i in range(2000)])).groupBy("source_size", "target").agg(F.count("*").alias("n"), F.sum(F.col("size") * F.col("copies")).alias("taken")).collect()
    assert sum(r.n for r in got) == 8000 and all(abs(r.taken - r.target) <= 0.005 * r.target + 5 for r in got)
