import random
import re

import pytest
from pyspark.sql import functions as F

from guidepost.operators import dictionary as D


def words(t):
    return [w for w in re.split(r"[^\w]+", (t or "").lower()) if w]


@pytest.mark.parametrize("most", [10**6, 0])
def test_phrases_against_brute_force(spark, monkeypatch, most):
    """Both ways of joining give what a search of every phrase in every text gives."""
    monkeypatch.setattr(D, "BROADCAST_PHRASES", most)
    r = random.Random(1)
    texts = [(i, " ".join(r.choice(["Net", "debt", "ratio,", "of", "Straße", "x_1"]) for _ in range(r.randint(0, 30)))) for i in range(80)] + [(90, None), (91, ""), (None, "net debt")]
    table = [("m", "leverage", "net  DEBT", 2), ("m", "leverage", "debt ratio", 1), ("m", "road", "straße", 3), ("p", "of", "of of of", 4), ("p", "none", "...", 5), ("p", "x", "x_1", 6), ("p", "long", "net debt ratio of", 7)]
    t = spark.createDataFrame(texts, "id long, body string")
    d = spark.createDataFrame(table, "type string, name string, keyword string, ord int")
    want: dict = {}
    for i, body in texts:
        ws = words(body)
        for kind, name, keyword, o in table:
            k = words(keyword)
            n = sum(ws[j : j + len(k)] == k for j in range(len(ws) - len(k) + 1)) if k else 0
            if n and i is not None:
                first, hits = want.get((i, kind, name), ((99, ""), 0))
                want[i, kind, name] = min(first, (o, keyword)), hits + n
    got = {(x.id, x.type, x.name): (x.keyword, x.hits) for x in D.tag_by_table(t, "id", "body", d).collect()}
    assert got == {k: (first[1], hits) for k, (first, hits) in want.items()}
    codes = {x.id: (x.codes, x.first_code) for x in D.detect_by_table(t.where("id is not null"), "id", "body", d.select(F.col("name").alias("code"), F.col("keyword").alias("alias"), "ord")).collect()}
    assert len(codes) == 82 and codes[90] == ([], None)
    assert all(set(c) == {n for i, _, n in want if i == k} and (not c or first == c[0]) for k, (c, first) in codes.items())


def test_aliases_resolve_names(spark):
    aliases = spark.createDataFrame([("acme hotels", "ACME", 3), ("hotels", "ANY", 1), ("the grand bay resort", "BAY", 2), ("-", "BAD", 0)], "alias string, code string, ord int")
    names = spark.createDataFrame([("Acme-Hotels",), ("acme hotels ltd",), ("Grand Bay",), ("bay resorts",), (None,), ("!!",)], "name string")
    got = {x.name: x.resolved for x in D.resolve_by_table(names, "name", aliases).collect()}
    assert got == {"Acme-Hotels": "ACME", "acme hotels ltd": "ANY", "Grand Bay": "BAY", "bay resorts": "bay resorts", None: None, "!!": "!!"}
    assert D.find_phrases(names, "name", "name", aliases.limit(0), "alias").count() == 0


def test_repeated_rows_of_a_dictionary(spark, monkeypatch):
    """Rows that say the same count each, but no text meets each of them, and a large
    dictionary isn't sent to all tasks, however small its files look."""
    t = spark.createDataFrame([(1, "hot bolt, hot bolt"), (2, "cold")], "id long, body string")
    d = spark.range(500).selectExpr("'part' as type", "'bolt' as name", "if(id % 2 = 0, 'hot bolt', 'Hot  Bolt') as keyword", "id + 7 as ord")
    sizes = []
    find = D.find_phrases
    monkeypatch.setattr(D, "find_phrases", lambda *a: (sizes.append(a[3].count()), find(*a))[1])
    assert [tuple(r) for r in D.tag_by_table(t, "id", "body", d).collect()] == [(1, "part", "bolt", "hot bolt", 1000)]
    codes = D.detect_by_table(t, "id", "body", d.selectExpr("name as code", "keyword as alias", "ord")).collect()
    assert {(r.id, tuple(r.codes), r.first_code) for r in codes} == {(1, ("bolt",), "bolt"), (2, (), None)}
    assert sizes == [1, 1]
    monkeypatch.setattr(D, "BROADCAST_PHRASES", 0)
    plan = find(t, "id", "body", d, "keyword")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
