import duckdb
from pyspark.sql import functions as F

from guidepost.catalog import q_text as Q
from guidepost.operators import text as T


def test_openers_that_follow_each_other(spark):
    """A long sentence is cut before every opener, in Spark and in SQL: also before one
    that directly follows another, and at any white space."""
    tail = "one two three four five six seven eight nine ten"
    long = "x" * 1300
    rows = [
        (1, f"{long} This This {tail}"), (2, f"{long} We This We\nBy {tail} The company Our {tail}"), (3, f"{long} Our\t\n We {tail} Atlas By, {tail}"),
        (4, f"{long} We² {tail} At_ {tail} The  company\nWe {tail}"), (5, f"This This {tail}"), (6, None), (7, f"{long} {tail} At\nBy"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.sentence) for r in T.sentences(df).select("doc_id", F.col("sentence")).collect())
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert sorted(con.execute(Q._SENT).fetchall()) == got
    assert [s for d, s in got if d == 1] == [f"This {tail}"] and (5, f"This This {tail}") in got
