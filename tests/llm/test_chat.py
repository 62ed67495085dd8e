import random

from pyspark.sql import functions as F

from guidepost.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def read_back(df):
    got = chat.format_conversations(df)
    return {r.conv_id: r for r in got.select("*", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}


def test_everything_comes_back(spark):
    r = random.Random(4)
    parts = ["###", "\\", "</turn>", "<turn/>", "\n", "### assistant:\n", "a", "é😀", " ", ":", "<", "#"]
    rows = [(c, t, r.choice(["user", "assistant", "system", "", "a:\nb", "x\\"]), "".join(r.choices(parts, k=r.randint(0, 9)))) for c in range(150) for t in range(r.randint(1, 9))]
    r.shuffle(rows)
    got = read_back(spark.createDataFrame(rows, SCHEMA))
    for c in range(150):
        own = sorted(x[1:] for x in rows if x[0] == c)
        assert [(t.role, t.text) for t in got[c].turns] == [x[1:] for x in own]
        assert got[c].loss == "".join(x[2] for x in own if x[1] == "assistant")


def test_adjacent_turns_merge(spark):
    got = read_back(spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "assistant", "b")], SCHEMA))[1]
    assert got.formatted == "### user:\nq\n</turn>\n### assistant:\na\n<turn/>\nb\n</turn>\n"
    assert [got.formatted[s.start : s.start + s.len] for s in got.loss_spans] == ["a", "b"]


def test_odd_rows(spark):
    long = "x\\" * 200_000
    rows = [(1, None, "user", "first"), (1, 3, None, None), (1, 3, "user", "b"), (1, 3, "user", "a"), (1, 3, "user", "a"), (None, 1, "assistant", "lone"), (None, None, None, None), (2, 1, "assistant", long)]
    got = read_back(spark.createDataFrame(rows, SCHEMA).select("*", F.lit(1).alias("formatted"), F.lit(2).alias("t")))
    assert [(t.role, t.text) for t in got[1].turns] == [("user", "first"), ("", ""), ("user", "a"), ("user", "a"), ("user", "b")]
    assert got[None].loss == "lone" and got[2].loss == long
    assert chat.format_conversations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = chat.format_conversations(spark.createDataFrame([(1, 1, "user", "a")], SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
