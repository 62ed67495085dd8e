import random
from collections import Counter

from guidepost.llm import quality_rules as Q


def brute(text):
    raw = (text or "").encode()
    w = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(windows)
    hit = {i + k for i, x in enumerate(windows) if n[x] > 1 for k in range(5)}
    return len(w), sum(len(x.decode()) for x in w), sum((text or "").count(s) for s in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def test_facts_against_brute_force():
    r = random.Random(2)
    for _ in range(500):
        t = "".join(r.choice(["a", "bé", " ", " ", "\n", "#", "\t", "a b a b a b "]) for _ in range(r.randint(0, 60)))
        assert Q.text_facts(t.encode()) == brute(t)


def test_buckets_hold_their_bounds(spark):
    from pyspark.sql import functions as F

    for v, b in ((r.v, r.b) for r in spark.range(0, 200_000, 37).select(F.col("id").alias("v"), Q.bucket(F.col("id")).alias("b")).collect()):
        assert b <= v < max(b + 1, b * 33 / 32 + 1) and (v >= 64 or b == v)


def test_merged_sketches_are_the_sketch_of_all(spark):
    from pyspark.sql import functions as F

    rows = [(i, "en" if i % 3 else None, f"s{i % 5}", 20 + i % 50, 100 + 7 * i % 90, i % 13, i % 2, i % 4) for i in range(900)]
    f = spark.createDataFrame(rows, "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long")
    whole = Q.sketches(f.withColumns({"lang": F.lit("x"), "source": F.lit("y")})).select("measure", "b", "n")
    parts = Q.sketches(f).groupBy("measure", "b").agg(F.sum("n").alias("n"))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.collect()))


def test_junk_goes_and_clean_text_stays(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9)))
    rows = []
    for i in range(400):
        w = [word() for _ in range(80)]
        rows.append((i, " ".join(w if i % 4 else [x + "###" for x in w]), "en", f"s{i % 2}"))
    got = {x.doc_id: x.kept for x in Q.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert got == {i: bool(i % 4) for i in range(400)}


def test_limits_follow_the_habits_of_a_source(spark):
    """A source where a third of the documents carry many signs gets another limit than
    one that has none, on both sides of the size from which sources have their own."""
    r = random.Random(4)
    rows = []
    for i in range(1600):
        w = [f"word{r.randint(0, 999)}" for _ in range(100)]
        if i % 4 == 0 and i % 3 == 0:  # every third of source code
            w = [x + "#" * (k % 5 == 0) for k, x in enumerate(w)]
        elif i % 97 == 1:
            w = [x + "##" for x in w]
        rows.append((i, " ".join(w), "en", "code" if i % 4 == 0 else "plain"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    lim = {x.source: x.symbols_most for x in Q.limits(Q.sketches(Q.facts(docs))).collect()}
    assert lim["plain"] == 80 and lim["code"] == 4 * (200 + 20)
    kept = {x.doc_id: x.kept for x in Q.judge(docs).collect()}
    assert all(kept[i] == (i % 97 != 1 or i % 12 == 0) for i in kept)
    few = docs.where("doc_id < 700 or source = 'plain'")  # 175 of source code
    lim = {x.source: x.symbols_most for x in Q.limits(Q.sketches(Q.facts(few))).collect()}
    assert lim["code"] == lim["plain"] == 80


def test_odd_rows(odd_docs, no_docs):
    got = Q.judge(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by = {r.doc_id: r for r in got}
    assert by[2].base_failed and not by[2].kept and by[3].n_words == by[4].n_words == 0
    assert by[5].n_words == 60_000 and by[1].kept and by[None].kept
    assert Q.judge(no_docs).count() == 0
