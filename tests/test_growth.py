"""Steps whose time must grow no faster than the rows."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from guidepost.catalog import views as V
from guidepost.functions import values as W
from guidepost.operators import news as N
from guidepost.operators import text as X


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_edit_candidates_are_complete_and_few(spark):
    """long titles of one language don't meet by a chance pair of letters."""
    rng = random.Random(5)
    words = ["".join(chr(97 + int(160 * rng.random() ** 2)) for _ in range(rng.randint(2, 9))) for _ in range(4000)]
    titles = [rng.sample(words, rng.choice([3, 8, 30, 45])) for _ in range(150)]
    for t in titles[:60]:  # near copies: letters dropped, added, changed
        again = list(t)
        for _ in range(rng.randint(1, 1 + len(t) // 6)):
            i = rng.randrange(len(again))
            again[i] = rng.choice([again[i][1:] + "e", again[i] + "s", again[i][:-1]])
        titles.append(again)
    sets = spark.createDataFrame([("d", sorted({w for w in t if w}), i) for i, t in enumerate(titles)], "day string, tokens array<string>, id long")
    tokens = {r["id"]: r["tokens"] for r in sets.collect()}
    near = {(i, j) for i in tokens for j in tokens if i < j and N.token_set_ratio(tokens[i], tokens[j]) >= 92}
    found = {(min(r["id"], r["other"]), max(r["id"], r["other"])) for r in N.candidate_pairs(sets, 92.0).collect()}
    assert len(near) >= 30
    assert near <= found
    edit = N.edit_candidates(sets, 92.0).count()
    assert edit <= 200, edit  # 900 before


def test_ratio_below_a_limit_is_not_counted_to_its_end():
    """as without a limit where the limit is reached, below the limit elsewhere."""
    rng = random.Random(7)
    words = ["alpha", "beta", "betas", "gamma", "x", "y", "growth", "growths", "ab" * 40, "ab" * 38 + "cd"]
    for _ in range(3000):
        a, b = rng.sample(words, rng.randint(0, 8)), rng.sample(words, rng.randint(0, 8))
        full, cut = N.token_set_ratio(a, b), N.token_set_ratio(a, b, 92.0)
        assert cut == full if full >= 92 else cut < 92
    a, b = "abcdefgh" * 500, "hgfedcba" * 500
    assert N._lcs(a, b) < 3000 and N._lcs(a, b, 3900) < 3900


def test_news_reads_the_documents_once(spark, sf):
    """F13, F16: an item and its second report come from one scan."""
    assert _plan(V.news(spark, sf)).count("parquet") == 1


def test_daily_run_judges_items_once(spark, sf):
    """F16: counting what was collected doesn't scan the texts again."""
    from guidepost.catalog.q_news import enriched

    counts = N.daily_run(enriched(spark, sf), "doc_id")[1]
    assert "parquet" not in _plan(counts)
    assert {r["step"] for r in counts.collect()} >= {"collected", "accepted", "keyed", "exact", "fuzzy"}


def test_all_words_of_the_gates_are_found_in_one_pass(spark, sf):
    """F13, F16: the text is not scanned once per word."""
    from guidepost.catalog.q_news import enriched

    plan = _plan(enriched(spark, sf).select("drop_reason", "sentiment"))
    assert "Contains(" not in plan and plan.count("ArrowEvalPython") == 1  # a scan for each of 67 words before
    assert _plan(N.accept(enriched(spark, sf)).select("uid")).count("ArrowEvalPython") == 1


def test_words_found_are_those_in_the_text(spark):
    """F13, F16: every word of the list, each once, wherever it stands."""
    rng = random.Random(11)
    words = ["a", "ab", "ab ", "b a", " b", "", " ", "ba\nb", "bb", "éb", "b  a", "abab", "zz", "bb", "€", "\U0001f600b", "aaaaaaaab"]
    texts = ["".join(rng.choice("aabb  é€\U0001f600\n\0") for _ in range(rng.randint(0, 30))) for _ in range(600)] + ["ab" * 100 + " " + "zz" * 60, "", " "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i int, t string")
    got = {r["i"]: r["f"] for r in df.select("i", X.words_found(F.col("t"), words).alias("f")).collect()}
    assert got[len(texts)] is None and all(got[i] == [w for w in dict.fromkeys(words) if w in t] for i, t in enumerate(texts))


def test_a_summary_that_opens_its_content_is_scanned_once(spark):
    """F13, F16: no word of the whole text is lost or made up at the cuts."""
    rng = random.Random(13)
    words = ["ab", "b a", "a b", "bab", "aa bb", "b\u0001a"]
    make = lambda most: "".join(rng.choice("aAbB ") for _ in range(rng.randint(0, most)))
    rows = []
    for i in range(800):
        content, title = make(40), make(6)
        summary = rng.choice([content, content[: rng.randint(0, 40)], make(30), None])
        rows.append((i, rng.choice([title, None]), summary, rng.choice([content, content, None]), make(3)))
    df = spark.createDataFrame(rows, "i int, title string, summary string, content string, source string")
    scanned, k = {r["i"]: r["t"] for r in df.select("i", N._scanned(words).alias("t")).collect()}, 0
    for i, *parts in rows:
        whole = " ".join(p for p in parts if p is not None).lower()
        assert [w in scanned[i] for w in words] == [w in whole for w in words], parts
        k += len(scanned[i]) < len(whole)
    assert k > 100


def test_summaries_and_signatures_need_a_text_s_start_only(spark):
    """F13, F16: equal to what the whole text gives, however much white space it holds."""
    rng = random.Random(17)
    rows = [(i, "".join(rng.choice([" ", "  ", "\n", "x", "Yz", "İ", "ΑΣ", "w" * 9, " " * rng.choice([1, 400])]) for _ in range(rng.choice([3, 60, 400, 2000])))) for i in range(120)]
    rows += [(900, "q" * 5000), (901, " " * 5000 + "q"), (902, ""), (903, None), (904, "q " * 140), (905, "q " * 141), (906, "x" * 139 + "Σ " + "y" * 3000)]
    whole = F.trim(F.regexp_replace(F.coalesce("t", F.lit("")), r"\s+", " "))
    short = F.when(whole == "", "No summary available from source payload.").when(F.length(whole) <= 280, whole).otherwise(F.concat(F.rtrim(F.substring(whole, 1, 277)), F.lit("...")))
    sign = F.sha1(F.concat(F.lit("title|"), F.substring(F.lower(whole), 1, 140), F.lit("|d")))
    df = spark.createDataFrame(rows, "i int, t string")
    got = df.select("i", W.short_summary(F.col("t")).alias("a"), W.content_signature(F.lit(" Title"), F.col("t"), F.lit("d")).alias("b"), short.alias("c"), sign.alias("d"))
    assert got.count() == len(rows) and got.filter("not (a <=> c and b <=> d)").collect() == []


def test_daily_run_leaves_the_texts_behind(spark, sf):
    """F13, F16: keys and short summaries are drawn as items are judged; no text is dealt."""
    from guidepost.catalog.q_news import enriched

    entries, counts, _missing = N.daily_run(enriched(spark, sf), "doc_id")
    assert not {"summary", "content", "scoring_text"} & set(entries.columns)
    texts = lambda df: [c for c in ("summary#", "content#") if c in _plan(df)]
    assert texts(entries) == texts(counts) == []  # both were stored and dealt before


def test_statements_of_many_companies_are_few_files(spark, sf, tmp_path):
    """a bundle holds what single files hold, without a file per company."""
    from guidepost.catalog.q_io import write_company_statements
    from guidepost.sources import sinks as K
    from guidepost.sources import statements as S

    lines = [(f"C{i}", no, line) for i in range(300) for no, line in [("0", ",Mar 2023,Mar 2024"), ("1", f'Sales +,"1,{i:03d}.5",{i}'), ("1z", ",,"), ("2", "Additional Metrics"), ("3", f"Face Value,{i}"), ("4", "Note é,")]]
    df = spark.createDataFrame(lines, "company_id string, line_no string, line string").repartition(4)
    K.write_statements(df, str(tmp_path / "single"))
    K.write_statements(df, str(tmp_path / "bundle"), bundled=True)
    name = F.regexp_extract("file", r"company_id=([^/]+)/", 1).alias("company")
    rows = lambda d: sorted(tuple(r) for r in d.select(name, *d.columns[1:]).collect())
    for read in (S.read_wide_financials, S.read_additional_metrics):
        single = rows(read(spark, str(tmp_path / "single")))
        assert single and single == rows(read(spark, str(tmp_path / "bundle"), bundled=True))
        # records cut anywhere by the splits of the reader
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
        try:
            assert single == rows(read(spark, str(tmp_path / "bundle"), bundled=True))
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    path = write_company_statements(spark, "/root/testdata/sf0.01")
    files = spark.read.format("binaryFile").load(path + "/*").count()
    assert files <= 16, files  # 100 companies; a file each before


def test_line_items_are_summed_once_for_claims_and_actuals(spark, sf):
    """F17, F19 to F24: claims, actuals and call texts come from one stored sum."""
    from guidepost.catalog.q_promises import call_text
    from guidepost.catalog.q_scoring import deviations

    for df in (call_text(spark, sf), deviations(spark, sf)):
        assert "parquet" not in _plan(df)  # two scans each before


def test_target_period_runs_each_pattern_once(spark):
    """the long patterns stand once, for a text that has their words."""
    from guidepost.operators import promises as M

    rows = [
        ("We see Rs 20 crore in Q2 FY 2026 and FY27.", "Q1 FY25", "Q2 FY26", "explicit"), ("Growth over FY2026-28 and FY31 too.", "Q1 FY25", "FY28", "explicit"),
        ("Done by 2031 at the latest.", "Q1 FY25", "FY31", "explicit"), ("Only 2031 rooms, then two to four years out.", "Q1 FY25", "FY30", "relative"),
        ("THIS FISCAL YEAR we grow.", "Q1 FY25", "FY25", "relative"), ("Next financial year we grow.", "Mar 2024", "FY25", "relative"),
        ("In the coming quarters we grow.", "Q1 FY25", "Unknown", "near_term"), ("In 1.5 years away.", "none", "Unknown", "unknown"), (None, "Q1 FY25", "Unknown", "unknown"),
    ]
    df = spark.createDataFrame(rows, "s string, p string, period string, basis string").withColumn("tp", M.target_period(F.col("s"), F.col("p")))
    assert df.filter("not (tp.period <=> period and tp.basis <=> basis)").collect() == []
    text = df._jdf.queryExecution().analyzed().toString()
    assert text.count("regexp_extract(s#") <= 2  # 16 before


def test_members_are_dealt_before_they_are_compared(spark):
    """no task holds the distinct rows of a share of the input before the shuffle."""
    from guidepost.operators import stats as A

    df = spark.createDataFrame([(g, e, m) for g in (0, 1) for e in range(20) for m in (e % 3, e % 4, e % 3)] + [(0, None, 1), (0, 1, None)], "g int, e int, m int")
    d = A._distinct_members(df, "e", "m", ["g"])
    assert sorted(tuple(r) for r in d.collect()) == sorted({(g, e, m) for g in (0, 1) for e in range(20) for m in (e % 3, e % 4)})
    below = d._jdf.queryExecution().sparkPlan().toString(), d._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in below[1] and "HashAggregate" not in below[1].split("Initial Plan")[-1].split("Exchange", 1)[1]


def test_words_are_searched_by_their_beginnings(monkeypatch):
    """F16: as ``in`` finds them, over the ends of steps and texts; many words cost no pass each."""
    rng = random.Random(19)
    words = [w.encode() for w in ["abab", "ababa", "babab", "abababab", "aababbaba", "ab", "b", "", "bbbbaaaabbbba", "aaaa", "éaba", "abé", "bé b", "zzzzz"]]
    for block in (4, 8, 1 << 20):
        monkeypatch.setattr(X, "SEARCH_BLOCK", block)
        for _ in range(60):
            texts = ["".join(rng.choice("aabbé ") for _ in range(rng.choice([0, 1, 3, 4, 5, 40]))).encode() for _ in range(rng.randint(0, 9))]
            starts = np.cumsum([0, *map(len, texts)])
            got = X._occurrences(np.frombuffer(b"".join(texts), "u1"), starts, words)
            assert got.tolist() == [[w in t for w in words] for t in texts]


def test_gates_read_counts_of_words(spark, sf):
    """F16: one number per list of words, not a search of the found words for each word."""
    from guidepost.catalog.q_news import enriched

    assert "array_contains(found" not in _plan(enriched(spark, sf).select("drop_reason", "sentiment"))  # 69 before
    lists = [["growth", "up"], (), ["up", "up", "no"], ["growth of it"]]
    counts, count = X.word_counts(F.col("t"), lists)
    df = spark.createDataFrame([(0, "growth of it"), (1, "up, no growth"), (2, ""), (3, None)], "i int, t string").select("i", counts.alias("n")).repartition(1)
    got = {r["i"]: tuple(r)[1:] for r in df.select("i", *[count(F.col("n"), ws).alias(f"c{k}") for k, ws in enumerate(lists)]).collect()}
    assert got == {0: (1, 0, 0, 1), 1: (2, 0, 3, 0), 2: (0, 0, 0, 0), 3: (None, 0, None, None)}


def test_a_sigma_at_a_cut_is_lowered_as_in_the_whole_text(spark):
    """F16: what follows a capital sigma decides on its lower case."""
    words = ["ας", "ασ", "xy"]
    rows = [("T", "yyyyyyyyΑΣ", "yyyyyyyyΑΣΑ"), ("T", "ΑΣΑyyyyyyyy", "ΑΣΑyyyyyyyyy"), ("ΑΣ", "yyyyyyyyx", "yyyyyyyyxyΑΣ")]
    df = spark.createDataFrame([(i, *r, "s") for i, r in enumerate(rows)], "i int, title string, summary string, content string, source string")
    whole = F.concat_ws(" ", *[F.lower(c) for c in ("title", "summary", "content", "source")])
    for r in df.select(N._scanned(words).alias("a"), whole.alias("b")).collect():
        assert [w in r["a"] for w in words] == [w in r["b"] for w in words]


def test_the_length_of_a_title_is_taken_once(spark):
    """F16: not again for each of its tokens, which grows as the square of a title."""
    sets = spark.createDataFrame([("d", ["a", "b"], 1), ("d", ["a", "c"], 2)], "day string, tokens array<string>, id long")
    plan = _plan(N.containment_candidates(sets, 0.9))
    assert plan.index("Generate explode(tokens") < plan.index("aggregate(tokens")  # above the explode before
    assert {(r["id"], r["other"]) for r in N.containment_candidates(sets, 0.9).collect()} == {(1, 2), (2, 1)}


def test_candidates_meet_by_one_number(spark):
    """F16: words and letter pairs of a day are joined and sorted by one hash, not by two
    strings; items of two days still don't meet."""
    rows = [(f"d{i % 3}", sorted(t.split()), i) for i, t in enumerate(["alpha beta", "alpha beta gamma", "alpha betas", "alpha beta", "alpha beta gamma", "gammas x", "delta"])]
    sets = spark.createDataFrame([*rows, (None, ["alpha", "beta"], 90), (None, ["alpha", "betas"], 91)], "day string, tokens array<string>, id long")
    day = {i: d for d, _, i in rows}
    for found in (N.containment_candidates(sets, 0.2), N.edit_candidates(sets, 80.0)):
        joins = [x for x in _plan(found).splitlines() if "Join Inner" in x and re.search(r"(token|gram)#", x)]
        assert joins and not any(re.search(r"day#\d+ = ", x) for x in joins)  # joined by day and string before
        assert all(r["id"] in day and day[r["id"]] == day[r["other"]] == r["day"] for r in found.collect())
    sets = spark.createDataFrame([("a", ["up", "x"], 1), ("a", ["up"], 2), ("b", ["up"], 3)], "day string, tokens array<string>, id long")
    assert {(r["day"], r["id"], r["other"]) for r in N.containment_candidates(sets).collect()} == {("a", 2, 1)}
