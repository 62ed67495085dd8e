import itertools
import random

from guidepost.llm import jaccard


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def expected(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= 75 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join_components(df).collect()}
    assert got == expected(rows)


def words(r, n):
    return [f"t{r.randint(0, 4000)}" for _ in range(n)]


def test_families_chains_and_passages(spark):
    r = random.Random(11)
    passage, rows = words(r, 60), []
    base = [words(r, n) for n in (4, 6, 9, 14, 40, 52, 60, 90, 300)]
    for b in base:
        for _ in range(14):  # near copies on both sides of the threshold
            w = list(b)
            for _ in range(r.randint(0, max(1, len(b) // 14))):
                w[r.randrange(len(w))] = r.choice(["x1", "x2", "x3"])
            rows.append(" ".join(w))
    chain = words(r, 120)
    for _ in range(25):  # each links with the next, far ones do not
        rows.append(" ".join(chain))
        chain = chain[5:] + words(r, 5)
    for _ in range(60):  # one passage in texts that differ otherwise
        rows.append(" ".join(words(r, r.randint(1, 80)) + passage + words(r, r.randint(1, 20))))
    rows += [rows[0].upper(), rows[40], "", " \n", None, "a b c", "A b\tc", "a b c d"]
    r.shuffle(rows)
    check(spark, list(enumerate(rows)))


def test_threshold_is_exact(spark):
    w = [f"w{i}" for i in range(11)]  # 7 shingles; a longer one has 8 and 9: 7/8 and 7/9 link, 7/10 does not
    rows = [(1, " ".join(w)), (2, " ".join([*w, "a"])), (10, " ".join([*w, "c", "d", "e"])), (20, "p q r s t u v w"), (21, "p q r s t u v"), (22, "p q r s t")]
    check(spark, rows)


def test_one_id_on_two_texts(spark):
    import corpus_pipeline as P

    x, y = (" ".join(f"{c}{i}" for i in range(40)) for c in "xy")
    rows = [(7, x), (7, y), (7, y), (8, x + " more"), (9, y + " more")]
    got = jaccard.join_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in got) == [(7, 36, 7), (7, 36, 7), (7, 36, 7), (8, 37, 7), (9, 37, 7)]
    full = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((r.doc_id, r.text) for r in P.one_of_each_group(spark, full, "").collect()) == [(7, x), (7, y)]


def test_odd_rows(spark, odd_docs, no_docs):
    got = jaccard.join_components(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by = {r.doc_id: (r.n_shingles, r.component_id) for r in got}
    assert by[2] == (0, 2) and by[3] == (0, 3) and by[4] == (0, 4)
    assert by[6] == (1, 6) and by[7] == (1, 6) and by[8] == by[1] == (9, 1) and by[5][0] == 30_011
    assert by[None] == (8, None)
    assert jaccard.join_components(no_docs).count() == 0
