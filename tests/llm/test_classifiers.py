import random

import numpy as np

from guidepost.llm import quality_classifier as Q
from guidepost.llm import toxicity as T


def corpus(n, seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["th", "er", "on", "an", "re", "in", "st"]) for _ in range(r.randint(1, 4)))
    rows = []
    for i in range(n):
        w = [word() for _ in range(r.randint(15, 60))]
        good = i % 3 != 0
        toxic = good and i % 4 == 0
        for _ in range(2 * toxic):
            w.insert(r.randrange(len(w)), r.choice(["idiot", "moron", "scumbag", "clownish", "clown"]))
        if not good:
            w = [w[0]] * 12 + w[:3] if r.random() < 0.5 else [x + "$$$" for x in w]
        rows.append((i, ". ".join(" ".join(w[k : k + 8]) for k in range(0, len(w), 8)), int(good), int(toxic)))
    return rows


def frames(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int")
    return df.select("doc_id", "text"), df.select("doc_id", "quality", "toxic")


def test_held_out_accuracy(spark):
    rows = corpus(700, 1)
    docs, labels = frames(spark, rows)
    fresh = spark.createDataFrame([(x[0], x[1]) for x in corpus(200, 2)], "doc_id long, text string")
    want = {x[0]: x for x in corpus(200, 2)}
    good = Q.score(fresh, Q.train(docs, labels)).collect()
    assert np.mean([(x.score >= 0.3) == want[x.doc_id][2] for x in good]) > 0.95
    bad = T.score(fresh, T.train(docs, labels)).collect()
    assert np.mean([(x.score >= 0.3) == want[x.doc_id][3] for x in bad]) > 0.95


def test_gaps_and_inserted_characters():
    rows = corpus(800, 3)
    r = T.fit([x[1].encode() for x in rows], [x[3] for x in rows])
    s = T.Scorer(*(r[k][0] for k in ("landmarks", "toxic", "weights", "bias", "slope", "offset")))
    tell = lambda t: s.scores([t.encode()])[0]
    for t in ("theron an idiot", "an i d i o t in there", "an i.d.i.o.t, there", "an id-iot there", "an 1diot there", "IDIOT", "idiots there"):
        assert tell(t) >= 0.3, t
    for t in ("", "   ", "there in the stone", "id", "theron anther i d there"):
        assert tell(t) < 0.3, t


def test_all_scripts_three_letters_and_rare_insults():
    """Landmarks cover the toxic documents: short and rare insults, and those of any script."""
    r = random.Random(8)
    rows = [(i, t, 0) for i, t, _, _ in corpus(900, 5)]
    insults = ["idiot"] * 12 + ["дурак", "zzq", "ηλίθιος"] * 2 + ["vagabund"]
    for k in range(1, 900, 3):
        w = rows[k][1].split()
        for word in ["idiot"] * (k % 2) or [r.choice(insults)]:
            w.insert(r.randrange(len(w)), word)
        rows[k] = (k, " ".join(x for x in w if x.strip(".") not in ("idiot", "moron", "scumbag", "clownish", "clown") or x in insults), 1)
    rows = [x for x in rows if x[2] or not any(b in x[1] for b in ("idiot", "moron", "scum", "clown"))]
    fit = T.fit([x[1].encode() for x in rows], [x[2] for x in rows])
    s = T.Scorer(*(fit[k][0] for k in ("landmarks", "toxic", "weights", "bias", "slope", "offset")))
    tell = lambda t: s.scores([t.encode()])[0]
    for t in ("theron дурак an", "ДУРАКИ in there", "the д у р а к", "an zzq there", "ZZQ!", "ηλιθιος an", "an idi\u043et there", "vagabund", "\U0001d422\U0001d41d\U0001d422\U0001d428\U0001d42d"):
        assert tell(t) >= 0.3, (t, fit["landmarks"])
    for t in ("theron an there", "the дом in", "an zz there", "笨蛋", "\x00 \U0010ffff"):
        assert tell(t) < 0.3, t


def test_classes_are_weighed_by_their_rate():
    rows = corpus(600, 9)
    texts, y = [x[1].encode() for x in rows], [x[3] for x in rows]
    share = lambda rate: np.mean(T.Scorer(*(T.fit(texts, y, rate)[k][0] for k in ("landmarks", "toxic", "weights", "bias", "slope", "offset"))).scores([b"", b"clownery", b"idioms"]))
    assert share(0.02) <= share(0.5)


def test_kernel_against_brute_force():
    import itertools

    def brute(a, b):
        return sum(T.DECAY ** (i[-1] - i[0] + 1 + j[-1] - j[0] + 1) for i in itertools.combinations(range(len(a)), T.ORDER) for j in itertools.combinations(range(len(b)), T.ORDER) if [a[k] for k in i] == [b[k] for k in j])

    r = np.random.default_rng(0)
    pairs = [(r.integers(1, 4, r.integers(0, 8)), r.integers(1, 4, r.integers(0, 7))) for _ in range(60)]
    got = T.pair_kernel(T.padded([a for a, _ in pairs], 9), T.padded([b for _, b in pairs], 9))
    assert np.allclose(got, [brute(a.tolist(), b.tolist()) for a, b in pairs], rtol=1e-4, atol=1e-6)


def test_features_do_not_depend_on_the_batch():
    texts = [b"a bc  def\n", b"", b"word", b" x y x ", "é ü".encode()]
    whole, at = Q.features(texts)
    for k, t in enumerate(texts):
        assert sorted(whole[at == k]) == sorted(Q.features([t])[0])


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 1), (5, 1, None), (2, 0, 1), (77, 1, 1), (8, 1, 0)], "doc_id long, quality int, toxic int")
    for model, op in ((Q.train(odd_docs, labels), Q), (T.train(odd_docs, labels), T)):
        got = op.score(odd_docs, model).collect()
        assert len(got) == odd_docs.count() and all(0 <= x.score <= 1 for x in got)
        assert op.score(no_docs, model).count() == 0
    none = labels.limit(0)
    assert all(0 < x.score < 1 for x in Q.score(odd_docs, Q.train(odd_docs, none)).collect())
    assert all(0 < x.score < 1 for x in T.score(odd_docs, T.train(odd_docs, none)).collect())
