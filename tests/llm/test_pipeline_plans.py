"""What the pipeline's stages shuffle, sort and do again."""

import re

from guidepost.llm import bpe, mixing, toxicity


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_mix_shuffles_texts_once(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = mixing.mix(docs, carry=docs.columns)
    plan = executed(got)
    assert len(re.findall(r"[^t]Exchange ", plan)) == 1 and "SortMergeJoin" not in plan
    assert "regexp" not in plan  # words are counted before


def test_carried_rows_get_the_same_copies(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = lambda df: sorted(tuple(r) for r in df.select("doc_id", "size", "copies").collect())
    got = mixing.mix(docs, carry=docs.columns)
    assert rows(got) == rows(mixing.mix(docs))
    assert got.where("carried.doc_id <> doc_id or carried.text is null").count() == docs.where("text is null").count()


def test_scorer_meets_a_word_once(monkeypatch):
    asked = []
    values = toxicity.word_values
    monkeypatch.setattr(toxicity, "word_values", lambda marks, sets: asked.append(set().union(*sets)) or values(marks, sets))
    model = (["idiot", "moron"], 2, [1.0, 1.0], -1.0, 1.0, 0.0)
    texts = [b"an idiot. the idiots there", b"the moron and an idiot\nthere", b""]
    s = toxicity.Scorer(*model)
    first = s.scores(texts)
    again = s.scores([*texts, b"the other moron"])
    assert asked[-1] == {b"other"}
    assert (again[:3] == first).all() and (again == toxicity.Scorer(*model).scores([*texts, b"the other moron"])).all()


def test_sentence_values():
    value = {w: v for w, v in zip((b"idiot", b"idiot.", b"moron"), ([1, 0], [2, 0], [0, 3]))}
    said = lambda t: [list(map(int, v)) for v in toxicity.sentence_values(t, set(t.split()), value)]
    assert said(b"an idiot or moron there. an idiot ?! the moron") == [[1, 3], [1, 0], [0, 3]]
    assert said(b"idiot moron\nmoron") == [[1, 3], [0, 3]]
    assert said(b"an idiot. moron") == [[0, 3], [2, 0]]  # without the sign it is no word of this text
    assert said(b"an idiot.") == [[2, 0]]
    assert said(b"of him") == []


def test_copies_are_encoded_once(bpe_path):
    asked = []

    class Counting(bpe.Codec):
        def encode(self, texts):
            asked.append(list(texts))
            return super().encode(texts)

    texts = [b"one two", b"", b"one two", b"three", b""]
    got = bpe._read_back(Counting(bpe_path), texts)
    assert asked == [[b"one two", b"", b"three"]]
    one_by_one = [bpe._read_back(bpe.codec(bpe_path), [t]) for t in texts]
    assert got["decoded"].to_pylist() == [t.decode() for t in texts]
    assert got["ids"].to_pylist() == [x["ids"][0].as_py() for x in one_by_one]
