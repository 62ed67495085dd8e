import random

from tokenizers import Tokenizer

from guidepost.llm import token_counts as T
from guidepost.llm.bpe import codec

ALPHABET = "abz Zq'sreT \n\t \u00a0\u3000\u2009é😀1 2!.,-'\x1c\x85dollvem"


def applied(s, start, end, new):
    cut = []
    for q in (min(max(start, 0), len(s)), min(max(end, 0), len(s))):
        while 0 < q < len(s) and s[q] & 0xC0 == 0x80:
            q -= 1
        cut.append(q)
    return s[: cut[0]] + new + s[max(cut) :]


def test_edits_against_full_encoding(bpe_path, monkeypatch):
    monkeypatch.setattr(T, "LEAF", 3)
    c, ref, r = codec(bpe_path), Tokenizer.from_file(bpe_path), random.Random(3)
    text = lambda n: "".join(r.choice(ALPHABET) for _ in range(r.randint(0, n))) + ("<|endoftext|>" if r.random() < 0.05 else "")
    for _ in range(400):
        s = text(80).encode()
        tree = T.trees([s], c)[0]
        for _ in range(4):
            start = r.randint(0, len(s) + 3)
            end, new = start + r.randint(0, 10), text(8).encode()
            s = applied(s, start, end, new)
            tree.edit(start, end, new, c)
            assert b"".join(tree.leaves) == s and tree.total == len(ref.encode(s.decode(), add_special_tokens=False).ids)
            assert [int(x.sum()) for x in tree.tokens] == [tree.total] * len(tree.tokens)


def test_only_the_region_is_encoded_again(bpe_path):
    c = codec(bpe_path)
    s = b" ".join(b"word%d" % i for i in range(50_000))
    tree = T.trees([s], c)[0]
    tree.edit(200_000, 200_010, b"new words here", c)
    assert 0 < tree.encoded < 2_000


def test_odd_rows(spark, odd_docs, no_docs, bpe_path):
    ref = Tokenizer.from_file(bpe_path)
    edits = spark.createDataFrame([(1, 1, 4, 9, "slow"), (1, 2, 0, 0, "So, "), (2, 1, 0, 5, "x"), (3, 1, None, None, None), (99, 1, 0, 1, "y"), (None, 1, 0, 1, "z"), (6, 1, 0, 10**6, None)], "doc_id long, seq int, start int, end int, new string")
    kept = T.build(odd_docs, bpe_path)
    got = T.recount(kept, edits, bpe_path).collect()
    assert len(got) == odd_docs.count()
    for x in got:
        assert x.n_after == len(ref.encode(x.text.decode(), add_special_tokens=False).ids) and x.n_bytes == len(x.text)
    by = {x.doc_id: x for x in got}
    assert by[1].text.startswith(b"So, the slow brown") and by[2].text == b"x" and by[6].text == b"" and by[3].n_after == 0
    assert by[5].n_before == by[5].n_after and by[5].n_encoded == 0
    assert T.recount(T.build(no_docs, bpe_path), edits, bpe_path).count() == 0


def test_kept_trees_take_batch_after_batch(spark, bpe_path, tmp_path):
    """Stored trees are edited twice; each batch encodes only its own regions."""
    ref, r = Tokenizer.from_file(bpe_path), random.Random(6)
    texts = {i: " ".join(f"w{r.randint(0, 9999)}" for _ in range(r.choice([0, 3, 4000]))) for i in range(30)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    T.build(docs, bpe_path).write.parquet(f"{tmp_path}/0")
    for batch in (1, 2):
        edits = [(i, s, r.randint(0, 9000), 0, f" new {s} ") for i in texts if i % 3 == batch for s in (1, 2)]
        edits = [(i, s, at, at + 5, new) for i, s, at, _, new in edits]
        kept = spark.read.parquet(f"{tmp_path}/{batch - 1}").select("doc_id", "text", "lengths", "tokens", "n_built")
        T.recount(kept, spark.createDataFrame(edits, "doc_id long, seq int, start int, end int, new string"), bpe_path).write.parquet(f"{tmp_path}/{batch}")
        for i, _, start, end, new in edits:
            texts[i] = applied(texts[i].encode(), start, end, new.encode()).decode()
        got = spark.read.parquet(f"{tmp_path}/{batch}").collect()
        assert {x.doc_id: x.text.decode() for x in got} == texts
        for x in got:
            assert x.n_after == sum(x.tokens) == len(ref.encode(texts[x.doc_id], add_special_tokens=False).ids)
            assert sum(x.lengths) == x.n_bytes == len(x.text)
            assert x.n_encoded < 2_500 and (x.n_encoded > 0) == (x.doc_id % 3 == batch)
