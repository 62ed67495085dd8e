import random

from tokenizers import Tokenizer

from guidepost.llm import bpe

ALPHABET = "abz Zq'sreT \n\t \u00a0\u3000\u2009é😀1 2!.,-'\x1c\x85dollvem"


def texts(n, seed=5):
    r = random.Random(seed)
    out = ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 60))) for _ in range(n)]
    return out + ["", "<|endoftext|>", "a <|endoftext|>  b<|endoftext|>", "   x", "x   ", "x" * 5000, "<|endoftext", "don't we'll I'D"]


def test_same_as_the_library(bpe_path):
    c, ref = bpe.codec(bpe_path), Tokenizer.from_file(bpe_path)
    ts = texts(4000)
    ids, at = c.encode([t.encode() for t in ts])
    want = [ref.encode(t, add_special_tokens=False).ids for t in ts]
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == want
    assert c.decode(ids, at) == [ref.decode(w, skip_special_tokens=False) for w in want] == ts


def test_forgetting_changes_nothing(bpe_path, monkeypatch):
    c = bpe.Codec(bpe_path)
    monkeypatch.setattr(bpe, "CACHE_FRAGMENTS", 10)
    ts = [t.encode() for t in texts(300, 6)]
    whole = bpe.codec(bpe_path).encode(ts)[0].tolist()
    assert [i for t in ts for i in c.encode([t])[0].tolist()] == whole


def test_cuts_are_where_no_token_holds_the_pair(bpe_path):
    c = bpe.codec(bpe_path)
    buf, starts, _ = c.fragments([b"the end of words"])
    assert [buf[s:e] for s, e in zip(starts, [*starts[1:], len(buf)])] == [b"the", b" end", b" of", b" words"]


def test_broken_ids_decode(bpe_path, spark):
    df = spark.createDataFrame([(1, [50256, 64]), (2, None), (3, [-5, 99999]), (4, []), (5, [220, 50255, 187])], "doc_id long, ids array<int>")
    got = {r.doc_id: r.decoded for r in bpe.decode(df, bpe_path).collect()}
    ref = Tokenizer.from_file(bpe_path)
    assert got == {1: "<|endoftext|>a", 2: "", 3: "", 4: "", 5: ref.decode([220, 50255, 187], skip_special_tokens=False)}


def test_odd_rows(odd_docs, no_docs, bpe_path):
    both = bpe.round_trip(odd_docs, bpe_path).collect()
    src = odd_docs.collect()
    assert len(both) == len(src)
    assert sorted((r.doc_id or 0, r.decoded) for r in both) == sorted((r.doc_id or 0, r.text or "") for r in src)
    apart = bpe.decode(bpe.encode(odd_docs, bpe_path), bpe_path).collect()
    assert sorted(r.decoded for r in apart) == sorted(r.decoded for r in both)
    assert bpe.digests(bpe.round_trip(no_docs, bpe_path)).count() == 0
