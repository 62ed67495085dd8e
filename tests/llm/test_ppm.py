import collections
import math
import random
import zlib

import pytest

from guidepost.llm import ppm


def brute(train, tests):
    """Scores by walking the contexts of every byte."""
    seen = [collections.defaultdict(collections.Counter) for _ in range(ppm.ORDER + 1)]
    words = collections.Counter()
    line = lambda t: b"\n" * ppm.ORDER + b" ".join((t or "").encode().lower().split()) + b"\n"
    for t in train:
        words.update([*(t or "").encode().lower().split(), b"\n"])
        b = line(t)
        for j in range(ppm.ORDER, len(b)):
            for k in range(ppm.ORDER + 1):
                seen[k][b[j - k : j]][b[j]] += 1
    N, V, out = sum(words.values()), len(words), []
    for t in tests:
        b, s = line(t), 0.0
        for j in range(ppm.ORDER, len(b)):
            out_of = set()
            for k in range(ppm.ORDER, -1, -1):
                live = {y: n for y, n in seen[k].get(b[j - k : j], {}).items() if y not in out_of}
                if b[j] in live:
                    s += math.log10((live[b[j]] - 0.5) / sum(live.values()))
                    break
                if live:
                    s += math.log10(0.5 * len(live) / sum(live.values()))
                out_of |= set(seen[k].get(b[j - k : j], ()))
            else:
                s -= math.log10(256 - len(out_of))
        w = [*(t or "").encode().lower().split(), b"\n"]
        out.append((len(w), sum(x in words for x in w), N, sum(math.log10((words[x] + 1) / (N + V + 1)) for x in w), s))
    return out


@pytest.mark.parametrize("top", [0, 5, 10_000])
def test_against_brute_force(spark, monkeypatch, top):
    monkeypatch.setattr(ppm, "TOP_WORDS", top)
    r = random.Random(8)
    rows = [(i, " ".join(r.choice(["the", "of", "Tha", "thé", f"n{r.randint(0, 99)}", "\n"]) for _ in range(r.randint(0, 25)))) for i in range(150)] + [(500, None), (501, ""), (502, "x" * 3000)]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    got = {x.doc_id: x for x in ppm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute([t for i, t in rows if not held(i)], [t for _, t in rows])
    for (i, _), (n, known, total, base, score) in zip(rows, want):
        x = got[i]
        assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (held(i), n, known, total)
        assert x.base_score == pytest.approx(base) and x.score == pytest.approx(score, rel=1e-6)


def test_predictions_of_a_context_sum_to_one():
    import numpy as np

    keys, n = np.unique(ppm.grams([b"abracadabra", b"abba", b"cab"])[0], return_counts=True)
    entries = []
    for k in range(ppm.ORDER + 1):
        own, at = np.unique(keys & np.uint64((1 << (8 * (k + 1))) - 1), return_inverse=True)
        entries.append((own, np.bincount(at, weights=n)))
    trie = ppm.Trie(entries)
    for ctx in (b"zzzabra"[-ppm.ORDER :], b"zzzzzzab"[-ppm.ORDER :], b"zzzzzzz"[: ppm.ORDER], b"\n" * ppm.ORDER):
        base = int.from_bytes(ctx, "big") << 8
        p = 10 ** trie.log10(np.array([base + s for s in range(256)], np.uint64))
        assert p.sum() == pytest.approx(1, abs=1e-5)


def test_small_capacity_keeps_contexts_nested(spark, monkeypatch):
    monkeypatch.setattr(ppm, "MAX_ENTRIES", 40)
    rows = [(i, "abra cadabra " * (i % 5 + 1)) for i in range(40)]
    got = ppm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(math.isfinite(x.score) and x.score < 0 for x in got)


@pytest.mark.parametrize("most", [0, 60])
def test_no_entry_is_cut(spark, monkeypatch, most):
    monkeypatch.setattr(ppm, "MAX_ENTRIES", most)
    r = random.Random(9)
    rows = [(i, " ".join(r.choice(["the", "of", "thé", f"n{r.randint(0, 99)}"]) for _ in range(r.randint(0, 12)))) for i in range(80)] + [(500, None), (501, "Ж seen once"), (502, "zq" * 40)]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    got = {x.doc_id: x.score for x in ppm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute([t for i, t in rows if not held(i)], [t for _, t in rows])
    for (i, _), w in zip(rows, want):
        assert got[i] == pytest.approx(w[-1], rel=1e-6)


def test_odd_rows(odd_docs, no_docs):
    got = ppm.score(odd_docs).collect()
    assert len(got) == odd_docs.count() and all(math.isfinite(x.score) for x in got)
    assert {x.doc_id: x.n_tokens for x in got}[2] == 1
    assert ppm.score(no_docs).count() == 0
