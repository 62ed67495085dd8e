"""Quality classifier on supervised subword embeddings.

A document is the average of learned vectors of its words, of pairs of adjacent words
(equal words share one pair feature) and of the character n-grams in words (bytes,
words with their bounds), all hashed into one table; a softmax over two classes follows. The vectors are learned together with the softmax by
stochastic gradient descent in numpy, on a bounded sample of labelled documents.

Since the average goes through one linear layer, scoring needs one number per bucket:
the difference of the two classes' logits. Text is worked on in vectorised steps; every
byte of a text counts. A null or empty text, or one of white space, has only the bias.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guidepost.llm.common import holds, text_scores, utf8
from guidepost.llm.labels import trained_in_one_task, training_rows

BITS = 17
DIM = 12
GRAMS = (3, 4)
#: Most labelled documents that are trained on.
MAX_TRAINING_ROWS = 3000
#: Steps of gradient descent, and the share of the learning rate at the start.
UPDATES = 15_000
RATE = 0.5

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: A pair of equal words, whatever the word.
_SAME = np.uint64(0x5851F42D4C957F2D)


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    out = []
    for x in (int(_ODD), pow(int(_ODD), -1, 1 << 64)):
        p = np.full(n, x, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


holds(__name__, _powers.cache_clear)


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of all features of the texts, and the text that each belongs to."""
    buf = b" " + b" ".join(texts) + b" "
    b = np.frombuffer(buf, np.uint8)
    space = _SPACE[b]
    b = np.where(space, np.uint8(32), b)
    lengths = np.array([len(t) + 1 for t in texts], np.int64)  # with the space after it
    if len(texts):
        lengths[0] += 1  # and the one before the first
    text_at = np.repeat(np.arange(len(texts)), lengths)  # of each byte
    shift = np.uint64(64 - BITS)
    out, at = [], []
    for n in GRAMS:
        m = len(b) - n + 1
        if m <= 0:
            continue
        ok = ~space[1 : m + 1]
        for k in range(2, n - 1):
            ok &= ~space[k : m + k]
        i = np.flatnonzero(ok)
        code = np.full(len(i), n, np.uint64)
        for k in range(n):
            code = (code << np.uint64(8)) | b[i + k]
        out.append(((code * _ODD) >> shift).astype(np.int32))
        at.append(i + 1)
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    s, e = edge[::2], edge[1::2]
    if len(s):
        power, back = _powers(1 << int(len(b)).bit_length())
        total = np.concatenate([[np.uint64(0)], np.cumsum((b.astype(np.uint64) + np.uint64(7)) * power[: len(b)])])
        word = (total[e] - total[s]) * back[s]  # the same wherever the word stands
        word = (word ^ (word >> np.uint64(29))) * _ODD
        out.append((word >> shift).astype(np.int32))
        at.append(s)
        owner = text_at[s]
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        pair = np.where(word[1:] == word[:-1], _SAME, word[:-1] * np.uint64(31) + word[1:])[inside]
        out.append(((pair * _ODD) >> shift).astype(np.int32))
        at.append(s[1:][inside])
    if not out:
        return np.empty(0, np.int32), np.empty(0, np.int64)
    return np.concatenate(out), text_at[np.concatenate(at)]


def fit(texts: list[bytes], y: list[int], seed: int = 7) -> dict:
    """Vectors, softmax weights and bias by stochastic gradient descent."""
    rng = np.random.default_rng(seed)
    E = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    W = np.zeros((2, DIM), np.float32)
    rate = np.bincount(y, minlength=2) + 0.5 if len(y) else np.ones(2)
    bias = np.log(rate / rate.sum()).astype(np.float32)
    bags = []
    for t in texts:
        f, _ = features([t])
        ids, n = np.unique(f, return_counts=True)
        bags.append((ids, (n / max(n.sum(), 1)).astype(np.float32)))
    usable = [i for i, (ids, _) in enumerate(bags) if len(ids)]
    done = 0
    while usable and done < UPDATES:
        for i in rng.permutation(usable):
            ids, share = bags[i]
            lr = RATE * (1 - done / UPDATES)
            v = share @ E[ids]
            z = W @ v + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            grad = p @ W
            W -= lr * np.outer(p, v)
            bias -= 0.1 * lr * p
            E[ids] -= (lr * 20 * share)[:, None] * grad
            done += 1
            if done >= UPDATES:
                break
    return {"vectors": [E.tobytes()], "weights": [W.astype(np.float32).tobytes()], "bias": [bias.astype(np.float32).tobytes()], "rows": [len(y)]}


class Model:
    def __init__(self, vectors: np.ndarray, weights: np.ndarray, bias: np.ndarray):
        self.vectors, self.weights, self.bias = vectors, weights, bias
        self.logit = (vectors @ (weights[1] - weights[0])).astype(np.float32)
        self.base = float(bias[1] - bias[0])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, held_fold: int = 0, max_rows: int = MAX_TRAINING_ROWS) -> Model:
    rows = training_rows(docs, labels, label, folds, held_fold, max_rows, balanced=False)
    got = trained_in_one_task(rows, fit, "vectors binary, weights binary, bias binary, rows long")
    r = got[0] if got else {k: v[0] for k, v in fit([], []).items()}
    return Model(np.frombuffer(r["vectors"], np.float32).reshape(-1, DIM), np.frombuffer(r["weights"], np.float32).reshape(2, DIM), np.frombuffer(r["bias"], np.float32))


def scores(texts: list[bytes], logit: np.ndarray, base: float) -> np.ndarray:
    f, at = features(texts)
    n = np.bincount(at, minlength=len(texts))
    z = np.bincount(at, weights=logit[f], minlength=len(texts)) / np.maximum(n, 1) + base
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def score_column(model: Model, text: Column) -> Column:
    """Score of a text column."""
    logit, base = model.logit, model.base  # 2**BITS numbers, whatever the input
    return text_scores(lambda: lambda texts: scores(texts, logit, base))(utf8(text))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id`` and ``score`` (0 to 1, higher: label 1 likelier) of every row."""
    return docs.select("doc_id", score_column(model, F.col("text")).alias("score"))
