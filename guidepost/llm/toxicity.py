"""Toxicity by a subsequence string kernel, Nyström landmarks and a linear SVM.

The kernel of two strings counts their common subsequences of ``ORDER`` letters, each
weighted by ``DECAY`` for every position it spans in either string, and is normalised
by the self-kernels. Gaps and inserted characters lower it but do not break it, and so
do endings that a word list would miss. Words of any script are folded first: lower
case, accents off, signs between letters dropped, look-alike digits and Cyrillic and
Greek letters of Latin shape read as letters; a row of single letters (``i d i o t``) is
read as one word.

Landmarks are word beginnings (or whole words of three letters), mined from labelled
documents: frequent in the toxic ones between ever different words, hardly found in the
others. Toxic documents without a word near any landmark are mined again, among
themselves, until they hold no further one; so the landmarks cover the toxic documents,
and rare insults get theirs. The clean words that most often come close to them join as
contrast. A sentence is the largest kernel value of its words against each landmark,
mapped by the inverse root of the landmarks' kernel matrix; a linear SVM with a sigmoid
is trained on sentences, the classes weighed by their rates among all labels. Of a toxic
training document the sentence closest to the landmarks stands for it, of a clean one
all sentences with a word near a landmark. A document scores as its highest sentence,
and as the bias alone if it has no word near a landmark.

A word is compared to a landmark only if it has, within gaps of two, at least 70 % of
its letter pairs; else the kernel value is 0. Words of fewer than three letters have no
kernel value, and in scripts written without spaces a landmark is the beginning of a run.

Null and empty texts score as the bias. Every row gets a score of its own, also rows that
repeat an id or a text. An empty table gives no rows; without labels of both classes every
row scores as the rate of toxic labels, 0.5 without any. Other columns, also of the names
used here, do not matter.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guidepost.llm.common import text_scores, utf8
from guidepost.llm.labels import label_rate, trained_in_one_task, training_rows

ORDER = 3
DECAY = 0.6
#: Longest stretch of a word that meets a landmark at once; longer words slide.
WINDOW = 12
#: Landmarks taken before the documents they cover are set aside.
LANDMARKS = 48
#: Kernel value from which a word is near a landmark.
NEAR = 0.6
CONTRAST = 24
MAX_TRAINING_ROWS = 3000
#: Words that a task remembers the kernel values of.
CACHE_WORDS = 200_000

#: Signs and digits read as letters.
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}

#: Cyrillic and Greek letters of the shape of a Latin one.
HOMOGLYPHS = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ο": "o", "α": "a", "ν": "v", "ι": "i"}

#: Signs that end a sentence where white space follows.
_ENDS = b".!?"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point the letter it is read as, 0 for what is dropped."""
    out = np.zeros(0x110000, np.uint32)
    for cp in range(0x32400):  # no letters beyond
        c = chr(cp)
        kind = unicodedata.category(c)[0]
        if kind == "L" or (kind == "M" and not 0x300 <= cp < 0x370):
            low = c.lower()
            out[cp] = ord(low) if len(low) == 1 else cp
    for sign, letter in (LOOKALIKES | HOMOGLYPHS).items():
        out[ord(sign)] = ord(letter)
    return out


def fold(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Letters (code points) of all words in a row, and the number of each letter's word."""
    text = b"\n".join(words).decode("utf-8", "replace").lower()
    flat = np.frombuffer(unicodedata.normalize("NFKD", text).encode("utf-32-le"), np.uint32)
    word = np.cumsum(flat == 10)
    code = _letters()[flat]
    keep = code > 0
    return code[keep], word[keep]


def as_text(code: np.ndarray) -> str:
    return code.astype("<u4").tobytes().decode("utf-32-le")


def spelled(texts: list[bytes]) -> list[list[bytes]]:
    """For each text its rows of at least three single characters, joined."""
    gap = b" \0\0 "  # ends every row
    buf = gap.join(texts)
    ends = np.cumsum([len(t) + len(gap) for t in texts])
    out: list[list[bytes]] = [[] for _ in texts]
    b = np.frombuffer(buf, np.uint8)
    if not len(b):
        return out
    space = (b == 32) | ((b >= 9) & (b <= 13))
    edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
    s, e = edge[::2], edge[1::2]
    count = np.concatenate([[0], np.cumsum((b & 0xC0) != 0x80)])
    one = np.diff((count[e] - count[s]) == 1, prepend=False, append=False).nonzero()[0]
    for lo, hi in zip(one[::2].tolist(), one[1::2].tolist()):
        if hi - lo >= 3:
            out[np.searchsorted(ends, s[lo], side="right")].append(b"".join(buf[s[i] : e[i]] for i in range(lo, hi)))
    return out


def words_of(texts: list[bytes]) -> list[set[bytes]]:
    return [set(t.split()).union(more) for t, more in zip(texts, spelled(texts))]


def sentence_values(text: bytes, words: set[bytes], value: dict[bytes, np.ndarray]) -> list[np.ndarray]:
    """Largest kernel values of each sentence that has a word near a landmark; a spelled
    word stands for itself. A sentence ends with its line, or with a word that has an end
    sign before white space; that word counts without the sign."""
    mine = words & value.keys()
    sentences: list[set[bytes]] = [set()]
    lines = [line.split() for line in text.split(b"\n")] if mine else []
    for k, line in enumerate(lines):
        last = line.pop() if k == len(lines) - 1 and not text[-1:].isspace() else None  # no white space follows
        for w in [w for w in line if w in mine or w[-1] in _ENDS]:
            if w[-1] not in _ENDS:
                sentences[-1].add(w)
                continue
            if (bare := w.rstrip(_ENDS)) in mine:
                sentences[-1].add(bare)
            if sentences[-1]:
                sentences.append(set())
        if last in mine:
            sentences[-1].add(last)
        if sentences[-1]:
            sentences.append(set())
    rows = [np.max([value[w] for w in own], axis=0) if len(own) > 1 else value[min(own)] for own in sentences[:-1]]
    return rows + [value[w] for w in sorted(mine.difference(*sentences))]


def pair_kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Gap-weighted subsequence kernel of each row of ``a`` with the same row of ``b``;
    rows are letters, padded with 0."""
    n, la = a.shape
    lb = b.shape[1]
    same = (a[:, :, None] == b[:, None, :]) & (a[:, :, None] > 0)
    d2 = np.float32(DECAY * DECAY)
    prev = np.ones((la + 1, lb + 1, n), np.float32)
    hit = np.ascontiguousarray(same.transpose(1, 2, 0)) * d2
    for _ in range(ORDER - 1):
        cur = np.zeros_like(prev)
        for i in range(1, la + 1):
            row = np.zeros(n, np.float32)
            for j in range(1, lb + 1):
                row = DECAY * row + hit[i - 1, j - 1] * prev[i - 1, j - 1]
                cur[i, j] = DECAY * cur[i - 1, j] + row
        prev = cur
    return (hit * prev[:-1, :-1]).sum(axis=(0, 1))


def padded(words: list[np.ndarray], width: int) -> np.ndarray:
    out = np.zeros((len(words), width), np.uint32)
    for i, w in enumerate(words):
        out[i, : len(w)] = w[:width]
    return out


class Landmarks:
    """The landmark strings, toxic ones first, their pair masks and self-kernels."""

    def __init__(self, strings: list[str], toxic: int):
        self.strings, self.toxic = strings, toxic
        codes = [np.array([ord(c) for c in s], np.uint32) for s in strings]
        letters = sorted({int(x) for c in codes for x in c})
        self.base = len(letters) + 1
        self.number = np.zeros(0x110000, np.int32)
        self.number[letters] = np.arange(1, self.base)
        self.rows = padded(codes, max([len(c) for c in codes], default=1))
        self.own = np.maximum(pair_kernel(self.rows, self.rows), 1e-9)
        pairs: dict[int, int] = {}
        self.needs = []
        for c in codes:
            small = self.number[c]
            own = {int(x) * self.base + int(y) for x, y in zip(small, small[1:])}
            self.needs.append(([pairs.setdefault(p, len(pairs)) for p in sorted(own)], min(len(own), max(2, (7 * len(own) + 9) // 10))))
        width = max(1, (len(pairs) + 63) // 64)
        self.bits = np.zeros((width, self.base**2), np.uint64)
        for p, k in pairs.items():
            self.bits[k // 64, p] = np.uint64(1) << np.uint64(k % 64)
        self.masks = np.zeros((width, len(strings)), np.uint64)
        for l, (ids, _) in enumerate(self.needs):
            for k in ids:
                self.masks[k // 64, l] |= np.uint64(1) << np.uint64(k % 64)

    def near(self, code: np.ndarray, word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a word and a landmark of which it has enough letter pairs, for words
        that are near a toxic landmark at all."""
        seen = np.zeros((len(self.bits), n), np.uint64)
        if len(code) < 2:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        owners = word[starts]
        wide = self.number[code]
        for k, bits in enumerate(self.bits):
            have = np.zeros(len(code), np.uint64)
            for gap in (1, 2, 3):
                if len(code) > gap:
                    hit = bits[wide[:-gap] * self.base + wide[gap:]]
                    hit[word[:-gap] != word[gap:]] = 0
                    have[:-gap] |= hit
            seen[k, owners] = np.bitwise_or.reduceat(have, starts)
        some = np.flatnonzero(np.bitwise_or.reduce(seen, axis=0))
        words, marks = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for l, (_, need) in enumerate(self.needs):
            n_bits = sum(np.bitwise_count(seen[k, some] & self.masks[k, l]) for k in range(len(self.bits)))
            words.append(some[n_bits >= need])
            marks.append(np.full(len(words[-1]), l))
            if l + 1 == self.toxic:
                some = np.unique(np.concatenate(words))
        return np.concatenate(words), np.concatenate(marks)

    def features(self, words: list[np.ndarray], word: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """Largest normalised kernel of each word's windows with the landmarks it is near."""
        out = np.zeros((len(words), len(self.strings)), np.float32)
        windows, first = [], [0]
        for w in words:
            windows += [w[s : s + WINDOW] for s in range(max(1, len(w) - WINDOW + 1))]
            first.append(len(windows))
        rows = padded(windows, WINDOW)
        own = np.concatenate([pair_kernel(rows[lo : lo + 512], rows[lo : lo + 512]) for lo in range(0, len(rows), 512)])
        first = np.array(first)
        many = np.diff(first)[word]
        begin = np.repeat(first[word], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        word, mark = np.repeat(word, many), np.repeat(mark, many)
        for lo in range(0, len(begin), 512):
            w, l, r = word[lo : lo + 512], mark[lo : lo + 512], begin[lo : lo + 512]
            np.maximum.at(out, (w, l), pair_kernel(rows[r], self.rows[l]) / np.sqrt(np.maximum(own[r], 1e-9) * self.own[l]))
        return out


def split_words(code: np.ndarray, word: np.ndarray, numbers: np.ndarray) -> list[np.ndarray]:
    lo = np.searchsorted(word, numbers, side="left")
    hi = np.searchsorted(word, numbers, side="right")
    return [code[a:b] for a, b in zip(lo, hi)]


def heads(words: list[bytes]) -> list[list[str]]:
    """For each word its folded beginnings of 4 to 10 letters, or all three letters."""
    code, word = fold(words)
    line = as_text(code)
    out: list[list[str]] = [[] for _ in words]
    at = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])).tolist() if len(word) else []
    for s, e in zip(at, [*at[1:], len(line)]):
        out[word[s]] = [line[s:e]] if e - s == 3 else [line[s : s + k] for k in range(4, min(10, e - s) + 1)]
    return out


def text_counts(texts: list[bytes]) -> dict[str, int]:
    """How many texts hold each word beginning."""
    out: dict[str, int] = {}
    for text in texts:
        for h in {h for hs in heads(sorted(set(text.split()))) for h in hs}:
            out[h] = out.get(h, 0) + 1
    return out


def leaning(toxic: int, clean: int, share: float) -> float:
    """Chernoff's bound, as minus its logarithm, of the chance that so many of a word's
    texts are toxic ones when a ``share`` of all texts is."""
    n = toxic + clean
    q = toxic / n
    return n * (q * np.log(q / share) + (0.0 if q == 1 else (1 - q) * np.log((1 - q) / (1 - share))))


def mine(texts: list[bytes], clean: dict[str, int], n_clean: int) -> list[str]:
    """Word beginnings found in many of these toxic texts and hardly in clean ones. They
    count by the pairs of neighbours they stand between, and by texts if those are fewer:
    neither copies of one text, which repeat all its words in their places, nor a word
    repeated in one text lend weight."""
    n = max(1, len(texts))
    share = n / (n + n_clean + 1)
    docs = {h: c for h, c in text_counts(texts).items() if c >= 3}
    # of as many words spread by chance, hardly one in twenty trials would lean as far
    least = np.log(20 * max(1, len(docs)))
    pure_at = lambda h, c: c >= 3 and clean.get(h, 0) / max(1, n_clean) <= 0.02 * min(1, c / n) and leaning(c, clean.get(h, 0), share) >= least
    settings: dict[str, set[int]] = {h: set() for h, c in docs.items() if pure_at(h, c)}
    for text in texts if settings else ():
        words = text.split()
        around = [b"", *words, b""]
        for k, hs in enumerate(heads(words)):
            for h in settings.keys() & hs:
                settings[h].add(hash((around[k], around[k + 2])))
    count = {h: min(docs[h], len(s)) for h, s in settings.items()}
    pure = {h: c for h, c in count.items() if pure_at(h, c)}
    chosen: list[str] = []
    while pure and len(chosen) < LANDMARKS:
        best = max(pure, key=lambda h: (pure[h], -len(h), h))
        # the longest beginning with nearly the same texts names the word itself
        chosen.append(max((h for h in pure if h == best or (len(best) > 3 and h.startswith(best) and pure[h] >= 0.8 * pure[best])), key=lambda h: (len(h), h)))
        same = lambda h: h == best or (min(len(h), len(best)) > 3 and (h.startswith(best) or best.startswith(h)))
        pure = {h: c for h, c in pure.items() if not same(h)}
    return chosen


def covering(texts: list[bytes], y: np.ndarray) -> list[str]:
    """Landmarks, mined among ever fewer toxic texts: those without a word near one."""
    bare = [texts[i] for i in np.flatnonzero(y == 0)]
    clean = text_counts(bare)
    left = np.flatnonzero(y == 1).tolist()
    chosen: list[str] = []
    while left:
        new = [h for h in mine([texts[i] for i in left], clean, len(bare)) if h not in chosen]
        if not new:
            break
        chosen += new
        sets = words_of([texts[i] for i in left])
        near = {w for w, v in word_values(Landmarks(new, len(new)), sets).items() if v.max() >= NEAR}
        left = [i for i, words in zip(left, sets) if near.isdisjoint(words)]
    return chosen


def fit(texts: list[bytes], y: list[int], rate: float | None = None) -> dict:
    """Landmarks, Nyström map, SVM weights and sigmoid, as strings and numbers. ``rate``
    is the share of toxic ones among all labels, that of ``y`` if not given."""
    y = np.array(y, np.int64)
    toxic = covering(texts, y) if y.any() else []
    own = (y.sum() + 0.5) / (len(y) + 1.0)
    rate = own if rate is None else rate
    if not toxic:
        return {"landmarks": [[]], "toxic": [0], "weights": [[]], "bias": [0.0], "slope": [0.0], "offset": [float(np.log(rate / (1 - rate)))]}
    # weight of a clean sentence: the sample's classes are not those of all labels
    heavy = (1 - rate) / rate * own / (1 - own)
    sets = words_of(texts)
    value = word_values(Landmarks(toxic, len(toxic)), sets)
    tough: dict[str, float] = {}
    for words, t in zip(sets, y):
        for w in () if t else words & value.keys():
            c, _ = fold([w])
            h = as_text(c[:WINDOW])
            tough[h] = tough.get(h, 0.0) + float(value[w].max()) ** 4
    contrast = sorted(tough, key=lambda h: (-tough[h], h))[:CONTRAST]
    marks = Landmarks(toxic + contrast, len(toxic))
    value = word_values(marks, sets)
    X, Y = [], []
    for text, words, t in zip(texts, sets, y):
        rows = sentence_values(text, words, value)
        rows.sort(key=lambda r: -r[: len(toxic)].max())
        X += rows[:1] if t else rows or [np.zeros(len(marks.strings), np.float32)]
        Y += [t] * (len(X) - len(Y))
    X, Y = np.array(X, np.float64), np.array(Y)
    root = nystrom_root(marks)
    Z = X @ root
    w, b = svm(Z, Y, heavy)
    margin = Z @ w + b
    slope, offset = sigmoid_fit(margin, Y, heavy)
    return {"landmarks": [marks.strings], "toxic": [len(toxic)], "weights": [(root @ w).tolist()], "bias": [float(b)], "slope": [float(slope)], "offset": [float(offset)]}


def nystrom_root(marks: Landmarks) -> np.ndarray:
    n = len(marks.strings)
    i, j = np.divmod(np.arange(n * n), n)
    K = (pair_kernel(marks.rows[i], marks.rows[j]) / np.sqrt(marks.own[i] * marks.own[j])).reshape(n, n)
    vals, vecs = np.linalg.eigh(K.astype(np.float64) + 1e-2 * np.eye(len(K)))
    return vecs @ np.diag(1 / np.sqrt(np.maximum(vals, 1e-3))) @ vecs.T


def svm(Z: np.ndarray, Y: np.ndarray, heavy: float, cost: float = 100.0, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss by Newton steps."""
    s = np.where(Y > 0, 1.0, -1.0)
    weigh = np.where(Y > 0, 1.0, heavy)
    A = np.hstack([Z, np.ones((len(Z), 1))])
    theta = np.zeros(A.shape[1])
    ridge = np.eye(A.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(rounds):
        slack = 1 - s * (A @ theta)
        on = slack > 0
        grad = ridge @ theta - 2 * cost * A[on].T @ (weigh[on] * s[on] * slack[on])
        hess = ridge + 2 * cost * (A[on] * weigh[on, None]).T @ A[on]
        step = np.linalg.solve(hess, grad)
        theta -= step
        if np.abs(step).max() < 1e-8:
            break
    return theta[:-1], float(theta[-1])


def sigmoid_fit(margin: np.ndarray, Y: np.ndarray, heavy: float) -> tuple[float, float]:
    """Platt's sigmoid, with his softened targets."""
    pos, neg = (Y > 0).sum(), (Y == 0).sum()
    t = np.where(Y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        weigh = np.where(Y > 0, 1.0, heavy)
        g = np.array([(weigh * (p - t) * margin).sum(), (weigh * (p - t)).sum()])
        v = weigh * p * (1 - p) + 1e-9
        H = np.array([[(v * margin * margin).sum() + 1e-6, (v * margin).sum()], [(v * margin).sum(), v.sum() + 1e-6]])
        d = np.linalg.solve(H, g)
        d *= min(1.0, 2.0 / max(np.abs(d).max(), 1e-12))
        a, b = a - d[0], b - d[1]
        if np.abs(d).max() < 1e-9:
            break
    return a, b


def word_values(marks: Landmarks, sets: list[set[bytes]]) -> dict[bytes, np.ndarray]:
    """Kernel values of the words near a landmark, from all sets of words."""
    vocab = list(set().union(*sets))
    if not vocab or not marks.strings:
        return {}
    code, word = fold(vocab)
    near, mark = marks.near(code, word, len(vocab))
    if not len(near):
        return {}
    hits, number = np.unique(near, return_inverse=True)
    return dict(zip((vocab[i] for i in hits), marks.features(split_words(code, word, hits), number, mark)))


class Scorer:
    """Trained model, ready for texts. Words come again in text after text, so it meets
    each one with the landmarks once, as long as it remembers it."""

    def __init__(self, landmarks: list[str], toxic: int, weights: list[float], bias: float, slope: float, offset: float):
        self.marks = Landmarks(list(landmarks), toxic) if landmarks else None
        self.weights, self.bias, self.slope, self.offset = np.array(weights), bias, slope, offset
        self.met: set[bytes] = set()
        self.value: dict[bytes, np.ndarray] = {}

    def meet(self, words: set[bytes]) -> None:
        """Kernel values of those of the words that are near a landmark."""
        if len(self.met) > CACHE_WORDS:
            self.met, self.value = set(), {}
        new = words - self.met
        self.value |= word_values(self.marks, [new])
        self.met |= new

    def scores(self, texts: list[bytes]) -> np.ndarray:
        margin = np.full(len(texts), self.bias)
        if self.marks:
            sets = words_of(texts)
            self.meet(set().union(*sets))
            for i, words in enumerate(sets):
                if not self.value.keys().isdisjoint(words):
                    margin[i] = max(self.bias, (np.array(sentence_values(texts[i], words, self.value)) @ self.weights).max() + self.bias)
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -40, 40)))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 4, held_fold: int = 2, max_rows: int = MAX_TRAINING_ROWS) -> tuple:
    """Trained model as a tuple of plain values. A round of mining takes at most
    ``LANDMARKS`` and leaves fewer documents, a landmark stands in three at least, so
    ``max_rows`` bounds the model."""
    rows = training_rows(docs, labels, label, folds, held_fold, max_rows, balanced=True)
    rate = label_rate(labels, label, folds, held_fold)
    got = trained_in_one_task(rows, lambda texts, y: fit(texts, y, rate), "landmarks array<string>, toxic long, weights array<double>, bias double, slope double, offset double")
    r = got[0] if got else {k: v[0] for k, v in fit([], []).items()}
    return tuple(r["landmarks"]), r["toxic"], tuple(r["weights"]), r["bias"], r["slope"], r["offset"]


def score_column(model: tuple, text: Column) -> Column:
    """Score of a text column."""
    return text_scores(lambda: Scorer(*model).scores)(utf8(text))


def score(docs: DataFrame, model: tuple) -> DataFrame:
    """``doc_id`` and ``score`` (0 to 1, higher: more toxic) of every row's whole text."""
    return docs.select("doc_id", score_column(model, F.col("text")).alias("score"))
