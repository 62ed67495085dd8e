"""Language-model scores by prediction by partial matching.

Texts are read as their words (A-Z in lower case) with one space between, closed by an
end sign, as bytes. The model is a trie of byte contexts up to ``ORDER`` bytes long with
counts from all training documents. A byte is predicted in its longest known context
with the probability (n - 1/2) / T (T its count, D its distinct followers); a new byte
escapes with D / 2T (escape method D) to the next shorter context, where all bytes that the longer
one would have predicted are excluded from the counts; below the empty context, bytes
never seen share what is left alike. The code length of a document is the sum.

Counting: each task adds up its (context, byte) pairs of full length; shorter contexts
are sums of these, because every byte has a full context (texts begin with end signs).
All contexts of each order are a stored table with their followers (at most 256) and
the constants that escapes need; no entry is ever left out. The most frequent pairs of
full length, at most ``MAX_ENTRIES``, travel to the tasks with their final probability.
All others, and pairs never seen, are looked up through joins, each distinct one once
per order from the longest context downwards: a key meets at most 256 rows in any of
these joins. How many pairs travel changes no score.

Beside it stands the add-one unigram score over words, from the counts of all distinct
words of the corpus. Words above a count that at most ``TOP_WORDS`` reach are looked up
in the task; all others, each a tiny share of the corpus, through a join.

Null and empty texts have only the end sign; rows that repeat are scored each; an empty
table gives no rows, an empty training set a uniform model. A null id is in training.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guidepost.llm.common import begin, crc_mod, give_back, holds, map_text, steps, store, utf8
from guidepost.llm.quality_rules import bucket
from guidepost.session import scratch_path

ORDER = 5
#: Pairs of full length that are looked up in the task; all others through joins.
MAX_ENTRIES = 2_000_000
TOP_WORDS = 150_000
#: Distinct words and pairs that a task gathers before it passes them on.
FLUSH_WORDS = 100_000
FLUSH_PAIRS = 800_000
END = b"\n"


def read(text: bytes) -> list[bytes]:
    return text.lower().split()


def grams(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(context, byte) of every byte of each line and its end sign as one number of
    ``ORDER + 1`` bytes, and how many each line has."""
    pad = END * ORDER
    buf = b"".join(pad + x + END for x in lines)
    b = np.frombuffer(buf, np.uint8)
    n = np.array([len(x) + 1 for x in lines], np.int64)
    key = np.zeros(max(len(b) - ORDER, 0), np.uint64)
    for k in range(ORDER + 1):
        key = (key << np.uint64(8)) | b[k : k + len(key)]
    first = np.cumsum(n + ORDER) - n - ORDER
    own = np.zeros(len(key) + 1, np.int32)
    np.add.at(own, first, 1)
    np.add.at(own, first + n, -1)
    return key[np.cumsum(own[:-1]) > 0], n


def counted(train: DataFrame) -> DataFrame:
    """(word, gram, n): partial counts by task; either ``word`` or ``gram`` is null."""

    def run(batches):
        begin("counting")  # not on top of a table of an earlier run
        words: Counter = Counter()
        parts: list[tuple[np.ndarray, np.ndarray]] = []

        def word_rows():
            w = pa.array(list(words), pa.binary())
            return pa.RecordBatch.from_arrays([w, pa.nulls(len(w), pa.int64()), pa.array(list(words.values()), pa.int64())], names=["word", "gram", "n"])

        def merged():
            keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            return keys, np.bincount(at, weights=np.concatenate([n for _, n in parts])).astype(np.int64)

        def gram_rows(keys, n):
            return pa.RecordBatch.from_arrays([pa.nulls(len(keys), pa.binary()), pa.array(keys.astype(np.int64)), pa.array(n)], names=["word", "gram", "n"])

        for _, texts in steps(batches):
            lines = []
            for t in texts:
                w = read(t)
                words.update(w)
                lines.append(b" ".join(w))
            words[END] += len(texts)
            parts.append(np.unique(grams(lines)[0], return_counts=True))
            if len(words) > FLUSH_WORDS:
                yield word_rows()
                words.clear()
            if sum(len(k) for k, _ in parts) > FLUSH_PAIRS:
                parts = [merged()]
                if len(parts[0][0]) > FLUSH_PAIRS // 2:
                    yield gram_rows(*parts.pop())
        if words:
            yield word_rows()
        if parts:
            yield gram_rows(*merged())
        parts.clear()
        give_back()

    return train.mapInArrow(run, "word binary, gram long, n long")


def least_count(counts: DataFrame, most: int) -> int:
    """Smallest bound so that at most ``most`` rows have ``n`` at or above it."""
    seen = sorted(counts.groupBy(bucket(F.col("n")).alias("b")).agg(F.count("*").alias("c")).collect(), reverse=True)  # some 1,900 buckets at most
    total, bound = 0, 1 << 62
    for b, c in seen:
        total += c
        if total > most:
            return bound
        bound = b
    return 1


def low_bytes(col: Column, k: int) -> Column:
    return col.bitwiseAND((1 << (8 * k)) - 1)


def context_tables(full: DataFrame, stored: Callable[[DataFrame, str], DataFrame]) -> list[DataFrame]:
    """By order: every context ``ctx`` with its count ``T``, distinct followers ``D`` and
    their counts ``of``; ``exT`` and ``exD`` are what the next shorter context has left
    without these followers."""
    out: list[DataFrame] = []
    for k in range(ORDER + 1):
        entries = full.groupBy(low_bytes(F.col("gram"), k + 1).alias("gram")).agg(F.sum("n").alias("n"))
        follower = F.struct(low_bytes(F.col("gram"), 1).alias("byte"), "n")
        own = entries.groupBy(F.shiftright("gram", 8).alias("ctx")).agg(F.sum("n").alias("T"), F.count("*").alias("D"), F.map_from_entries(F.collect_list(follower)).alias("of"))
        if k:
            up = out[-1].select(F.col("ctx").alias("up"), F.col("T").alias("up_T"), F.col("D").alias("up_D"), F.col("of").alias("up_of"))
            taken = F.aggregate(F.map_keys("of"), F.lit(0).cast("long"), lambda t, y: t + F.try_element_at("up_of", y))
            own = own.join(up, low_bytes(F.col("ctx"), k - 1) == F.col("up")).select("ctx", "T", "D", "of", (F.col("up_T") - taken).alias("exT"), (F.col("up_D") - F.col("D")).alias("exD"))
        out.append(stored(own, f"order{k}"))
    return out


def looked_up(asked: DataFrame, tables: list[DataFrame], stored: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """``gram`` and ``cost``, its log10 probability, of each distinct ``gram`` in ``asked``."""
    need: list[DataFrame] = []
    for k in range(ORDER, -1, -1):
        # pairs that a longer context has not settled, with what their context of this order knows
        asked = (asked if k == ORDER else need[-1].where("n is null").select(low_bytes(F.col("gram"), k + 1).alias("gram"))).distinct()
        own = asked.withColumn("ctx", F.shiftright("gram", 8)).join(tables[k], "ctx", "left")
        own = own.withColumn("n", F.try_element_at("of", low_bytes(F.col("gram"), 1)))
        need.append(stored(own.drop("ctx", "of"), f"need{k}"))
    lg, half = F.log10, F.lit(0.5)
    got = None
    for k, own in enumerate(reversed(need)):
        # ``below``: cost in shorter contexts after an escape; ``cost``: all of it
        if got is None:
            own = own.withColumn("below", -lg(F.greatest(256 - F.coalesce("D", F.lit(0)), F.lit(1))))
            unknown = F.col("below")
        else:
            down = got.select(F.col("gram").alias("down"), F.col("n").alias("n_down"), F.col("below").alias("below_down"), F.col("cost").alias("cost_down"))
            own = own.join(down, low_bytes(F.col("gram"), k) == F.col("down"), "left")
            escape = F.when(F.col("exD") > 0, lg(F.try_divide(half * F.col("exD"), F.col("exT")))).otherwise(0.0)
            own = own.withColumn("below", F.when(F.col("n_down").isNotNull(), lg(F.try_divide(F.col("n_down") - half, F.col("exT")))).otherwise(escape + F.col("below_down")))
            unknown = F.col("cost_down")
        cost = F.when(F.col("T").isNull(), unknown).when(F.col("n").isNotNull(), lg((F.col("n") - half) / F.col("T"))).otherwise(lg(half * F.col("D") / F.col("T")) + F.col("below"))
        got = stored(own.select("gram", "n", "below", cost.alias("cost")), f"cost{k}")
    return got.select("gram", "cost")


class Top:
    """Hash table from (context, byte) numbers to their log10 probabilities."""

    def __init__(self, keys: np.ndarray, logp: np.ndarray):
        self.bits = max(4, int(2 * max(len(keys), 1)).bit_length())
        self.slots = np.full(1 << self.bits, np.uint64(1 << 63))
        self.value = np.zeros(1 << self.bits)
        left, slot = np.arange(len(keys)), self._slot(keys)
        self.probes = 0
        while len(left):
            self.probes += 1
            free = self.slots[slot] == np.uint64(1 << 63)
            _, first = np.unique(slot, return_index=True)
            put = np.zeros(len(left), bool)
            put[first] = True
            put &= free
            self.slots[slot[put]] = keys[left[put]]
            self.value[slot[put]] = logp[left[put]]
            left, slot = left[~put], (slot[~put] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability of each number, 0 for those not in the table, and the places of these."""
        slot = self._slot(key)
        hit = self.slots[slot] == key
        out = np.where(hit, self.value[slot], 0.0)
        left, gone = np.flatnonzero(~hit), []
        for _ in range(self.probes - 1):
            if not len(left):
                break
            slot = (self._slot(key[left]) + _ + 1) & ((1 << self.bits) - 1)
            found = self.slots[slot]
            hit = found == key[left]
            out[left[hit]] = self.value[slot[hit]]
            empty = found == np.uint64(1 << 63)
            gone.append(left[empty])
            left = left[~hit & ~empty]
        return out, np.sort(np.concatenate([*gone, left]))


class Trie:
    """The whole model in memory, for tables that fit: sorted entries of each order with
    the constants that escapes need. Tests hold the joins against it."""

    def __init__(self, entries: list[tuple[np.ndarray, np.ndarray]]):
        self.keys, self.n, self.ctx, self.T, self.D, self.exT, self.exD = [], [], [], [], [], [], []
        for k, (keys, n) in enumerate(entries):
            order = np.argsort(keys)
            keys, n = keys[order].astype(np.uint64), n[order].astype(np.float64)
            ctx, at = np.unique(keys >> np.uint64(8), return_inverse=True)
            T, D = np.bincount(at, weights=n, minlength=len(ctx)), np.bincount(at, minlength=len(ctx)).astype(np.float64)
            exT, exD = np.zeros(max(len(ctx), 1)), np.zeros(max(len(ctx), 1))
            if k and len(ctx):
                mask = np.uint64((1 << (8 * k)) - 1)
                below = np.searchsorted(self.keys[k - 1], keys & mask)
                taken = np.bincount(at, weights=self.n[k - 1][below], minlength=len(ctx))
                up = np.searchsorted(self.ctx[k - 1], ctx & (mask >> np.uint64(8)))
                exT, exD = self.T[k - 1][up] - taken, self.D[k - 1][up] - D
            for a, x in zip((self.keys, self.n, self.ctx, self.T, self.D, self.exT, self.exD), (keys, n, ctx, T, D, exT, exD)):
                a.append(x)
        at = np.searchsorted(self.ctx[ORDER], self.keys[ORDER] >> np.uint64(8))
        self.top = Top(self.keys[ORDER], np.log10((self.n[ORDER] - 0.5) / self.T[ORDER][at]) if len(at) else np.empty(0))

    def log10(self, key: np.ndarray) -> np.ndarray:
        """log10 probability of each (context, byte) number."""
        out, left = self.top.get(key)
        out[left] = self._escaped(key[left])
        return out

    def _escaped(self, key: np.ndarray) -> np.ndarray:
        """log10 probability by walking from the longest known context downwards."""
        key, back = np.unique(key, return_inverse=True)
        p = np.zeros(len(key))
        live = np.ones(len(key), bool)
        before = np.full(len(key), -1)  # number of the context above, if it was known
        for k in range(ORDER, -1, -1):
            i = np.flatnonzero(live)
            if not len(i):
                break
            own = key[i] & np.uint64((1 << (8 * (k + 1))) - 1)
            at = np.searchsorted(self.ctx[k], own >> np.uint64(8))
            known = (at < len(self.ctx[k]))
            known[known] = self.ctx[k][at[known]] == (own >> np.uint64(8))[known]
            i, own, at = i[known], own[known], at[known]
            above = before[i]
            up = np.maximum(above, 0)
            ex = above >= 0
            T = np.where(ex, self.exT[k + 1][up], self.T[k][at]) if k < ORDER else self.T[k][at]
            D = np.where(ex, self.exD[k + 1][up], self.D[k][at]) if k < ORDER else self.D[k][at]
            e = np.searchsorted(self.keys[k], own)
            seen = e < len(self.keys[k])
            seen[seen] = self.keys[k][e[seen]] == own[seen]
            p[i[seen]] += np.log10((self.n[k][e[seen]] - 0.5) / T[seen])
            live[i[seen]] = False
            esc = ~seen & (D > 0)
            p[i[esc]] += np.log10(0.5 * D[esc] / T[esc])
            before[i[~seen]] = at[~seen]
        distinct = self.D[0][0] if len(self.D[0]) else 0.0
        p[live] -= np.log10(max(256 - distinct, 1))
        return p[back]


@lru_cache(maxsize=1)
def _top(model: _Model) -> Top:
    return Top(model.keys, model.logp)


holds(__name__, _top.cache_clear)


class _Model:
    """Arrays of a table of pairs, hashable by a stamp of its own."""

    def __init__(self, stamp: str, keys: np.ndarray, logp: np.ndarray):
        self.stamp, self.keys, self.logp = stamp, keys, logp

    def __hash__(self):
        return hash(self.stamp)

    def __eq__(self, other):
        return self.stamp == other.stamp


def most_frequent(longest: DataFrame, stamp: str) -> _Model:
    """Pairs of full length with their log10 probabilities, at most ``MAX_ENTRIES``."""
    pairs = longest.select("ctx", "T", F.explode("of").alias("byte", "n"))
    top = pairs.where(F.col("n") >= least_count(pairs, MAX_ENTRIES))
    got = top.select((F.col("ctx") * 256 + F.col("byte")).alias("gram"), F.log10((F.col("n") - F.lit(0.5)) / F.col("T")).alias("logp")).toArrow()
    return _Model(stamp, got.column("gram").to_numpy().astype(np.uint64), got.column("logp").to_numpy())


def missed(key: np.ndarray, n: np.ndarray, at: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """For each line the distinct numbers of ``key`` at the places ``at``, and how often each."""
    line = np.repeat(np.arange(len(n)), n)[at]
    order = np.lexsort((key[at], line))
    line, own = line[order], key[at][order]
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (line[1:] != line[:-1])
    first = np.flatnonzero(new)
    ends = pa.array(np.searchsorted(line[first], np.arange(len(n) + 1)).astype(np.int32))
    times = np.diff(np.append(first, len(own)))
    return tuple(pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int64))) for x in (own[first], times))


def score(docs: DataFrame, folds: int = 7, held_fold: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``,
    ``base_score`` and ``score`` of every row, learned outside the held-out fold."""
    spark = docs.sparkSession
    root = scratch_path(spark, "ppm")

    def stored(df: DataFrame, name: str) -> DataFrame:
        return store(df, f"{root}/{name}")

    src = docs.select(F.col(doc_id).alias("doc_id"), (crc_mod(F.col(doc_id), folds) == held_fold).alias("held_out"), utf8(F.col(text)).alias("text"))
    counts = stored(counted(src.where("not held_out").select("text")).groupBy("word", "gram").agg(F.sum("n").alias("n")), "counts")
    words = counts.where("word is not null").select("word", "n")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("N"), F.count("*").alias("V")).first()
    N, V = total["N"], total["V"]
    bound = least_count(words, TOP_WORDS)
    top = words.where(F.col("n") >= bound).toArrow()
    part = {w: np.log10((n + 1) / (N + V + 1)) for w, n in zip(top.column("word").to_pylist(), top.column("n").to_pylist())}
    tables = context_tables(counts.where("gram is not null").select("gram", "n"), stored)
    model = most_frequent(tables[ORDER], root)

    def work(rows, texts):
        lines, known, base, rare = [], [], [], []
        for t in texts:
            w = read(t)
            lines.append(b" ".join(w))
            w.append(END)
            found = [part[x] for x in w if x in part]
            known.append(len(found))
            base.append(float(sum(found)))
            rare.append([x for x in w if x not in part] if len(found) < len(w) else [])
        key, n = grams(lines)
        logp, others = _top(model).get(key)
        cost = np.add.reduceat(logp, np.cumsum(n) - n)
        gram, times = missed(key, n, others)
        return {
            "doc_id": rows.column("doc_id"), "held_out": rows.column("held_out"), "n_tokens": np.array([k + len(r) for k, r in zip(known, rare)], np.int64),
            "n_top": np.array(known, np.int64), "base_top": np.array(base), "cost_top": cost, "rare": pa.array(rare, pa.list_(pa.binary())), "gram": gram, "times": times,
        }

    kind = src.schema["doc_id"].dataType.simpleString()
    first = map_text(src, work, f"doc_id {kind}, held_out boolean, n_tokens long, n_top long, base_top double, cost_top double, rare array<binary>, gram array<long>, times array<long>")
    first = stored(first.withColumn("row", F.monotonically_increasing_id()), "first")
    asked = first.select("row", F.explode("rare").alias("word")).groupBy("row", "word").agg(F.count("*").alias("tf"))
    less = asked.join(words.where(F.col("n") < bound), "word", "left")
    c = F.coalesce(F.col("n"), F.lit(0))
    rest = less.groupBy("row").agg(F.sum(F.when(c > 0, F.col("tf")).otherwise(0)).alias("n_rare"), F.sum(F.col("tf") * F.log10((c + 1) / F.lit(float(N + V + 1)))).alias("base_rare"))
    pairs = first.select("row", F.explode(F.arrays_zip("gram", "times")).alias("p")).select("row", "p.gram", "p.times")
    found = looked_up(pairs.select("gram"), tables, stored)
    more = pairs.join(found, "gram").groupBy("row").agg(F.sum(F.col("times") * F.col("cost")).alias("cost_rare"))
    got = first.drop("rare", "gram", "times").join(rest, "row", "left").join(more, "row", "left")
    return got.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_top") + F.coalesce("n_rare", F.lit(0))).alias("n_known"),
        F.lit(int(N)).cast("long").alias("train_tokens"),
        (F.col("base_top") + F.coalesce("base_rare", F.lit(0.0))).alias("base_score"),
        (F.col("cost_top") + F.coalesce("cost_rare", F.lit(0.0))).alias("score"),
    )
