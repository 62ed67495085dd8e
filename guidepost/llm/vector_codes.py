"""Vector code compression with adaptive distance bounds.

A vector of whole numbers is cut into equal parts; each part is replaced by the number of
the nearest entry of its position's codebook, and codebooks are refined in rounds.

Between rounds each part keeps, in a stored table, its ``b`` closest entries beside the
one it has, one lower bound for each (in ascending order: a bound holds for all later
entries too), one outer bound for all entries that are not listed, and an upper bound to
its own entry. When entries move, upper bounds grow and lower bounds shrink by whole
numbers that are never less than the move. A part whose upper bound is strictly below its
first lower bound keeps its entry unseen. All others are uncertain: the distance to the
own entry is measured in whole numbers, then those to the listed entries whose bounds it
reaches, and all entries only where it reaches the outer bound. Comparisons are strict, so
ties are always measured, and the result is that of the plain rounds.

After each round ``b`` is set to the number of listed entries that sufficed for
``COVER`` of the uncertain parts, between an eighth and half of the codebook. A shorter
list turns the first bound it loses into the outer one; a longer one is filled with the
outer bound until the part is next measured in full.

A round is two passes without a shuffle of rows: one writes the next state, one adds up
the parts of each entry (a task returns one row per entry). Old states are deleted as
soon as the next one is written; a lost executor repeats its files from the last one.

Rows whose vector is null, empty, or holds null or non-finite components are not in the
result, nor are those whose length is not the most frequent multiple of the number of
parts (the shorter one of equals). Rows that repeat are coded each; ties of the smallest
ids are ordered by components, rows without an id come last. With fewer vectors than
entries a codebook has as many entries as there are vectors; an empty table gives no rows.
Components beyond ``vectors.LIMIT`` count as that.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guidepost.llm.common import remove, store
from guidepost.llm.vectors import group_sums, matrix, moved, slices, squared, usable, whole
from guidepost.session import scratch_path

#: Share of uncertain parts that the listed entries should settle.
COVER = 0.95
#: An outer bound of parts whose list holds all entries.
NONE_OUTSIDE = 2**31 - 1
#: Labels up to this number are joined by broadcast; beyond it through salted keys.
BROADCAST_LABELS = 10_000
SALTS = 64


def root_down(d: np.ndarray) -> np.ndarray:
    """Largest whole number whose square is at most ``d``."""
    s = np.sqrt(d.astype(np.float64)).astype(np.int64)
    s -= s * s > d
    s += (s + 1) * (s + 1) <= d
    return s


def root_up(d: np.ndarray) -> np.ndarray:
    s = root_down(d)
    return s + (s * s < d)


@dataclass
class State:
    """Bounds of parts, one row each: listed entries ``near`` (the own one first, -1 for
    none known), upper bound ``up``, lower bounds ``low`` and the ``outer`` bound; ``need``
    is how many listed entries the last round had to measure, one more for all entries."""

    near: np.ndarray
    up: np.ndarray
    low: np.ndarray
    outer: np.ndarray
    need: np.ndarray

    def resized(self, b: int) -> State:
        old = self.low.shape[1]
        if b < old:
            return State(self.near[:, : b + 1], self.up, self.low[:, :b], self.low[:, b], self.need)
        fill = ((0, 0), (0, b - old))
        low = np.pad(self.low, fill)
        low[:, old:] = self.outer[:, None]
        return State(np.pad(self.near, fill, constant_values=-1), self.up, low, self.outer, self.need)

    def rows(self, parts: int) -> tuple[np.ndarray, np.ndarray]:
        """Entries and bounds of all parts of a vector side by side."""
        return self.near.reshape(-1, parts * self.near.shape[1]), np.column_stack([self.up, self.low, self.outer]).reshape(-1, parts * (self.low.shape[1] + 2))

    @staticmethod
    def of_rows(near: np.ndarray, bound: np.ndarray, parts: int) -> State:
        near, bound = near.reshape(len(near) * parts, -1), bound.reshape(len(bound) * parts, -1)
        return State(near.copy(), bound[:, 0].copy(), bound[:, 1:-1].copy(), bound[:, -1].copy(), np.zeros(len(near), np.int64))


class Codebooks:
    """Entries of all part positions, as (position, entry, component), and how far they moved."""

    def __init__(self, entries: np.ndarray, before: np.ndarray | None = None):
        self.e = entries
        self.parts, self.k, self.width = entries.shape
        gone = np.zeros((self.parts, self.k), np.int64)
        if before is not None:
            gone = root_up(((entries - before) ** 2).sum(2))
        self.move, self.most = gone, gone.max(axis=1)

    def full(self, x: np.ndarray, pos: np.ndarray, b: int) -> State:
        """Everything measured: exact lists and bounds."""
        d = np.empty((len(x), self.k), np.int64)
        for j in range(self.k):
            d[:, j] = squared(x, self.e[pos, j])
        order = np.argsort(d, axis=1, kind="stable")[:, : b + 2]  # stable: the lower number first among equals
        near = np.take_along_axis(d, order, axis=1)
        root = root_down(near)
        outer = root[:, b + 1] if self.k > b + 1 else np.full(len(x), NONE_OUTSIDE)
        return State(order[:, : b + 1], root_up(near[:, 0]), root[:, 1 : b + 1], outer, np.full(len(x), b + 1))

    def first(self, x: np.ndarray, b: int) -> State:
        pos = np.arange(len(x)) % self.parts
        return self.full(x, pos, b)

    def again(self, x: np.ndarray, s: State) -> State:
        """Assignments after the entries moved, by bounds where they settle it."""
        pos = np.arange(len(x)) % self.parts
        b = s.low.shape[1]
        s.up += self.move[pos, s.near[:, 0]]
        known = s.near[:, 1:] >= 0
        s.low -= np.where(known, self.move[pos[:, None], np.maximum(s.near[:, 1:], 0)], self.most[pos][:, None])
        s.outer = np.where(s.outer == NONE_OUTSIDE, NONE_OUTSIDE, s.outer - self.most[pos])
        s.need = np.zeros(len(x), np.int64)
        ordered(s.low, s.outer)
        doubt = np.flatnonzero(s.up >= (s.low[:, 0] if b else s.outer))
        if not len(doubt):
            return s
        own = squared(x[doubt], self.e[pos[doubt], s.near[doubt, 0]])
        s.up[doubt] = root_up(own)
        reach = np.column_stack([s.low[doubt], s.outer[doubt]])
        reached = (reach <= 0) | (own[:, None] >= reach * reach)
        need = np.where(reached[:, -1], b + 1, reached[:, :-1].sum(axis=1))
        s.need[doubt] = need
        listed = (need > 0) & (need <= b)
        for z in np.unique(need[listed]):
            rows = doubt[need == z]
            cand = s.near[rows, : z + 1]
            d = np.column_stack([own[need == z], *[squared(x[rows], self.e[pos[rows], cand[:, j]]) for j in range(1, z + 1)]])
            order = np.lexsort((cand, d), axis=1)
            d = np.take_along_axis(d, order, axis=1)
            s.near[rows, : z + 1] = np.take_along_axis(cand, order, axis=1)
            s.up[rows] = root_up(d[:, 0])
            s.low[rows, :z] = root_down(d[:, 1:])
        rows = doubt[need == b + 1]
        if len(rows):
            whole_list = self.full(x[rows], pos[rows], b)
            s.near[rows], s.up[rows], s.low[rows], s.outer[rows] = whole_list.near, whole_list.up, whole_list.low, whole_list.outer
        ordered(s.low, s.outer)
        return s


def ordered(low: np.ndarray, outer: np.ndarray) -> None:
    """Make each bound hold for all that follow it."""
    last = outer
    for j in range(low.shape[1] - 1, -1, -1):
        np.minimum(low[:, j], last, out=low[:, j])
        last = low[:, j]


def next_b(hist: np.ndarray, b: int, k: int) -> int:
    """List length from how many parts needed 0, 1, ... ``b`` listed entries or all of them."""
    least, most = min(max(1, k // 8), k - 1), min(max(1, k // 2), k - 1)
    doubtful = int(hist[1:].sum())
    if not doubtful:
        return least
    enough = np.cumsum(hist[1:])[:b] >= COVER * doubtful
    return min(max(int(np.argmax(enough)) + 1 if enough.any() else b + 1, least), most)


def compress(vectors: DataFrame, parts: int = 8, k: int = 16, rounds: int = 6, scale: int = 4096, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", report: list | None = None) -> DataFrame:
    """``vec_id``, ``code``, ``error``, ``label_error`` and ``codebooks_sha256`` of every
    usable vector. ``report`` gets (b, parts by listed entries needed) of each round."""
    spark = vectors.sparkSession
    path = scratch_path(spark, "codes")
    v = F.col(embedding).cast("array<double>")
    src = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), v.alias("v")).where(usable(F.col("v")))
    src = src.select("vec_id", "label", whole(F.col("v"), scale).alias("x"))
    kind = {f.name: f.dataType.simpleString() for f in src.schema}
    lengths = src.groupBy(F.size("x").alias("n")).agg(F.count("*").alias("c")).where(F.col("n") % parts == 0)
    common = lengths.orderBy(F.desc("c"), "n").first()
    if not common:
        return src.limit(0).select("vec_id", F.lit("").alias("code"), *[F.lit(0).cast("long").alias(c) for c in ("error", "label_error")], F.lit("").alias("codebooks_sha256"))
    dim = common["n"]
    src = src.where(F.size("x") == dim)
    seeds = np.array([r["x"] for r in src.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(k).collect()], np.int64)
    k, width = len(seeds), dim // parts
    books = Codebooks(seeds.reshape(k, parts, width).transpose(1, 0, 2))
    b = min(max(1, k // 4), k - 1)
    now = store(src, f"{path}/x")
    last, hist = f"{path}/x", None

    for r in range(rounds + 1):
        was = b
        if hist is not None and r > 1:  # the first round lists all parts anew and tells nothing about b
            b = next_b(hist, b, k)

        def assign(batches, books=books, was=was, b=b, first=r == 0, final=r == rounds):
            for rows in slices(batches):
                x = matrix(rows.column("x"), dim).reshape(-1, width)
                if first:
                    s = books.first(x, b)
                else:
                    near, bound = matrix(rows.column("near"), parts * (was + 1)), matrix(rows.column("bound"), parts * (was + 2))
                    s = books.again(x, State.of_rows(near, bound, parts).resized(b))
                if final:
                    yield coded(rows, x, s, books)
                    continue
                near, bound = s.rows(parts)
                lists = [rows.column("x"), *(as_lists(a) for a in (near, bound, s.need.reshape(-1, parts)))]
                yield pa.RecordBatch.from_arrays([rows.column("vec_id"), rows.column("label"), *lists], names=["vec_id", "label", "x", "near", "bound", "need"])

        keys = f"vec_id {kind['vec_id']}, label {kind['label']}"
        schema = f"{keys}, code string, error long" if r == rounds else f"{keys}, x array<int>, near array<int>, bound array<int>, need array<int>"
        now = store(now.mapInArrow(assign, schema), f"{path}/{r}")
        remove(spark, last)
        last = f"{path}/{r}"
        if r == rounds:
            break

        def entry_of(rows, b=b, k=k):
            # one group per (position, entry) with its components, then one per need
            x = matrix(rows.column("x"), dim).reshape(-1, width)
            own = matrix(rows.column("near"), parts * (b + 1)).reshape(-1, b + 1)[:, 0]
            need = matrix(rows.column("need"), parts).reshape(-1)
            return np.concatenate([np.arange(len(x)) % parts * k + own, parts * k + need]), np.concatenate([x, np.zeros_like(x)])

        n, total = group_sums(now.select("x", "near", "need"), parts * k + b + 2, width, entry_of)
        hist = n[parts * k :]
        if report is not None:
            report.append((b, hist.tolist()))
        flat = books.e.reshape(parts * k, width)
        books = Codebooks(moved(flat, n[: parts * k], total[: parts * k]).reshape(parts, k, width), books.e)

    digest = hashlib.sha256(",".join(map(str, books.e.reshape(-1))).encode()).hexdigest()
    sums = now.groupBy("label").agg(F.sum("error").alias("label_error"))
    return with_sums(now, sums).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def as_lists(a: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32) * a.shape[1]), pa.array(a.reshape(-1).astype(np.int32)))


def coded(rows: pa.RecordBatch, x: np.ndarray, s: State, books: Codebooks) -> pa.RecordBatch:
    own = s.near[:, 0]
    d = squared(x, books.e[np.arange(len(x)) % books.parts, own]).reshape(-1, books.parts)
    code = ["".join(f"{i:02x}" for i in row) for row in own.reshape(-1, books.parts).tolist()]
    return pa.RecordBatch.from_arrays([rows.column("vec_id"), rows.column("label"), pa.array(code, pa.string()), pa.array(d.sum(axis=1))], names=["vec_id", "label", "code", "error"])


def with_sums(rows: DataFrame, sums: DataFrame, most: int = BROADCAST_LABELS) -> DataFrame:
    """The sums of each label beside its rows, null labels together."""
    sums = sums.withColumnRenamed("label", "of")
    same = F.col("label").eqNullSafe(F.col("of"))
    if sums.limit(most + 1).count() <= most:
        return rows.join(F.broadcast(sums), same)
    # a label may hold a third of all rows: its rows are dealt to several keys
    dealt = rows.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    copies = sums.withColumn("own", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return dealt.join(copies, same & (F.col("salt") == F.col("own")))
