"""Edit-aware token counts.

Each document keeps a segment tree, a row of a stored table (:func:`build`) that takes
edits (:func:`recount`) and comes out as the same kind of row again: its text is cut at forced boundaries (where no
token can cross and the pre-tokenizer starts anew, see :mod:`guidepost.llm.bpe`) into
segments, ``LEAF`` of which form a leaf with its byte length and token count, and a
binary tree over the leaves holds the sums. Positions are found by descending the tree.

An edit replaces the bytes from ``start`` to ``end``. Only the leaves it touches, and
one more on a side where it touches the leaf's first or last character (the boundary
there may be one no longer), are encoded again; where the text beside the region no
longer has a forced boundary the region grows by a leaf. The first leaf of the region
takes the new text and count, the others become empty, and the sums above them are
brought up to date: O(edited leaves + log of all leaves) per edit.

Edits of a document apply one after another, each to the text the former ones left.
Positions count bytes of UTF-8; those past the end mean the end, those inside a
character its start. Null texts are empty; null replacements delete; documents without
edits keep their counts; edits of unknown documents have no effect; an empty table
gives no rows. The edits of one document are collected into one row, as its text is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guidepost.llm.bpe import codec
from guidepost.llm.common import map_text, utf8

#: Segments in a leaf.
LEAF = 32


class SegmentTree:
    """Byte lengths and token counts over leaves of text."""

    def __init__(self, leaves: list[bytes], tokens: np.ndarray):
        self.leaves = leaves
        n = max(len(leaves), 1)
        self.width = 1 << (n - 1).bit_length()
        self.length = self._sums(np.array([len(x) for x in leaves], np.int64))
        self.tokens = self._sums(tokens)
        self.encoded = 0  # bytes encoded again by edits

    def _sums(self, values: np.ndarray) -> list[np.ndarray]:
        level = np.zeros(self.width, np.int64)
        level[: len(values)] = values
        out = [level]
        while len(level) > 1:
            level = level[::2] + level[1::2]
            out.append(level)
        return out

    @property
    def total(self) -> int:
        return int(self.tokens[-1][0])

    def find(self, pos: int) -> tuple[int, int]:
        """Leaf that holds byte ``pos`` and the offset in it; the end of the text is in
        the last leaf."""
        pos = min(max(pos, 0), int(self.length[-1][0]))
        if pos == self.length[-1][0]:
            last = max((i for i in range(len(self.leaves) - 1, -1, -1) if self.leaves[i]), default=0)
            return last, len(self.leaves[last]) if self.leaves else 0
        i = 0
        for level in reversed(self.length[:-1]):
            i *= 2
            if pos >= level[i]:
                pos -= int(level[i])
                i += 1
        return i, pos

    def put(self, i: int, text: bytes, tokens: int) -> None:
        self.leaves[i] = text
        for levels, value in ((self.length, len(text)), (self.tokens, tokens)):
            change = value - levels[0][i]
            k = i
            for level in levels:
                level[k] += change
                k //= 2

    def beside(self, i: int, step: int) -> int | None:
        """Next leaf with text in the direction of ``step``."""
        i += step
        while 0 <= i < len(self.leaves):
            if self.leaves[i]:
                return i
            i += step
        return None

    def edit(self, start: int, end: int, new: bytes, c) -> None:
        """Replace bytes ``start`` to ``end`` by ``new`` and count again around them."""
        if not self.leaves:
            self.leaves.append(b"")
        a, x = self.find(start)
        b, y = self.find(max(end, start))
        while 0 < x < len(self.leaves[a]) and self.leaves[a][x] & 0xC0 == 0x80:
            x -= 1
        while 0 < y < len(self.leaves[b]) and self.leaves[b][y] & 0xC0 == 0x80:
            y -= 1
        if (a, x) > (b, y):
            b, y = a, x
        text = self.leaves[a][:x] + new + self.leaves[b][y:]
        own = [i for i in range(a, b + 1)]
        left, right = self.beside(a, -1), self.beside(b, 1)
        while left is not None and not boundary(c, self.leaves[left], text):
            text = self.leaves[left] + text
            own.append(left)
            left = self.beside(left, -1)
        while right is not None and not boundary(c, text, self.leaves[right]):
            text += self.leaves[right]
            own.append(right)
            right = self.beside(right, 1)
        self.encoded += len(text)
        ids, _ = c.encode([text])
        first = min(own)
        for i in own:
            if i != first and self.leaves[i]:
                self.put(i, b"", 0)
        self.put(first, text, len(ids))


def boundary(c, left: bytes, right: bytes) -> bool:
    """Is there a forced boundary between two texts, also as to special tokens?"""
    if not left or not right or not c.cuts[left[-1] << 8 | right[0]] or c.ends_in_wide_space(left):
        return False
    if not c.longest_special:
        return True
    around = left[-c.longest_special :] + right[: c.longest_special]
    return not any(s in around for s in c.specials)


def cut_leaves(texts: list[bytes], c) -> tuple[list[list[bytes]], list[np.ndarray]]:
    """Leaves of all texts and the tokens of each; all are encoded together."""
    buf, starts, first = c.fragments(texts)
    leaves, owner = [], []
    for k, t in enumerate(texts):
        at = starts[first[k] : first[k + 1]]
        marked = any(s in t for s in c.specials)  # a text with special tokens is one leaf
        cut = at[:1].tolist() if marked else at[::LEAF].tolist()
        end = int(at[0]) + len(t) if len(at) else 0
        leaves += [buf[s:e] for s, e in zip(cut, [*cut[1:], end])]
        owner.append(len(cut))
    n = np.diff(c.encode(leaves)[1]) if leaves else np.empty(0, np.int64)
    ends = np.cumsum([0, *owner])
    return [leaves[lo:hi] for lo, hi in zip(ends, ends[1:])], [n[lo:hi] for lo, hi in zip(ends, ends[1:])]


def trees(texts: list[bytes], c) -> list[SegmentTree]:
    return [SegmentTree(leaves, n) for leaves, n in zip(*cut_leaves(texts, c))]


#: Columns of a kept tree: the text, and byte length and tokens of each leaf.
TREE = "text binary, lengths array<int>, tokens array<int>"


def _lists(parts: list[np.ndarray]) -> pa.Array:
    at = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(parts) if parts else np.empty(0), pa.int32(), from_pandas=False))


def build(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A tree for each document: ``doc_id``, ``text``, ``lengths`` and ``tokens`` of its
    leaves, and ``n_built``, the bytes encoded. Meant to be written to a table."""
    src = docs.select(F.col(doc_id).alias("doc_id"), utf8(F.col(text)).alias("text"))

    def work(rows, texts):
        leaves, n = cut_leaves(texts, codec(tokenizer_path))
        return {
            "doc_id": rows.column("doc_id"), "text": rows.column("text"), "lengths": _lists([np.array([len(x) for x in own], np.int32) for own in leaves]),
            "tokens": _lists([x.astype(np.int32) for x in n]), "n_built": pa.array([len(t) for t in texts], pa.int64()),
        }

    work.__module__ = codec.__module__  # works with that module's tables
    return map_text(src, work, f"doc_id {_kind(src)}, {TREE}, n_built long")


def _kind(df: DataFrame) -> str:
    return df.schema["doc_id"].dataType.simpleString()


def recount(kept: DataFrame, edits: DataFrame, tokenizer_path: str) -> DataFrame:
    """The trees after the edits, in the columns of :func:`build`, so that the result can be
    written and edited again, with ``n_before`` and ``n_after`` (tokens), ``n_bytes`` (of
    the text after) and ``n_encoded`` (bytes encoded for the edits).

    ``edits`` has ``doc_id``, ``seq``, ``start``, ``end``, ``new``.
    """
    listed = edits.where("doc_id is not null").groupBy(F.col("doc_id").alias("of")).agg(F.array_sort(F.collect_list(F.struct("seq", "start", "end", utf8(F.col("new")).alias("new")))).alias("edits"))
    return _apply(kept.join(listed, F.col("doc_id") == F.col("of"), "left").select(*kept.columns, "edits"), tokenizer_path)


def recount_inline(kept: DataFrame, tokenizer_path: str, edits) -> DataFrame:
    """Like :func:`recount`, for edits that are a column over the trees themselves: an
    array of (seq, start, end, new as bytes). No shuffle."""
    return _apply(kept.withColumn("edits", edits), tokenizer_path)


def _apply(src: DataFrame, tokenizer_path: str) -> DataFrame:
    def work(rows, texts):
        c = codec(tokenizer_path)
        before, after, size, again, text, lengths, tokens = [], [], [], [], [], [], []
        todo = rows.column("edits").to_pylist()
        for i, (t, own, n) in enumerate(zip(texts, _each(rows.column("lengths")), _each(rows.column("tokens")))):
            before.append(int(n.sum()))
            if not todo[i]:
                for to, value in ((after, before[-1]), (size, len(t)), (again, 0), (text, t), (lengths, own), (tokens, n)):
                    to.append(value)
                continue
            ends = np.cumsum([0, *own.tolist()]).tolist()
            tree = SegmentTree([t[lo:hi] for lo, hi in zip(ends, ends[1:])], n)
            for e in todo[i]:
                tree.edit(e["start"] or 0, e["end"] or 0, e["new"] or b"", c)
            now = np.array([len(x) for x in tree.leaves], np.int32)
            full = np.flatnonzero(now)
            for to, value in ((after, tree.total), (size, int(now.sum())), (again, tree.encoded), (text, b"".join(tree.leaves)), (lengths, now[full]), (tokens, tree.tokens[0][full])):
                to.append(value)
        cols = {"n_before": before, "n_after": after, "n_bytes": size, "n_encoded": again}
        kept = {"doc_id": rows.column("doc_id"), "n_built": rows.column("n_built"), "text": pa.array(text, pa.binary()), "lengths": _lists(lengths), "tokens": _lists(tokens)}
        return kept | {k: pa.array(v, pa.int64()) for k, v in cols.items()}

    work.__module__ = codec.__module__
    return map_text(src, work, f"doc_id {_kind(src)}, {TREE}, n_built long, n_before long, n_after long, n_bytes long, n_encoded long")


def _each(col: pa.Array) -> list[np.ndarray]:
    at = col.offsets.to_numpy()
    flat = col.flatten().to_numpy()
    return [flat[lo - at[0] : hi - at[0]] for lo, hi in zip(at, at[1:])]
