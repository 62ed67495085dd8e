"""BPE encoding and decoding with forced boundaries.

A byte pair that occurs inside no vocabulary token can never be joined by a merge, so
a text may be cut there, the fragments encoded apart, and their ids put one after the
other. A cut must not disturb the pre-tokenizer either: its expression has no
look-behind and looks ahead only past white space, and it treats an apostrophe and the
letters after it as one word only at the start of a match. Cuts are therefore made
between whole characters, never after white space and never before an apostrophe;
everywhere else the expression goes on after the cut as it would have without it.

Fragments repeat far more often than texts do, so each task keeps a table of the
fragments seen, of bounded size. Null texts are empty and give no ids; texts of any
length are worked on whole; rows that repeat are encoded again.
"""

from __future__ import annotations

import json
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guidepost.llm.common import holds, map_text, utf8

#: Fragments that a task remembers at most.
CACHE_FRAGMENTS = 200_000


def byte_alphabet() -> dict[str, int]:
    """Character to byte of byte-level vocabularies: printable bytes stand for
    themselves, the others for the characters from U+0100 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class _Seen(dict):
    """Number of each fragment; a new one is learned when it is asked for."""

    def __init__(self, learn):
        super().__init__()
        self.learn = learn

    def __missing__(self, fragment: bytes) -> int:
        return self.learn(fragment)


class Codec:
    """Encoder and decoder of one byte-level tokenizer file."""

    def __init__(self, path: str):
        import tiktoken

        spec = json.load(open(path, encoding="utf-8"))
        model, pre = spec["model"], spec["pre_tokenizer"]
        if spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError("only byte-level files without normalizer and prefix space are supported")
        back = byte_alphabet()
        ranks = {bytes(back[c] for c in tok): i for tok, i in model["vocab"].items()}
        order = [ranks[bytes(back[c] for c in "".join(m.split(" ") if isinstance(m, str) else m))] for m in model["merges"]]
        if order != sorted(order):
            raise ValueError("merges must be in the order of their ids")
        self.specials = {a["content"].encode(): a["id"] for a in spec["added_tokens"]}
        if any(a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"] for a in spec["added_tokens"]):
            raise ValueError("added tokens with options are not supported")
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.bpe = tiktoken.Encoding("fragments", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.cuts = self.cut_table(ranks)
        self.longest_special = max(map(len, self.specials), default=0)
        self._forget()
        pieces = {i: b for b, i in ranks.items()} | {i: b for b, i in self.specials.items()}
        size = max(pieces) + 1
        parts = [pieces.get(i, b"") for i in range(size)]
        self.piece_len = np.array([len(p) for p in parts], np.int64)
        self.piece_at = np.concatenate([[0], np.cumsum(self.piece_len)[:-1]])
        self.piece_bytes = np.frombuffer(b"".join(parts), np.uint8)

    @staticmethod
    def cut_table(ranks) -> np.ndarray:
        """For each byte pair: may a text be cut inside it?"""
        free = np.ones((256, 256), bool)
        for tok in ranks:
            for a, b in zip(tok, tok[1:]):
                free[a, b] = False
        free[:, 0x80:0xC0] = False  # only between characters
        free[:, ord("'")] = False
        for b in (*range(0x09, 0x0E), *range(0x1C, 0x21)):
            free[b, :] = False
        return free.reshape(-1)

    def _forget(self) -> None:
        self.seen = _Seen(self._learn)
        self.at, self.len, self.flat = array("q"), array("i"), array("i")

    def _learn(self, fragment: bytes) -> int:
        text = fragment.decode("utf-8", "replace")
        word = text[1:] if text[:1] == " " else text
        ids = self.bpe.encode_single_piece(fragment) if word.isalpha() else self.bpe.encode_ordinary(text)
        k = self.seen[fragment] = len(self.at)
        self.at.append(len(self.flat))
        self.len.append(len(ids))
        self.flat.extend(ids)
        return k

    def _special(self, ident: int) -> int:
        if (key := (ident,)) not in self.seen:
            self.seen[key] = len(self.at)
            self.at.append(len(self.flat))
            self.len.append(1)
            self.flat.append(ident)
        return self.seen[key]

    @staticmethod
    def ends_in_wide_space(text: bytes) -> bool:
        """Is the last character white space beyond ASCII?"""
        return text[-2:] in (b"\xc2\x85", b"\xc2\xa0") or text[-3:] in WIDE_SPACES

    def fragments(self, texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
        """Joined texts, where fragments start, and the number of each text's first one."""
        buf = b"".join(texts)
        b = np.frombuffer(buf, np.uint8)
        mask = np.zeros(len(b) + 1, bool)
        if len(b) > 1:
            pair = b[:-1].astype(np.uint16) << np.uint16(8)
            pair |= b[1:]
            mask[1:-1] = self.cuts[pair] & ~wide_space_ends(b)[:-1]
        starts_at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        mask[starts_at] = True
        mask[len(b)] = False
        starts = np.flatnonzero(mask)
        return buf, starts, np.searchsorted(starts, starts_at)

    def _numbers(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        buf, starts, first = self.fragments(texts)
        at = starts.tolist()
        cut = map(buf.__getitem__, map(slice, at, [*at[1:], len(buf)]))
        return np.fromiter(map(self.seen.__getitem__, cut), np.int64, len(at)), first

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text's ids start."""
        if len(self.seen) > CACHE_FRAGMENTS:
            self._forget()
        marked = any(s in t for s in self.specials for t in texts)
        if marked:
            numbers, first = self._with_specials(texts)
        else:
            numbers, first = self._numbers(texts)
        # views of the tables, not copies: a call costs what its own texts cost
        at, lens = (np.frombuffer(a, t)[numbers].astype(np.int64) for a, t in ((self.at, np.int64), (self.len, np.int32)))
        ends = np.concatenate([[0], np.cumsum(lens)])
        ids = np.frombuffer(self.flat, np.int32)[np.repeat(at - ends[:-1], lens) + np.arange(ends[-1])]
        return ids, ends[first]

    def _with_specials(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        import re

        split = re.compile(b"(" + b"|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + b")").split
        numbers, first = [np.empty(0, np.int64)], [0]
        for t in texts:
            n = 0
            for part in split(t):
                if part in self.specials:
                    numbers.append(np.array([self._special(self.specials[part])]))
                    n += 1
                elif part:
                    numbers.append(self._numbers([part])[0])
                    n += len(numbers[-1])
            first.append(first[-1] + n)
        return np.concatenate(numbers), np.array(first)

    def decode(self, ids: np.ndarray, at: np.ndarray) -> list[str]:
        """Texts of the ids between the offsets ``at``; broken UTF-8 becomes U+FFFD,
        ids outside the vocabulary are left out."""
        ids = np.where((ids >= 0) & (ids < len(self.piece_len)), ids, -1)
        lens = np.where(ids < 0, 0, self.piece_len[ids])
        ends = np.concatenate([[0], np.cumsum(lens)])
        data = self.piece_bytes[np.repeat(self.piece_at[ids] - ends[:-1], lens) + np.arange(ends[-1])].tobytes()
        cut = ends[at].tolist()
        return [data[s:e].decode("utf-8", "replace") for s, e in zip(cut, cut[1:])]


#: White space beyond U+00FF.
WIDE_SPACES = [chr(c).encode() for c in (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


def wide_space_ends(b: np.ndarray) -> np.ndarray:
    """Where a white-space character beyond ASCII ends."""
    out = np.zeros(len(b), bool)
    out[1:] |= (b[:-1] == 0xC2) & ((b[1:] == 0x85) | (b[1:] == 0xA0))
    lead = np.flatnonzero((b[:-2] >= 0xE1) & (b[:-2] <= 0xE3)) if len(b) > 2 else np.empty(0, int)
    if len(lead):
        code = (b[lead].astype(np.int32) << 16) | (b[lead + 1].astype(np.int32) << 8) | b[lead + 2]
        spaces = [int.from_bytes(c, "big") for c in WIDE_SPACES]
        out[lead[np.isin(code, spaces)] + 2] = True
    return out


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


holds(__name__, codec.cache_clear)


def _id_lists(ids: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids, pa.int32()))


def encode(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``ids``: the token ids of each whole text, one row per input row."""
    src = docs.select(F.col(doc_id).alias("doc_id"), utf8(F.col(text)).alias("text"))

    def work(rows, texts):
        return {"doc_id": rows.column("doc_id"), "ids": _id_lists(*codec(tokenizer_path).encode(texts))}

    return map_text(src, work, f"doc_id {_type(docs, doc_id)}, ids array<int>")


def decode(encoded: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``doc_id``, ``decoded``: the text of each row's ids; null ids give an empty text."""
    src = encoded.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(ids).cast("array<int>"), F.array().cast("array<int>")).alias("ids"))

    def run(batches):
        for rows in batches:
            col = rows.column("ids")
            at = col.offsets.to_numpy().astype(np.int64)
            flat = col.values.slice(at[0], at[-1] - at[0]).fill_null(-1).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(codec(tokenizer_path).decode(flat, at - at[0]), pa.string())], names=["doc_id", "decoded"])

    return src.mapInArrow(run, f"doc_id {_type(encoded, doc_id)}, decoded string")


def round_trip(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``ids`` and ``decoded`` (the text read back from the ids) in one pass.
    Texts that repeat near each other, as copies of a mix do, are encoded once."""
    src = docs.select(F.col(doc_id).alias("doc_id"), utf8(F.col(text)).alias("text"))

    def work(rows, texts):
        return {"doc_id": rows.column("doc_id")} | _read_back(codec(tokenizer_path), texts)

    return map_text(src, work, f"doc_id {_type(docs, doc_id)}, ids array<int>, decoded string")


def _read_back(c: Codec, texts: list[bytes]) -> dict[str, pa.Array]:
    """``ids`` and ``decoded`` of each text; equal texts are encoded once."""
    number = {t: k for k, t in enumerate(dict.fromkeys(texts))}
    ids, at = c.encode(list(number))
    row = pa.array([number[t] for t in texts], pa.int64())
    return {"ids": _id_lists(ids, at).take(row), "decoded": pa.array(c.decode(ids, at), pa.string()).take(row)}


def _type(df: DataFrame, name: str) -> str:
    return df.select(name).schema[0].dataType.simpleString()


def digests(encoded: DataFrame) -> DataFrame:
    """Token count and digests of a :func:`round_trip` result."""
    listed = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(listed.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
