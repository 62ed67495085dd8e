"""N-gram Jaccard join by a token-group matrix.

A document's set holds its distinct five-word shingles (words lower-cased A-Z only; with
fewer words the whole sequence is the one shingle), as 64-bit hashes. Documents link
when 100 * intersection >= 75 * union.

Documents of equal sets form one class, which has a number of its own from there on;
only at the end classes become ids again, so texts that share an id stay apart.
Each set is sketched by its ``SKETCH`` smallest hashes, the whole set if it has no more.
Linked sets share at least ``shared(n)`` hashes of their sketches: for whole sets by
arithmetic, beyond that but for a chance under 4e-11 for a pair right at the threshold,
less for any pair above it. So they also share one of the ``k - shared(n) + 1`` rarest
hashes of either sketch (``k`` its length, the order the same everywhere): hashes that
no other sketch has come first and are never shuffled again, and passages common to
many documents come last and fall away.

1. Groups. Each document is compared, whole text to whole text, to one pivot: of the
   documents met under these hashes the one that shares most with it, where every hash
   offers its most typical document, whose sketch has the fewest hashes of its own. An
   original so is the pivot of its copies. The pivot is the document's group; links found
   connect a group already.
2. Matrix. Groups are cut into blocks of about ``BLOCK_SHINGLES`` shingles, linked and
   other members apart. The matrix holds which block has which rare hash; two blocks that
   share one and are not of one component yet are held against each other in a task. The
   bound comes first: a document of one block can link into the other only if three
   quarters of its shingles are in the other's union. Only documents that pass are opened,
   and of those only members of different components are compared, by one product of
   their shingle matrices.
3. Links from both steps join the documents into components.

A group of near copies so costs one comparison a document; those its pivot does not link
meet the others block by block, never as rows of pairs. Null, empty and white-space
texts have empty sets and link with nothing; rows that repeat a text are in one class,
rows that repeat an id are judged by their own texts each; an empty table gives no rows; a null id never labels a component unless all of its
documents have none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guidepost.llm.common import begin, give_back, holds, map_text, mix64, store, utf8
from guidepost.llm.components import components
from guidepost.session import scratch_path

WORDS = 5
SKETCH = 128
#: Shared hashes of two long sketches at least: below that with a chance of 3.3e-11 at similarity 0.75.
LEAST_SHARED = 62
#: Shingles in a block, about; each document counts 64 more, so a block has at most some 256.
BLOCK_SHINGLES = 16_384
#: Words that a task remembers the hashes of.
CACHE_WORDS = 200_000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_HASHES = _Hashes()
holds(__name__, _HASHES.clear)


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    if len(_HASHES) > CACHE_WORDS:
        _HASHES.clear()
    words = [t.lower().split() for t in texts]  # bytes: A-Z only, ASCII white space
    counts = [len(w) for w in words]
    flat = np.fromiter((_HASHES[w] for ws in words for w in ws), np.uint64, sum(counts))
    odd = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]
    grams = np.empty(0, np.uint64)
    if len(flat) >= WORDS:
        m = len(flat) - WORDS + 1
        grams = np.zeros(m, np.uint64)
        for k in range(WORDS):
            grams += mix64(flat[k : k + m] * odd[k])
        grams = mix64(grams)
    out, at = [], 0
    for n in counts:
        if n >= WORDS:
            out.append(np.unique(grams[at : at + n - WORDS + 1]))
        elif n:
            whole = np.full(1, n, np.uint64)
            for k in range(n):
                whole = mix64(whole + flat[at + k : at + k + 1] * odd[k])
            out.append(whole)
        else:
            out.append(np.empty(0, np.uint64))
        at += n
    return out


def text_digest(text: Column) -> dict[str, Column]:
    """Two hashes of the whole text, which tell rows of one id apart."""
    return {"t1": F.xxhash64(utf8(text)), "t2": F.xxhash64(F.lit("second"), utf8(text))}


def facts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``t1`` and ``t2`` of the text, set size ``n``, a 128-bit digest ``h1``,
    ``h2`` of the set, ``sketch``."""
    src = docs.select(F.col(doc_id).alias("doc_id"), utf8(F.col(text)).alias("text")).withColumns(text_digest(F.col("text")))

    def work(rows, texts):
        sets = shingle_sets(texts)
        h = [(int(mix64(s).sum()), int(np.bitwise_xor.reduce(mix64(s + np.uint64(1))))) if len(s) else (0, 0) for s in sets]
        digest = np.array(h, np.uint64).reshape(-1, 2).view(np.int64)
        parts = [s[:SKETCH] for s in sets]
        at = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
        flat = np.concatenate(parts) if parts else np.empty(0, np.uint64)
        return {
            "doc_id": rows.column("doc_id"),
            "t1": rows.column("t1"),
            "t2": rows.column("t2"),
            "n": np.array([len(s) for s in sets], np.int64),
            "h1": digest[:, 0].copy(),
            "h2": digest[:, 1].copy(),
            "sketch": pa.ListArray.from_arrays(pa.array(at), pa.array(flat.view(np.int64))),
        }

    return map_text(src, work, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, t1 long, t2 long, n long, h1 long, h2 long, sketch array<long>")


def shared(n: Column) -> Column:
    """Hashes that the sketch of a set of ``n`` shares at least with that of a linked set."""
    beyond = F.floor(n * 4 / 3) - SKETCH  # hashes that a linked set may have outside its sketch
    whole = F.ceil(n * 3 / 4)
    return F.when(n > SKETCH, LEAST_SHARED).when(beyond > 0, F.greatest(whole - beyond, F.lit(LEAST_SHARED))).otherwise(whole).cast("int")


def fits(a: Column, b: Column) -> Column:
    """Can sets of these sizes reach the threshold?"""
    return (4 * F.least(a, b) >= 3 * F.greatest(a, b))


def rare_hashes(reps: DataFrame) -> DataFrame:
    """(token, doc, n, alone): of the rarest hashes of each sketch those that other sketches
    have, with the share of the sketch that no other has."""
    all_tokens = reps.select("doc", "n", F.size("sketch").alias("k"), F.explode("sketch").alias("token"))
    often = all_tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    met = all_tokens.join(often, "token")
    mine = met.groupBy("doc").agg(F.first("n").alias("n"), F.first("k").alias("k"), F.array_sort(F.collect_list(F.struct("df", "token"))).alias("own"))
    # the hashes that only this sketch has are rarer still and use up the first places
    left = F.greatest(F.lit(0), F.col("k") - shared(F.col("n")) + 1 - (F.col("k") - F.size("own")))
    alone = 1 - F.size("own") / F.col("k")
    return mine.select("doc", "n", alone.alias("alone"), F.explode(F.slice("own", 1, left)).alias("o")).select("o.token", "doc", "n", "alone")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the threshold."""
    one = texts.select(F.col("doc").alias("a"), F.col("text").alias("ta"))
    two = texts.select(F.col("doc").alias("b"), F.col("text").alias("tb"))
    both = pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", F.length("ta").alias("la"), F.concat("ta", "tb").alias("text"))

    def run(batches):
        from guidepost.llm.common import steps

        begin(__name__)
        for rows, joined in steps(batches):
            cut = rows.column("la").to_pylist()
            xs = shingle_sets([t[:c] for t, c in zip(joined, cut)])
            ys = shingle_sets([t[c:] for t, c in zip(joined, cut)])
            ok = []
            for x, y in zip(xs, ys):
                inter = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * inter >= 75 * (len(x) + len(y) - inter) and inter > 0)
            kept = rows.filter(pa.array(ok))
            yield pa.RecordBatch.from_arrays([kept.column("a"), kept.column("b")], names=["a", "b"])

    kind = pairs.schema["a"].dataType.simpleString()
    return both.mapInArrow(run, f"a {kind}, b {kind}")


def matrix_links(pairs: DataFrame, blocks: DataFrame) -> DataFrame:
    """Links (a, b) between members of each pair of blocks (p, q) that are in different
    components; ``blocks`` has members (doc, group, text)."""
    one = blocks.select(F.col("block").alias("p"), F.col("members").alias("left"))
    two = blocks.select(F.col("block").alias("q"), F.col("members").alias("right"))
    met = pairs.join(one, "p").join(two, "q").select("p", "q", "left", "right")

    def run(batches):
        begin(__name__)
        for batch in batches:
            for i in range(batch.num_rows):  # one pair of blocks at a time
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                a, b = _block_links(row["left"], row["right"], row["p"] == row["q"])
                row = None
                yield pa.RecordBatch.from_arrays([pa.array(a, kind), pa.array(b, kind)], names=["a", "b"])
        give_back()

    from pyspark.sql.pandas.types import to_arrow_type

    doc = blocks.schema["members"].dataType.elementType["doc"].dataType
    kind = to_arrow_type(doc)
    return met.mapInArrow(run, f"a {doc.simpleString()}, b {doc.simpleString()}")


def _block_links(left: list[dict], right: list[dict], same: bool) -> tuple[list, list]:
    xs, ys = shingle_sets([m["text"] for m in left]), shingle_sets([m["text"] for m in right])
    ux, uy = np.unique(np.concatenate(xs)), np.unique(np.concatenate(ys))
    both = np.intersect1d(ux, uy, assume_unique=True)

    def opened(sets):
        """Members that pass the bound, as a 0/1 matrix over the shared shingles."""
        own = [np.searchsorted(both, s[np.isin(s, both, assume_unique=True)]) for s in sets]
        keep = [i for i, (s, o) in enumerate(zip(sets, own)) if len(s) and 4 * len(o) >= 3 * len(s)]
        rows = np.zeros((len(keep), len(both)), np.float32)
        for k, i in enumerate(keep):
            rows[k, own[i]] = 1
        return keep, rows

    kx, mx = opened(xs)
    ky, my = opened(ys)
    if not kx or not ky:
        return [], []
    common = (mx @ my.T).astype(np.int64)
    size = np.array([len(xs[i]) for i in kx])[:, None] + np.array([len(ys[j]) for j in ky])[None, :]
    groups: dict = {}
    gx, gy = (np.array([groups.setdefault(m[i]["group"], len(groups)) for i in k]) for m, k in ((left, kx), (right, ky)))
    link = (100 * common >= 75 * (size - common)) & (gx[:, None] != gy[None, :])
    i, j = np.nonzero(np.triu(link, 1) if same and kx == ky else link)
    # one link joins two components as well as all of them do
    _, first = np.unique(np.stack([gx[i], gy[j]]), axis=1, return_index=True) if len(i) else (None, [])
    return [left[kx[i[f]]]["doc"] for f in first], [right[ky[j[f]]]["doc"] for f in first]


def labelled(docs: DataFrame, links: DataFrame) -> DataFrame:
    """``doc`` and its ``group``: the component by ``links``, itself without any."""
    comp = components(links.select(F.col("a").alias("src"), F.col("b").alias("dst"))).select(F.col("node").alias("doc"), "component")
    return docs.join(comp, "doc", "left").withColumn("group", F.coalesce("component", "doc")).drop("component")


def join_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of every row."""
    return row_components(docs, doc_id, text).select("doc_id", "n_shingles", "component_id")


def row_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``join_components`` with the digest ``t1``, ``t2`` of each row's text and in ``first``
    the (doc_id, t1, t2) that stands for its component: the smallest. Null for rows that
    are in none."""
    spark = docs.sparkSession
    root = scratch_path(spark, "jaccard")

    def stored(df: DataFrame, name: str) -> DataFrame:
        return store(df, f"{root}/{name}")

    known = stored(facts(docs, doc_id, text), "facts")
    classes = known.where("n > 0 and doc_id is not null").groupBy("h1", "h2", "n").agg(F.min(F.struct("doc_id", "t1", "t2")).alias("row"), F.max("sketch").alias("sketch"))
    reps = stored(classes.withColumn("doc", F.monotonically_increasing_id()), "reps")  # numbers hold once written
    tokens = stored(rare_hashes(reps), "tokens")
    ids = tokens.select("doc").distinct().join(reps, "doc").select("doc", "row.*")
    own = docs.select(F.col(doc_id).alias("doc_id"), utf8(F.col(text)).alias("text")).where("doc_id is not null").withColumns(text_digest(F.col("text")))
    texts = stored(one_text(own.join(ids, ["doc_id", "t1", "t2"])), "texts")

    # 1. groups around the most typical document of each hash
    best = tokens.groupBy("token").agg(F.min(F.struct("alone", "doc", "n")).alias("best"), F.count("*").alias("df")).where("df > 1")
    near = tokens.join(best, "token").where((F.col("doc") != F.col("best.doc")) & (F.struct("alone", "doc") > F.struct("best.alone", "best.doc")))
    near = near.where(fits(F.col("n"), F.col("best.n"))).groupBy("doc", "best").agg(F.count("*").alias("c"))
    near = stored(near.groupBy(F.col("doc").alias("a")).agg(F.max_by("best.doc", F.struct("c", -F.col("best.alone"))).alias("b")), "near")
    first = stored(verified(near, texts), "first")
    docs_met = tokens.groupBy("doc").agg(F.first("n").alias("n"))
    grouped = stored(labelled(docs_met, first), "groups")

    # 2. blocks of the groups, and which of them share rare hashes
    home = grouped.join(near.withColumnRenamed("a", "doc"), "doc", "left").withColumn("pivot", F.coalesce("b", "doc"))
    of_pivot = grouped.select(F.col("doc").alias("pivot"), F.col("group").alias("pivot_group"))
    home = home.join(of_pivot, "pivot", "left").withColumn("linked", F.coalesce(F.col("group") == F.col("pivot_group"), F.lit(False)))
    size = home.groupBy("pivot", "linked").agg(F.ceil(F.sum(F.col("n") + 64) / BLOCK_SHINGLES).alias("blocks"))
    home = home.join(size, ["pivot", "linked"]).withColumn("block", F.xxhash64("pivot", "linked", F.pmod(F.xxhash64("doc"), F.col("blocks"))))
    members = stored(home.select("doc", "n", "group", "block"), "members")
    held = tokens.select("token", "doc").join(members, "doc").groupBy("token", "block")
    matrix = held.agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min("group").alias("g0"), F.max("group").alias("g1"))
    shared_by = matrix.groupBy("token").agg(F.min("g0").alias("least"), F.max("g1").alias("most")).where("least <> most").select("token")
    matrix = stored(matrix.join(shared_by, "token"), "matrix")
    one = matrix.select("token", *[F.col(c).alias(f"{c}_p") for c in ("block", "low", "high", "g0", "g1")])
    two = matrix.select("token", *[F.col(c).alias(f"{c}_q") for c in ("block", "low", "high", "g0", "g1")])
    met = one.join(two, "token").where((F.col("block_p") <= F.col("block_q")) & (F.least("g0_p", "g0_q") != F.greatest("g1_p", "g1_q")))
    met = met.where((4 * F.col("high_p") >= 3 * F.col("low_q")) & (4 * F.col("high_q") >= 3 * F.col("low_p")))
    pairs = stored(met.select(F.col("block_p").alias("p"), F.col("block_q").alias("q")).distinct(), "pairs")
    asked = pairs.select(F.col("p").alias("block")).unionByName(pairs.select(F.col("q").alias("block"))).distinct()
    inside = members.join(asked, "block", "left_semi").join(texts, "doc")
    blocks = inside.groupBy("block").agg(F.collect_list(F.struct("doc", "group", "text")).alias("members"))

    # 3. links between documents of different components
    second = matrix_links(pairs, blocks)
    links = stored(first.unionByName(second), "links")
    comp = labelled(grouped.select("doc"), links)
    of_class = reps.select("h1", "h2", "n", "row", "doc").join(comp, "doc", "left").withColumn("group", F.coalesce("group", "doc"))
    firsts = of_class.groupBy("group").agg(F.min("row").alias("first"))
    of_class = of_class.select("h1", "h2", "n", "group").join(firsts, "group").drop("group")
    out = known.select("doc_id", "t1", "t2", "n", "h1", "h2").join(of_class, ["h1", "h2", "n"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("first.doc_id", "doc_id").alias("component_id"), "t1", "t2", "first")


def one_text(texts: DataFrame) -> DataFrame:
    """One text for each class; rows that repeat have equal ones."""
    return texts.groupBy("doc").agg(F.min("text").alias("text"))
