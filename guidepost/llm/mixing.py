"""Mixing sources to target weights by entropy balancing, in DataFrame operations.

Sources share ``SHARE`` times all words by their weights; a source's target stops at
``CAP`` times its own words, and what it leaves is shared anew by weight (a level at
which all open sources stand is found from running sums over the sources).

Every document gets a rate between 0 and ``CAP``: the distribution of words closest in
relative entropy to the base rates, bounded, under one word constraint per source. Its
dual is convex with one multiplier per source; the rates are tilted exponentially,
``CAP q e^l / (CAP - q + q e^l)`` for base rate ``q``. Newton steps on the dual are
aggregations over (source, base rate) counts, pre-aggregated once from the documents.
Words, not documents, carry the entropy, so no length is preferred within a source.

Rates become copies by classes of nearly equal size (exact below 64 words, then 32 per
power of two). From the largest class down, a class takes the whole number of copies
nearest to its words plus what larger classes over- or undershot; at most some 1,900
classes per source and base rate are folded in one row. Inside a class copies are dealt
evenly over blocks of about ``BLOCK`` documents in the order of a hash of id and text,
or of the row's number where the id is null. Only rows that repeat one id and its text
meet in one task.

Null texts have size 0 and are never taken; a null source is a source, the last one;
rows that repeat are documents of their own; an empty table gives no rows. Reruns agree.
The sources' names and sums are ordered in one task: their number, not the documents'.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from guidepost.llm.common import store
from guidepost.llm.quality_rules import bucket
from guidepost.session import cut_lineage, scratch_path

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
CAP = 2
BLOCK = 256
ROUNDS = 50
TOLERANCE = 1e-12
GOLDEN = 0.6180339887498949


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \x09-\x0D]+")), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """Key of a source that is never null, for joins and grouping."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source.cast("string")))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """``key``, ``source_size`` and ``target`` of each source, from (key, source, size)."""
    per = sizes.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").cast("double").alias("s"))
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    per = per.select("key", "s", w.alias("w"), (cap * F.col("s")).alias("cap"))
    upto = W.orderBy(F.col("cap") / F.col("w"), "key").rowsBetween(W.unboundedPreceding, 0)
    every = W.partitionBy()
    per = per.select("*", F.sum("cap").over(upto).alias("caps"), F.sum("w").over(upto).alias("ws"), F.sum("w").over(every).alias("all_w"), (share * F.sum("s").over(every)).alias("total"))
    full = F.col("caps") + F.col("cap") / F.col("w") * (F.col("all_w") - F.col("ws")) <= F.col("total")
    per = per.withColumn("full", full)
    open_w = F.sum(F.when(~F.col("full"), F.col("w"))).over(every)
    left = F.col("total") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(every), F.lit(0.0))
    t = F.when(F.col("full"), F.col("cap")).otherwise(F.least(F.col("cap"), left * F.col("w") / open_w))
    return per.select("key", F.col("s").cast("long").alias("source_size"), t.alias("target"))


def rates(counts: DataFrame, goals: DataFrame, cap: int = CAP) -> DataFrame:
    """``key``, ``base`` and ``rate``: Newton's iterations on the dual, all sources at once.

    ``counts`` has the words of each (key, base). Sources at their cap, without words or
    without a target have their rates at the bounds.
    """
    rows = cut_lineage(counts.join(goals.select("key", F.col("source_size"), F.col("target")), "key"))
    dual = rows.select("key").distinct().withColumn("l", F.lit(0.0))
    q, l = F.col("base"), F.col("l")
    tilted = cap * q * F.exp(l) / (cap - q + q * F.exp(l))
    free = (F.col("target") > 0) & (F.col("target") < cap * F.col("source_size"))
    for _ in range(ROUNDS):
        r = F.col("words") * tilted
        step = (
            rows.where(free).join(dual, "key").groupBy("key")
            .agg(F.first("l").alias("l"), (F.sum(r) - F.first("target")).alias("g"), F.sum(r * (1 - tilted / cap)).alias("h"), F.first("target").alias("t"))
            .select("key", (l - F.greatest(F.lit(-2.0), F.least(F.lit(2.0), F.col("g") / F.col("h")))).alias("l"), F.abs(F.col("g") / F.col("t")).alias("off"))
        )
        dual = cut_lineage(step)
        off = dual.agg(F.max("off")).first()[0]
        if off is None or off < TOLERANCE:
            break
    got = rows.join(dual.select("key", "l"), "key", "left")
    rate = F.when(F.col("target") <= 0, 0.0).when(F.col("target") >= cap * F.col("source_size"), float(cap)).otherwise(tilted)
    return got.select("key", "base", F.round(rate, 10).alias("rate"))


def class_copies(classes: DataFrame, cap: int = CAP) -> DataFrame:
    """Copies ``k`` of each class (key, base, cls, n, words, rate), largest classes first."""
    folded = classes.groupBy("key").agg(F.reverse(F.array_sort(F.collect_list(F.struct("cls", "base", "n", "words", "rate")))).alias("cs"))

    def add(acc, c):
        want = c["rate"] * c["words"] + acc["carry"]
        mean = c["words"] / F.greatest(c["n"], F.lit(1))
        k = F.when(c["words"] <= 0, F.lit(0)).otherwise(F.greatest(F.lit(0), F.least(cap * c["n"], F.round(want / mean)))).cast("long")
        return F.struct((want - k * mean).alias("carry"), F.concat(acc["done"], F.array(F.struct(c["cls"].alias("cls"), c["base"].alias("base"), c["n"].alias("n"), k.alias("k")))).alias("done"))

    start = F.struct(F.lit(0.0).alias("carry"), F.array().cast("array<struct<cls:bigint,base:double,n:bigint,k:bigint>>").alias("done"))
    return folded.select("key", F.explode(F.aggregate("cs", start, add, lambda a: a["done"])).alias("c")).select("key", "c.*")


def deal_order(doc_id: Column, text: Column) -> Column:
    """Hash that deals rows into blocks: of id and text, so an id on many texts is spread
    too; rows without an id are told apart by their number."""
    return F.when(doc_id.isNotNull(), F.xxhash64(F.lit("mix"), doc_id, text)).otherwise(F.xxhash64(F.lit("mix"), F.monotonically_increasing_id()))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", base: str | None = None, carry: list[str] | None = None) -> DataFrame:
    """``doc_id``, ``size``, ``source_size``, ``target``, ``copies`` of every row, and in a
    struct ``carried`` the columns that ``carry`` names. ``base`` names a column of base rates, a few levels
    between 0 and the cap; without it every document starts at 1."""
    keep = [F.struct(*[F.col(c) for c in carry]).alias("carried")] if carry else []
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"), (F.col(base).cast("double") if base else F.lit(1.0)).alias("base"), deal_order(F.col(doc_id), F.col(text)).alias("order"), *keep)
    src = src.withColumns({"key": source_key(F.col("source")), "cls": bucket(F.col("size"))})
    root = scratch_path(docs.sparkSession, "mixing")
    src = store(src, f"{root}/rows")  # the texts are counted once; sums read narrow columns of it
    sizes = cut_lineage(src.groupBy("key", "base", "cls").agg(F.first("source").alias("source"), F.count("*").alias("n"), F.sum("size").alias("words")))
    goals = cut_lineage(targets(sizes.select("key", "source", F.col("words").alias("size"))))
    rate = rates(sizes.groupBy("key", "base").agg(F.sum("words").alias("words")), goals)
    plan = class_copies(sizes.join(rate, ["key", "base"])).join(goals, "key")
    # written, so that its size is known and a small one is broadcast; numbers hold once written
    plan = store(plan.withColumn("class", F.monotonically_increasing_id()), f"{root}/plan")
    # blocks of a class: how many, and the copies each one gets
    blocks = F.ceil(F.col("n") / BLOCK)
    dealt = src.join(plan, ["key", "base", "cls"])
    # dealt out by block, not by class as the join leaves them: a class may be large
    dealt = dealt.withColumn("block", F.pmod(F.col("order"), blocks)).repartition("class", "block")
    inside = W.partitionBy("class", "block")
    dealt = dealt.select("*", F.count("*").over(inside).alias("nb"), F.row_number().over(inside.orderBy("order", "doc_id")).alias("rn"))
    # a fraction of a copy is rounded at a threshold that walks evenly over the blocks
    walk = F.when(blocks == 1, 0.5).otherwise(F.pmod((F.col("block") + 1) * GOLDEN, F.lit(1.0)))
    kb = F.least(CAP * F.col("nb"), F.floor(F.col("nb") * F.col("k") / F.col("n") + walk)).cast("long")
    dealt = dealt.withColumn("kb", kb)
    copies = F.expr("rn * kb div nb - (rn - 1) * kb div nb")
    return dealt.select("doc_id", "size", "source_size", "target", copies.cast("int").alias("copies"), *(["carried"] if carry else []))
