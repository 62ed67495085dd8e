"""Dictionaries as tables: any number of phrases looked up in texts by equality.

The functions of :mod:`text` and :mod:`matching` turn each keyword of a short literal list
into a branch of one expression. Here phrases are rows. Texts and phrases are read as
words (lower case, runs of letters, digits and underscores); a phrase is found where its
words stand one after another. A text's word groups of the lengths that occur in the
dictionary are joined to it, so work grows with the texts, not with texts times phrases.

Rows of a dictionary that say the same of one phrase are folded first. A dictionary of at
most ``BROADCAST_PHRASES`` rows (it is counted) goes to the tasks; a
larger one is joined on the phrase, after each text's equal word groups are one row, and
with a salt, since a phrase may stand in a third of all texts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_PHRASES = 100_000
SALTS = 16


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+"), lambda w: w != "")


def phrase(text: Column) -> Column:
    """Words with one blank between."""
    return F.array_join(words(text), " ")


def word_groups(text: Column, lengths: Sequence[int]) -> Column:
    """All groups of so many consecutive words, written as phrases."""
    from ..functions.periods import let

    group = lambda ws, n: F.transform(F.sequence(F.lit(1), F.greatest(F.size(ws) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(ws, i, n), " "))
    empty = F.array().cast("array<string>")
    return let(words(text), lambda ws: F.concat(empty, *[F.when(F.size(ws) >= n, group(ws, n)).otherwise(empty) for n in lengths]))


def find_phrases(texts: DataFrame, ident: str, text: str, dictionary: DataFrame, keyword: str) -> DataFrame:
    """(``ident``, ``phrase``, ``hits``, and the dictionary's columns) of every row of the
    dictionary found in a text. Keywords without a word are never found, and neither is
    anything in texts without an id; rows that repeat an id count as one text."""
    d = dictionary.withColumn("phrase", phrase(F.col(keyword))).filter("phrase <> ''")
    rows = {r["n"]: r["count"] for r in d.groupBy(F.size(F.split("phrase", " ")).alias("n")).count().collect()}  # by length of phrase
    lengths = sorted(rows)
    if not lengths:
        return texts.limit(0).select(ident, F.lit("").alias("phrase"), F.lit(0).cast("long").alias("hits")).join(d.drop("phrase"), how="cross")
    groups = texts.filter(F.col(ident).isNotNull()).select(ident, F.explode(word_groups(F.col(text), lengths)).alias("phrase"))
    if sum(rows.values()) <= BROADCAST_PHRASES:
        known = groups.join(F.broadcast(d.select("phrase").distinct()), "phrase", "left_semi")
        return known.groupBy(ident, "phrase").agg(F.count("*").alias("hits")).join(F.broadcast(d), "phrase")
    once = groups.groupBy(ident, "phrase").agg(F.count("*").alias("hits")).withColumn("__salt", F.pmod(F.xxhash64(ident), F.lit(SALTS)))
    copies = d.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    # the size of a file says little about its rows here, less about their copies: nothing may go to all tasks
    return once.join(copies.hint("merge"), ["phrase", "__salt"]).drop("__salt")


def tag_by_table(texts: DataFrame, ident: str, text: str, dictionary: DataFrame) -> DataFrame:
    """(``ident``, ``type``, ``name``, ``keyword``, ``hits``): for each tag of a text the
    first of its keywords by ``ord``, and how often all of them occur.

    ``dictionary`` has ``type``, ``name``, ``keyword`` and ``ord``.
    """
    # rows that say the same are one with their number, so no text meets each of them
    one = dictionary.groupBy("type", "name", phrase(F.col("keyword")).alias("p")).agg(F.min(F.struct("ord", "keyword")).alias("first"), F.count("*").alias("rows"))
    found = find_phrases(texts, ident, text, one.select("type", "name", "first.keyword", "first.ord", "rows"), "keyword")
    return found.groupBy(ident, "type", "name").agg(F.min_by("keyword", F.struct("ord", "keyword")).alias("keyword"), F.sum(F.col("hits") * F.col("rows")).alias("hits"))


def detect_by_table(texts: DataFrame, ident: str, text: str, aliases: DataFrame) -> DataFrame:
    """Every text with ``codes`` (all codes with an alias in it, by their least ``ord``) and
    ``first_code``. ``aliases`` has ``code``, ``alias`` and ``ord``."""
    same = aliases.groupBy("code", phrase(F.col("alias")).alias("p")).agg(F.min("alias").alias("alias"), F.min("ord").alias("ord")).drop("p")
    found = find_phrases(texts, ident, text, same, "alias")
    one = found.groupBy(ident, "code").agg(F.min("ord").alias("ord"))
    codes = one.groupBy(ident).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "code"))), lambda x: x["code"]).alias("codes"))
    got = texts.select(ident).join(codes, ident, "left")
    codes = F.coalesce("codes", F.array().cast(one.select(F.collect_list("code")).schema[0].dataType))
    return got.select(ident, codes.alias("codes"), F.try_element_at(codes, F.lit(1)).alias("first_code"))


def resolve_by_table(names: DataFrame, name: str, aliases: DataFrame) -> DataFrame:
    """Names with ``resolved``: the code of the equal alias, else of the first alias (by
    ``ord``) that stands in the name or that the name stands in, else the name itself.

    ``aliases`` has ``alias``, ``code`` and ``ord``. Distinct names are looked up once.
    """
    asked = names.select(F.col(name).alias("name")).filter(F.col("name").isNotNull()).distinct()
    a = aliases.select("alias", "code", "ord").withColumn("akey", phrase(F.col("alias"))).filter("akey <> ''")
    # the alias in the name, equal ones too
    inside = find_phrases(asked, "name", "name", a.select("alias", "code", "ord", "akey"), "alias").withColumn("tier", F.when(F.col("phrase") == phrase(F.col("name")), 1).otherwise(2))
    # the name in a longer alias
    keyed = asked.withColumn("keyword", F.col("name"))
    long = a.select("alias", "code", "ord").withColumn("id", F.struct("ord", "alias", "code"))
    around = find_phrases(long.select("id", "alias"), "id", "alias", keyed, "keyword").select("name", F.col("id.ord").alias("ord"), F.col("id.code").alias("code"), F.lit(2).alias("tier"))
    best = inside.select("name", "ord", "code", "tier").unionByName(around).groupBy("name").agg(F.min_by("code", F.struct("tier", "ord", "code")).alias("__code"))
    out = names.join(best.withColumnRenamed("name", "__name"), F.col(name) == F.col("__name"), "left")
    return out.withColumn("resolved", F.coalesce("__code", F.col(name))).drop("__name", "__code")
