"""Quality rules whose limits come from quantile sketches per language and source.

One pass over the texts gives the facts of every document (words, characters in words,
symbols, repeated lines, words in repeated five-word windows). Fixed base rules come
first. Of the documents that pass them, each measure is counted into a sketch: a
histogram with log-linear buckets (exact below 64, then 32 buckets per power of two,
so within 3.2 %). Such sketches merge by adding counts, in any order, and so give the
same limits on every run; a language's sketch is the sum of its sources', the whole
corpus' the sum of the languages'. A (language, source) pair with fewer than
``MIN_GROUP`` documents takes the limits of its language, and that those of all.

A measure is an outlier if it exceeds median + FENCE * (spread + slack), where the spread
is the larger of median - first decile and third quartile - median: where a quarter of a
source's documents carry signs or repeat lines, its limits follow them up to what passes
for a habit (``HABIT``), and junk of less than a quarter moves neither. Word length is also an outlier below
median - FENCE * (ninth decile - median + slack). Some units of each measure are free on
top, so that short texts don't fail by one sign.

Null and empty texts have no words and fail; null languages and sources are groups of
their own; rows that repeat each count; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from guidepost.llm.common import map_text, utf8
from guidepost.session import cut_lineage

MIN_GROUP = 200
FENCE = 4
#: Measures: numerator for each thousand words, slack in the same unit, free units.
MEASURES = {"symbols": ("n_symbols", 20, 5), "lines": ("n_dup_lines", 10, 2), "repeats": ("n_repeat_words", 25, 20), "chars": ("word_chars", 250, 20)}
#: The most that a third quartile can stand above the median and pass for a habit.
HABIT = {"symbols": 500, "lines": 50, "repeats": 50, "chars": 3000}
_SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\r\x0b\x0c"


def text_facts(raw: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one whole text."""
    text = raw.decode("utf-8", "replace")
    words = raw.split()
    n = len(words)
    chars = len(text) - sum(map(text.count, _SPACES))
    symbols = sum(map(text.count, _SYMBOLS))
    lines = Counter(line for line in raw.split(b"\n") if line.strip())
    again = sum(lines.values()) - len(lines)
    windows = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
    seen = set(windows)
    covered = 0
    if len(seen) < len(windows):
        often = Counter(windows)
        upto = 0
        for i, w in enumerate(windows):
            if often[w] > 1:
                covered += i + 5 - max(i, upto)
                upto = i + 5
    return n, chars, symbols, again, covered


def facts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``doc_id``, ``lang``, ``source`` and the facts of each row's whole text."""
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(source).alias("source"), utf8(F.col(text)).alias("text"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def work(rows, texts):
        found = list(zip(*map(text_facts, texts)))
        return {c: rows.column(c) for c in ("doc_id", "lang", "source")} | {n: list(v) for n, v in zip(names, found)}

    head = ", ".join(f"{c} {src.schema[c].dataType.simpleString()}" for c in ("doc_id", "lang", "source"))
    return map_text(src, work, head + ", " + ", ".join(f"{n} long" for n in names))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def bucket(v: Column) -> Column:
    """Smallest value of the log-linear bucket of a whole number from 0 on."""
    shift = F.greatest(F.length(F.bin(v)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, shift), shift)


def sketches(facts_df: DataFrame) -> DataFrame:
    """Bucket counts of each measure by language and source."""
    per = [F.struct(F.lit(m).alias("measure"), bucket(F.expr(f"1000 * {num} div n_words")).alias("b")) for m, (num, _, _) in MEASURES.items()]
    ok = facts_df.where(~base_failed())
    return ok.select("lang", "source", F.explode(F.array(*per)).alias("m")).groupBy("lang", "source", "m.measure", "m.b").agg(F.count("*").alias("n"))


def _quantiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """First decile, median, third quartile and ninth decile of each merged sketch of one group."""
    merged = sketch.groupBy(*keys, "measure", "b").agg(F.sum("n").alias("n"))
    at = W.partitionBy(*keys, "measure")  # at most some 1,900 buckets each
    ranked = merged.select("*", F.sum("n").over(at.orderBy("b")).alias("upto"), F.sum("n").over(at).alias("all"))
    q = lambda k: F.min(F.when(100 * F.col("upto") >= k * F.col("all"), F.col("b")))
    return ranked.groupBy(*keys, "measure").agg(q(10).alias("low"), q(50).alias("mid"), q(75).alias("upper"), q(90).alias("high"), F.max("all").alias("rows"))


def limits(sketch: DataFrame) -> DataFrame:
    """One row for each language and source: lower and upper limit of each measure."""
    one = _quantiles(sketch, ["lang", "source"])
    lang = _quantiles(sketch, ["lang"]).select(F.col("lang").alias("l"), F.col("measure").alias("m"), F.struct("low", "mid", "upper", "high", "rows").alias("of_lang"))
    every = _quantiles(sketch, []).select(F.col("measure").alias("a"), F.struct("low", "mid", "upper", "high", "rows").alias("of_all"))
    own = F.struct("low", "mid", "upper", "high", "rows")
    got = one.join(lang, F.col("lang").eqNullSafe(F.col("l")) & (F.col("measure") == F.col("m"))).join(F.broadcast(every), F.col("measure") == F.col("a"))  # four rows
    got = got.select("lang", "source", "measure", F.when(F.col("rows") >= MIN_GROUP, own).when(F.col("of_lang.rows") >= MIN_GROUP, F.col("of_lang")).otherwise(F.col("of_all")).alias("q"))
    slack = F.coalesce(*[F.when(F.col("measure") == m, s) for m, (_, s, _) in MEASURES.items()])
    habit = F.coalesce(*[F.when(F.col("measure") == m, h) for m, h in HABIT.items()])
    spread = F.greatest(F.col("q.mid") - F.col("q.low"), F.least(F.col("q.upper") - F.col("q.mid"), habit))
    got = got.select(
        "lang", "source", "measure",
        (F.col("q.mid") - FENCE * (F.col("q.high") - F.col("q.mid") + slack)).alias("least"),
        (F.col("q.mid") + FENCE * (spread + slack)).alias("most"),
    )
    pick = lambda m, c: F.max(F.when(F.col("measure") == m, F.col(c))).alias(f"{m}_{c}")
    return got.groupBy("lang", "source").agg(*[pick(m, "most") for m in MEASURES], pick("chars", "least"))


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Facts of every row, ``base_failed``, the measures found as outliers, ``kept``."""
    known = cut_lineage(facts(docs, doc_id, text, lang, source))  # one pass over the texts
    lim = limits(sketches(known)).withColumnsRenamed({"lang": "lim_lang", "source": "lim_source"})
    got = known.join(lim, F.col("lang").eqNullSafe(F.col("lim_lang")) & F.col("source").eqNullSafe(F.col("lim_source")), "left")
    per = F.col("n_words")
    over = [F.when(1000 * (F.col(num) - free) > F.col(f"{m}_most") * per, F.lit(m)) for m, (num, _, free) in MEASURES.items()]
    short = F.when(1000 * (F.col("word_chars") + MEASURES["chars"][2]) < F.col("chars_least") * per, F.lit("short words"))
    got = got.withColumn("outliers", F.array_compact(F.array(*over, short))).withColumn("base_failed", base_failed())
    return got.select(*known.columns, "base_failed", "outliers", (~F.col("base_failed") & (F.size("outliers") == 0)).alias("kept"))
