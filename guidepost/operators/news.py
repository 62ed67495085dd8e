"""News relevance gates, sentiment, three-step de-duplication and digests."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from itertools import chain, groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import lexicons as L
from ..functions.periods import let
from ..functions.values import content_signature, item_key, normalize_url, normalize_whitespace, parse_date, short_summary
from ..session import cut_lineage
from .ordered import keep_first
from .rows import computed_once
from .text import any_hit, detect, group_scores, hits, word_counts, word_hits


@dataclass(frozen=True)
class NewsLexicon:
    """Word lists of the relevance gates; company aliases are always the caller's."""

    companies: Mapping[str, Sequence[str]] = field(default_factory=dict)
    dimensions: Mapping[str, Sequence[str]] = field(default_factory=lambda: L.DIMENSION_WORDS)
    rules: Mapping[str, Sequence[str]] = field(default_factory=lambda: L.DIMENSION_RULE_WORDS)
    material: Sequence[str] = tuple(L.MATERIAL_WORDS)
    press: Sequence[str] = tuple(L.PRESS_WORDS)
    specific: Sequence[str] = tuple(L.SPECIFIC_WORDS)
    noise: Sequence[str] = tuple(L.NOISE_WORDS)
    positive: Sequence[str] = tuple(L.POSITIVE_WORDS)
    negative: Sequence[str] = tuple(L.NEGATIVE_WORDS)
    watch: Sequence[str] = tuple(L.WATCH_WORDS)
    sector: Sequence[str] = tuple(L.SECTOR_WORDS)
    world: Sequence[str] = tuple(L.WORLD_WORDS)
    impact: Sequence[tuple] = tuple(L.IMPACT_RULES)

    def lists(self) -> list[Sequence[str]]:
        """All word lists."""
        groups = [*self.companies.values(), *self.dimensions.values(), *self.rules.values(), *[ws for _, ws, _ in self.impact]]
        return [*groups, self.material, self.press, self.specific, self.noise, self.positive, self.negative, self.watch, self.sector, self.world]

    def words(self) -> list[str]:
        """All words of all lists, each once."""
        return list(dict.fromkeys(chain.from_iterable(self.lists())))


def union_sources(sources: Mapping[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """All feeds under one item schema with their bucket, and a count per bucket."""
    items = None
    for bucket, df in sources.items():
        part = df.withColumn("bucket", F.lit(bucket))
        items = part if items is None else items.unionByName(part, allowMissingColumns=True)
    return items, items.groupBy("bucket").agg(F.count("*").alias("n_items"))


def sentiment(text: Column, positive=L.POSITIVE_WORDS, negative=L.NEGATIVE_WORDS, watch=L.WATCH_WORDS, count=None) -> Column:
    return let(hits(text, positive, count) - hits(text, negative, count), lambda gap: (
        F.when((F.abs(gap) <= 1) & any_hit(text, watch, count), "Watch").when(gap >= 2, "Positive").when(gap <= -2, "Negative").otherwise("Neutral")))


def impact(text: Column, dimensions: Column, tone: Column, rules, count=None) -> Column:
    out = F.lit(None).cast("string")
    for dim, words, verdict in reversed(list(rules)):
        test = any_hit(text, words, count)
        if dim is not None:
            test = F.array_contains(dimensions, dim) & test
        out = F.when(test, verdict).otherwise(out)
    return F.coalesce(out, tone)


def _scanned(words: Sequence[str]) -> Column:
    """Lower-case text in which the same of ``words`` occur as in title, summary, content
    and source written one after the other.

    A summary that its content begins with is left out but for its ends, as long as the
    longest word: what a word could reach from the title or from the content. A character
    of no word stands between them.
    """
    k = max(map(len, words), default=0)
    gap = next(c for c in map(chr, range(1, 0xD800)) if not any(c in w for w in words))
    ends = F.concat(F.lower(F.substring("summary", 1, k)), F.lit(gap), F.lower(F.substring("summary", -k, k)))
    # the lower case of a capital sigma depends on what follows, also beyond a cut
    opens = F.startswith("content", F.col("summary")) & (F.length("summary") > 2 * k) & (F.instr("summary", "\u03a3") == 0)
    return F.concat_ws(" ", F.lower("title"), F.when(opens, ends).otherwise(F.lower("summary")), F.lower("content"), F.lower("source"))


def enrich(items: DataFrame, lex: NewsLexicon, as_of: str, match: str = "substring") -> DataFrame:
    """Signals, scores and ``drop_reason`` (null = accepted) for every item, no shuffle.

    ``match='word'`` counts noise words on whole words only.
    """
    text = F.lower(F.concat_ws(" ", "title", "summary", "content", "source"))
    # the text is read once for all words
    found, count = word_counts(_scanned(lex.words()), lex.lists())
    df = items.withColumn("found", found)
    df = df.withColumns({"title": normalize_whitespace(F.col("title")), "url": normalize_url(F.col("url")), "scoring_text": text})
    t = F.col("found")
    df = computed_once(df, {
        "company_tags": detect(t, lex.companies, count=count) if lex.companies else F.array().cast("array<string>"),
        "dims": group_scores(t, lex.dimensions, lex.rules, count=count), "materiality": hits(t, lex.material, count),
        "noise_hits": hits(t, lex.noise, count) if match == "substring" else word_hits(F.col("scoring_text"), lex.noise),
        "specificity": F.least(hits(t, lex.specific, count), F.lit(4)), "press": any_hit(t, lex.press, count),
        "in_world": any_hit(t, lex.world, count), "in_sector": any_hit(t, lex.sector, count), "linguistic_sentiment": sentiment(t, lex.positive, lex.negative, lex.watch, count),
    })
    n_comp = F.size("company_tags")
    df = df.withColumns({
        "dim_score": F.aggregate("dims", F.lit(0), lambda a, d: a + d["score"]),
        "dimensions": F.transform("dims", lambda d: d["name"]),
        "dimension_primary": F.get("dims", F.lit(0))["name"],
    })
    df = df.withColumns({
        "relevance_score": F.col("dim_score") * 2 + F.col("materiality") + F.when(n_comp > 0, 2).otherwise(0),
        "stage2_confidence": F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("dim_score") + F.col("materiality") + n_comp + F.col("specificity") - F.col("noise_hits") - F.when(F.col("press"), 2).otherwise(0)) / 12.0)),
    })
    stage2 = (
        F.when(F.col("noise_hits") >= 2, "hard_noise_pattern")
        .when((n_comp == 0) & (F.col("specificity") < 2), "no_company_no_specificity")
        .when(F.col("stage2_confidence") < 0.45, "low_stage2_confidence")
    )
    df = df.withColumns({
        "drop_reason": F.when((F.col("title") == "") | (F.col("url") == ""), "missing_title_or_url").when(F.col("press"), "press_release")
        .when(F.size("dims") == 0, "no_dimension").when(F.col("relevance_score") < 4, "low_relevance").otherwise(stage2),
        "market_scope": F.when(F.col("in_world"), "global").when(F.col("in_sector"), "sector").when(n_comp > 0, "company").otherwise("sector"),
        "sentiment": impact(t, F.col("dimensions"), F.col("linguistic_sentiment"), lex.impact, count),
        "published_date": parse_date(F.col("published_date"), as_of),
    })
    return df.drop("dims", "press", "in_world", "in_sector", "found")


def _served() -> dict[str, Column]:
    """Summary, citation and both content keys of an accepted item."""
    body = F.coalesce(F.nullif(F.col("summary"), F.lit("")), F.col("content"))
    return {
        "summary_2line": short_summary(body),
        "citation": F.concat(F.lit("["), "source", F.lit(" | "), "url", F.lit(" | "), "published_date", F.lit("]")),
        "uid": item_key(F.col("url"), F.col("title")),
        "content_signature": content_signature(F.col("title"), F.col("summary"), F.col("published_date")),
    }


def accept(enriched: DataFrame) -> DataFrame:
    """Accepted items with summary, citation and both content keys."""
    return enriched.filter("drop_reason is null").drop("drop_reason", "scoring_text").withColumns(_served())


def evidence_gate(items: DataFrame, fields: Sequence[str] = L.EVIDENCE_FIELDS, lists: Sequence[str] = ("dimensions",)) -> tuple[DataFrame, DataFrame]:
    """(rows with every mandatory field, count per missing field)."""
    blank = [F.when(F.trim(F.coalesce(F.col(f).cast("string"), F.lit(""))) == "", F.lit(f)) for f in fields]
    empty = [F.when(F.coalesce(F.size(f), F.lit(0)) <= 0, F.lit(f)) for f in lists]
    judged = items.withColumn("missing", F.filter(F.array(*blank, *empty), lambda m: m.isNotNull()))
    drops = judged.select(F.explode("missing").alias("field")).groupBy("field").agg(F.count("*").alias("n"))
    return judged.filter(F.size("missing") == 0).drop("missing"), drops


def exact_dedupe(items: DataFrame, order: Sequence[str]) -> DataFrame:
    """First item per key, then first per (day, signature)."""
    return keep_first(keep_first(items, ["uid"], order), ["published_date", "content_signature"], order)


# ---- fuzzy titles -------------------------------------------------------------------
#: Hash buckets that letter pairs are counted in.
PAIR_BUCKETS = 1 << 16
#: Characters of a title for which one more common rare letter pair is asked.
PAIR_CHARS = 20


def title_sets(items: DataFrame, ident: str, day: str, title: str) -> DataFrame:
    """Distinct token sets per day with their earliest item.

    Items with one token set score 100 against each other and relate alike to
    all others, so only the earliest can survive; copies are folded here, before
    any pairing.
    """
    tokens = F.array_sort(F.array_distinct(F.filter(F.split(F.col(title), r"\s+"), lambda w: w != "")))
    s = items.select(F.col(ident).alias("id"), F.col(day).alias("day"), tokens.alias("tokens")).filter(F.size("tokens") > 0)
    return s.groupBy("day", "tokens").agg(F.min("id").alias("id"))


def _chars() -> Column:
    """Length of a token set written out with single blanks."""
    return F.aggregate("tokens", F.lit(-1), lambda a, w: a + F.length(w) + 1)


def _same(a: str, b: str) -> Column:
    """Equality that a join doesn't take for one more key to sort its rows by."""
    return (F.col(a) >= F.col(b)) & (F.col(a) <= F.col(b))


def containment_candidates(sets: DataFrame, spare: float = 0.0) -> DataFrame:
    """(day, id, other) where all tokens of ``id`` but ``spare`` of its characters may be
    in ``other``. Its rarest tokens whose lengths add up to more than that are looked up:
    they can't all be missing. Frequent words are joined on only if a title has nothing
    rarer."""
    # the length is taken before the tokens are dealt out, not once for each of them; a
    # token goes by its hash with its day: a collision adds a candidate, none is lost
    tok = sets.withColumn("n", _chars()).select("day", "id", "n", F.explode("tokens").alias("token"))
    tok = tok.select("day", "id", "n", F.length("token").alias("len"), F.xxhash64("day", "token").alias("token"))
    df = tok.groupBy("token").agg(F.count("*").alias("df"))
    w = Window.partitionBy("day", "id").orderBy("df", "token")
    before = F.coalesce(F.sum("len").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    probe = tok.join(df, "token").withColumn("before", before).filter(F.col("before") <= spare * F.col("n")).select("day", "id", "token")
    met = probe.join(tok.select(F.col("day").alias("at"), F.col("id").alias("other"), "token"), "token")
    return met.filter(_same("day", "at") & (F.col("id") != F.col("other"))).select("day", "id", "other").distinct()


def _letter_pairs(tokens: Sequence[str]) -> list[str]:
    """Letter pairs inside tokens; the second and later of one kind carry their number."""
    pairs = sorted(x + y for w in tokens for x, y in zip(w, w[1:]))
    return [f"{g}{k}" if k else g for g, same in groupby(pairs) for k, _ in enumerate(same)]


def _bucket(pair: str) -> int:
    return zlib.crc32(pair.encode()) % PAIR_BUCKETS


def _pair_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros(PAIR_BUCKETS, "int64")
    for batch in batches:
        for g, n in Counter(chain.from_iterable(map(_letter_pairs, batch["tokens"]))).items():
            total[_bucket(g)] += n
    some = np.flatnonzero(total)
    yield pd.DataFrame({"bucket": some, "n": total[some]})


def rarest_pairs(sets: DataFrame, take: Column) -> Column:
    """The ``take`` rarest letter pairs of each row's ``tokens``, in one order for all rows.

    Pairs are ranked by how often their hash bucket occurs in every eighth title, then
    by themselves. Any order that all titles share loses no match; the counts, a fixed
    number of buckets, only make it a good one.
    """
    counts = np.zeros(PAIR_BUCKETS, "int64")
    for r in sets.filter(F.pmod(F.xxhash64("id"), F.lit(8)) == 0).select("tokens").mapInPandas(_pair_counts, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # PAIR_BUCKETS rows at most
        counts[r["bucket"]] = r["n"]
    often = counts.tolist()

    @F.pandas_udf("array<string>")
    def rarest(tokens: pd.Series, most: pd.Series) -> pd.Series:
        rank: dict[str, tuple[int, str]] = {}
        out = []
        for t, n in zip(tokens, most):
            pairs = _letter_pairs(t)
            for g in pairs:
                if g not in rank:
                    rank[g] = (often[_bucket(g)], g)
            out.append(sorted(pairs, key=rank.__getitem__)[:n])
        return pd.Series(out)

    return rarest("tokens", take)


def edit_candidates(sets: DataFrame, threshold: float) -> DataFrame:
    """(day, id, other) whose written-out sets may be within ``d`` inserted and deleted
    characters of each other, ``d`` at most ``2 (1 - t) / t`` of either length.

    Wherever the tokens stand, a deleted character spoils at most two letter pairs inside
    the title's tokens, an inserted one at most one: most are spoiled if ``e``, at most
    ``2 (1 - t) / (2 - t)`` of its length, are deleted and none inserted. So of a title's
    letter pairs (numbered where they repeat) any ``2 e + m`` hold ``m`` that the other
    title has too. The rarest are taken on both
    sides, where the first ``m`` common pairs must then be among both; ``m`` grows with
    the length, so that long titles don't meet by a chance pair. Titles with fewer pairs
    than that (of one- and two-letter tokens) meet the titles of every length in reach
    instead.
    """
    slack = 2 * (100 - threshold) / threshold
    t = sets.select("day", "id", "tokens", _chars().alias("n")).withColumn("d", F.floor(slack * F.col("n") + 1e-9).cast("int"))
    t = t.withColumn("m", (1 + F.floor(F.col("n") / PAIR_CHARS)).cast("int"))
    take = (F.floor(4 * (100 - threshold) / (200 - threshold) * F.col("n") + 1e-9) + F.col("m")).cast("int")
    # the hash with the day is the join key: a collision adds a candidate, none is lost
    rare = t.select("day", "id", "n", "d", "m", F.explode(rarest_pairs(sets, take)).alias("gram")).withColumn("gram", F.xxhash64("day", "gram"))
    a, b = rare.alias("a"), rare.alias("b")
    near = F.abs(F.col("a.n") - F.col("b.n")) <= F.least("a.d", "b.d")
    met = a.join(b, F.col("a.gram") == F.col("b.gram")).filter((F.col("a.id") < F.col("b.id")) & near & _same("a.day", "b.day"))
    met = met.groupBy("a.day", "a.id", F.col("b.id").alias("other")).agg(F.count("*").alias("common"), F.min(F.least("a.m", "b.m")).alias("need"))
    met = met.filter("common >= need").select("day", "id", "other")
    count = F.aggregate("tokens", F.lit(0), lambda a, x: a + F.length(x) - 1)
    weak = t.filter(count < take).select("day", "id", F.explode(F.sequence(F.col("n") - F.col("d"), F.col("n") + F.col("d"))).alias("at"))
    reach = weak.join(t.select("day", F.col("id").alias("other"), F.col("n").alias("at")), ["day", "at"]).filter("id <> other").select("day", "id", "other")
    return met.unionByName(reach).distinct()


def candidate_pairs(sets: DataFrame, threshold: float = 92.0) -> DataFrame:
    """(day, id, other) of one day, every pair among them that can reach ``threshold``.

    The token-set ratio is the best of three: the shared tokens against either title,
    which needs all but ``2 (1 - t) / (2 - t)`` of that title's characters in shared tokens,
    and one title against the other, which bounds their edits.
    """
    t = threshold / 100
    return containment_candidates(sets, 2 * (1 - t) / (2 - t) + 1e-9).unionByName(edit_candidates(sets, threshold)).distinct()


def _lcs(a: str, b: str, need: float = 0) -> int:
    """Length of the longest common subsequence, bit-parallel over Python integers; less
    than ``need`` once the rest of ``b`` can't reach that any more."""
    if not a or not b:
        return 0
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for j in range(0, len(b), 32):
        for ch in b[j:j + 32]:
            u = v & masks.get(ch, 0)
            v = ((v + u) | (v - u)) & full
        if len(a) - v.bit_count() + max(len(b) - j - 32, 0) < need:
            break
    return len(a) - v.bit_count()


def token_set_ratio(a, b, at_least: float = 0.0) -> float:
    """Best normalised indel ratio of shared, left and right sorted token strings; any
    value below ``at_least`` if the ratio is below it."""
    left, right = set(a), set(b)
    both, da, db = left & right, left - right, right - left
    if not left or not right:
        return 0.0
    if both and (not da or not db):
        return 100.0
    sa, sb = " ".join(sorted(da)), " ".join(sorted(db))
    sect = len(" ".join(sorted(both)))
    gap = 1 if sect else 0
    la, lb = sect + gap + len(sa), sect + gap + len(sb)
    best = 0.0
    if sect:
        best = max(100.0 - 100.0 * (gap + len(sa)) / (sect + la), 100.0 - 100.0 * (gap + len(sb)) / (sect + lb))
    # only edits that could lift the ratio to the higher of both need to be counted
    most = (1 - max(best, at_least) / 100) * (la + lb) + 1e-6
    if abs(len(sa) - len(sb)) > most or sum(abs(sa.count(ch) - sb.count(ch)) for ch in {*sa, *sb}) > most:
        return best
    dist = len(sa) + len(sb) - 2 * _lcs(sa, sb, (len(sa) + len(sb) - most) / 2)
    return max(best, 100.0 - 100.0 * dist / (la + lb))


def _ratio(threshold: float):
    """Column function: the ratio of two token sets where it reaches ``threshold``, less elsewhere."""
    @F.pandas_udf(T.DoubleType())
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([token_set_ratio(x, y, threshold) for x, y in zip(a, b)])

    return ratio


def resolve_first_kept(edges: DataFrame) -> DataFrame:
    """Ids dropped by the rule "first kept wins" over edges ``src < dst``.

    Each round keeps every item without an undecided earlier partner and drops its
    partners; the loop ends when no edge joins two undecided items. Edges shrink
    every round and are checkpointed.
    """
    edges = cut_lineage(edges.select("src", "dst").distinct())
    dropped = None
    while not edges.isEmpty():
        roots = edges.select("src").distinct().join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_anti")
        gone = cut_lineage(edges.join(roots, "src", "left_semi").select(F.col("dst").alias("id")).distinct())
        dropped = gone if dropped is None else dropped.unionByName(gone)
        edges = cut_lineage(
            edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
        )
    return dropped if dropped is not None else edges.select(F.col("dst").alias("id"))


def fuzzy_dedupe(items: DataFrame, ident: str, day: str, title: str, threshold: float = 92.0) -> DataFrame:
    """Items whose title is not within ``threshold`` of an earlier kept title of the day.

    Items without any title token are kept, as they match nothing.
    """
    sets = cut_lineage(title_sets(items, ident, day, title))
    pairs = candidate_pairs(sets, threshold).select("day", F.least("id", "other").alias("src"), F.greatest("id", "other").alias("dst")).distinct()
    a = sets.select("day", F.col("id").alias("src"), F.col("tokens").alias("ta"))
    b = sets.select("day", F.col("id").alias("dst"), F.col("tokens").alias("tb"))
    scored = pairs.join(a, ["day", "src"]).join(b, ["day", "dst"]).withColumn("ratio", _ratio(threshold)("ta", "tb"))
    gone = resolve_first_kept(scored.filter(F.col("ratio") >= threshold).select("src", "dst"))
    winners = sets.select(F.col("id").alias(ident)).join(gone.withColumnRenamed("id", ident), ident, "left_anti")
    no_tokens = items.filter(~F.rlike(F.coalesce(F.col(title), F.lit("")), F.lit(r"\S"))).select(ident)
    return items.join(winners.unionByName(no_tokens), ident, "left_semi")


def subset_pairs(sets: DataFrame) -> DataFrame:
    """Pairs of a day where one title's token set contains the other's (ratio 100)."""
    pairs = containment_candidates(sets)
    small = sets.select("day", "id", F.col("tokens").alias("ta"))
    big = sets.select("day", F.col("id").alias("other"), F.col("tokens").alias("tb"))
    j = pairs.join(small, ["day", "id"]).join(big, ["day", "other"])
    return j.filter(F.size(F.array_except("ta", "tb")) == 0).select("day", F.least("id", "other").alias("src"), F.greatest("id", "other").alias("dst")).distinct()


# ---- serving --------------------------------------------------------------------------
def serving_guard(items: DataFrame, keywords: Sequence[str], noise: Sequence[str], min_score: int = 4, company: str | None = None) -> DataFrame:
    """Second relevance guard; a company filter keeps non-company scopes."""
    text = F.lower(F.concat_ws(" ", "title", "summary_2line"))
    d = items.filter(~any_hit(text, noise) & ((F.size("company_tags") > 0) | any_hit(text, keywords)) & (F.col("relevance_score") >= min_score))
    if company is not None:
        d = d.filter(F.array_contains("company_tags", company) | (F.col("market_scope") != "company"))
    return d


def digest_entries(items: DataFrame, cap: int = 12, caps: Mapping[str, int] | None = None) -> DataFrame:
    """(section, rank, item) rows of the digest: one section per company, sector, global.

    An item appears once per tagged company. The cap is the report's own length;
    ``row_number`` under a filter keeps only ``cap`` rows per partial task.
    """
    sections = F.when(F.size("company_tags") > 0, F.col("company_tags")).when(F.col("market_scope") == "global", F.array(F.lit("global"))).otherwise(F.array(F.lit("sector")))
    d = items.withColumn("section", F.explode(sections))
    w = Window.partitionBy("section").orderBy(F.desc("published_date"), F.desc("relevance_score"), "doc_id")
    limit = F.lit(cap)
    for name, n in (caps or {}).items():
        limit = F.when(F.col("section") == name, n).otherwise(limit)
    biggest = max([cap, *(caps or {}).values()])
    return d.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= biggest).filter(F.col("rank") <= limit)


def digest(entries: DataFrame) -> DataFrame:
    """One nested row per section, ready for a JSON sink."""
    item = F.struct("rank", "title", "url", "published_date", "relevance_score", "sentiment", "summary_2line", "citation")
    return entries.groupBy("section").agg(F.sort_array(F.collect_list(item)).alias("items"))


def daily_run(enriched: DataFrame, ident: str, cap: int = 12, caps: Mapping[str, int] | None = None, bucket: str = "source") -> tuple[DataFrame, DataFrame, DataFrame]:
    """One day's flow over collected and enriched items: gates, exact and fuzzy
    de-duplication in order of ``ident``, evidence gate, digest.

    Returns the digest's flat rows (short summaries in place of summary and content), item
    counts by step and bucket, and the missing fields of the items that the evidence gate
    dropped. Each step reads the last one's result once.
    """
    # judged once; what later steps ask of the texts is drawn here, the texts stay behind
    kept = F.col("drop_reason").isNull()
    judged = cut_lineage(enriched.withColumns({n: F.when(kept, c) for n, c in _served().items()}).drop("summary", "content", "scoring_text"))
    passed = judged.filter(kept).drop("drop_reason")
    keyed = cut_lineage(keep_first(passed, ["uid"], [ident]))
    once = cut_lineage(keep_first(keyed, ["published_date", "content_signature"], [ident]))
    apart = cut_lineage(fuzzy_dedupe(once, ident, "published_date", "title"))
    safe, missing = evidence_gate(apart)
    steps = {"collected": judged, "accepted": passed, "keyed": keyed, "exact": once, "fuzzy": apart, "evidence": safe}
    counts = None
    for name, df in steps.items():
        n = df.groupBy(F.lit(name).alias("step"), F.col(bucket).alias("bucket")).agg(F.count("*").alias("n"))
        counts = n if counts is None else counts.unionByName(n)
    return digest_entries(safe, cap, caps), counts, missing


# What an item was lost to between two steps of the daily run.
LOSSES = [("collected", "accepted", "gates"), ("accepted", "keyed", "same_key"), ("keyed", "exact", "same_signature"), ("exact", "fuzzy", "similar_title"), ("fuzzy", "evidence", "no_evidence")]


def health_report(enriched: DataFrame, counts: DataFrame, missing: DataFrame, bucket: str = "source") -> DataFrame:
    """(section, bucket, name, n) of a daily run: items of each bucket before and after,
    losses by gate reason, by kind of copy and to the evidence gate, fields found missing.

    Buckets of a section with no loss are left out; a null bucket is one of its own.
    """
    raw = counts.select(F.when(F.col("step") == "collected", "raw").when(F.col("step") == "evidence", "final").alias("section"), "bucket", F.lit("items").alias("name"), "n").filter("section is not null")
    by = {s: F.sum(F.when(F.col("step") == s, F.col("n")).otherwise(0)) for s in {s for a, b, _ in LOSSES for s in (a, b)}}
    lost = F.array(*[F.struct(F.lit("lost").alias("section"), F.lit(name).alias("name"), F.col(f"__{a}").alias("a"), F.col(f"__{b}").alias("b")) for a, b, name in LOSSES])
    wide = counts.groupBy("bucket").agg(*[c.alias(f"__{s}") for s, c in by.items()])
    losses = wide.select("bucket", F.inline(lost)).select("section", "bucket", "name", (F.col("a") - F.col("b")).alias("n")).filter("n > 0")
    gates = enriched.filter("drop_reason is not null").groupBy(F.lit("gate").alias("section"), F.col(bucket).alias("bucket"), F.col("drop_reason").alias("name")).agg(F.count("*").alias("n"))
    fields = missing.select(F.lit("missing").alias("section"), F.lit(None).cast("string").alias("bucket"), F.col("field").alias("name"), "n")
    return raw.unionByName(losses).unionByName(gates).unionByName(fields)


def event_graph(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items to typed node and edge rows (source, bucket, dimension, company, metric, topic).

    One array of links per item is exploded once; both outputs keep one row per key.
    """
    link = lambda kind, rel, name: F.struct(F.lit(kind).alias("kind"), F.lit(rel).alias("rel"), name.alias("name"))
    many = lambda kind, rel, col: F.transform(col, lambda x: F.struct(F.lit(kind).alias("kind"), F.lit(rel).alias("rel"), x.alias("name")))
    links = F.concat(
        F.array(link("Source", "FROM_SOURCE", F.col("source")), link("SourceBucket", "IN_SOURCE_BUCKET", F.col("source_bucket")),
                link("Dimension", "ALIGNS_WITH", F.col("dimension_primary")), link("Topic", "TAGGED_AS", F.col("event_type"))),
        many("Company", "AFFECTED_BY", F.col("companies")), many("Metric", "IMPACTS_METRIC", F.col("metrics")))
    edges = items.select("event_id", F.inline(F.filter(links, lambda x: x["name"].isNotNull()))).distinct()
    nodes = edges.select("kind", "name").distinct().unionByName(items.select(F.lit("Event").alias("kind"), F.col("event_id").cast("string").alias("name")).distinct())
    return nodes, edges
