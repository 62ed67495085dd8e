"""Ordered computations that stay distributed when one key is very large.

A plain window over ``company`` puts every row of that company into one task.
``blocked_running`` splits each key into ordered blocks, sums the blocks, runs a
window over the (few) block totals and another inside each block, so the largest
unit of work is one block.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def blocked_running(
    df: DataFrame,
    keys: Sequence[str],
    block: Sequence[str],
    order: Sequence[str],
    running: Mapping[str, Column],
    totals: bool = True,
) -> DataFrame:
    """Add exclusive running sums ``<name>`` and, with ``totals``, ``<name>_total``.

    ``block`` columns must be a prefix of the ordering: every row of an earlier
    block sorts before every row of a later one. ``order`` orders rows inside a
    block and must be unique there.
    """
    keys, block, order = list(keys), list(block), list(order)
    base = df.select("*", *[c.cast("long").alias(f"__v_{n}") for n, c in running.items()])
    sums = base.groupBy(*keys, *block).agg(*[F.sum(f"__v_{n}").alias(f"__b_{n}") for n in running])
    before = Window.partitionBy(*keys).orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    offsets = sums.select(
        *keys, *block,
        *[F.coalesce(F.sum(f"__b_{n}").over(before), F.lit(0)).alias(f"__o_{n}") for n in running],
        *([F.sum(f"__b_{n}").over(whole).alias(f"{n}_total") for n in running] if totals else []),
    )
    inside = Window.partitionBy(*keys, *block).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = base.join(offsets, [*keys, *block])
    out = joined
    for n in running:
        out = out.withColumn(n, F.col(f"__o_{n}") + F.coalesce(F.sum(f"__v_{n}").over(inside), F.lit(0)))
    return out.drop(*[f"__v_{n}" for n in running], *[f"__o_{n}" for n in running])


def longest_run(df: DataFrame, keys, block, order, hit: Column, out: str = "max_run") -> DataFrame:
    """Longest streak of consecutive ``hit`` rows per key (gaps and islands)."""
    pos = blocked_running(df.withColumn("__hit", hit), keys, block, order, {"__island": ~F.col("__hit")}, totals=False)
    runs = pos.groupBy(*keys, "__island").agg(F.count_if("__hit").alias("__n"))
    return runs.groupBy(*keys).agg(F.max("__n").alias(out))


def global_rank(
    df: DataFrame,
    value: str,
    partition: Sequence[str] = (),
    descending: bool = True,
    rank_col: str = "rank",
    total_col: str = "total",
    peers_col: str | None = None,
    buckets: int = 64,
    per_bucket: int = 50_000,
) -> DataFrame:
    """Competition rank of ``value`` without sorting a whole partition in one task.

    Equal values are folded to one counted row first, so a hot value costs
    nothing. Distinct values are cut into quantile buckets, and these again until a
    bucket holds about ``per_bucket`` values, so the largest task stays the same as
    rows grow. A window over the bucket totals plus one inside each bucket gives the
    rank. Null values keep a null rank and are not counted.
    """
    part = list(partition)
    freq = cut_lineage(df.filter(F.col(value).isNotNull()).groupBy(*part, value).agg(F.count("*").alias("__c")))
    levels = rank_levels(freq.groupBy(*part).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0], buckets, per_bucket)
    cuts = [i / buckets for i in range(1, buckets)]
    path: list[str] = []
    for level in range(levels):
        bounds = F.percentile_approx(value, cuts, 1000).alias("__cuts")
        by = part + path
        # without keys one row by construction: a global aggregate
        freq = freq.join(freq.groupBy(*by).agg(bounds), by) if by else freq.join(F.broadcast(freq.agg(bounds)))
        below = F.size(F.filter(F.array_distinct("__cuts"), lambda b: b < F.col(value)))
        path = [*path, f"__bk{level}"]
        freq = freq.withColumn(path[-1], -below if descending else below).drop("__cuts")
    order = F.col(value).desc() if descending else F.col(value).asc()
    inside = Window.partitionBy(*part, *path) if part or path else Window.partitionBy(F.lit(0))
    sums = freq.groupBy(*part, *path).agg(F.sum("__c").alias("__n"))
    whole = Window.partitionBy(*part) if part else Window.partitionBy(F.lit(0))
    before = F.sum("__n").over(whole.orderBy(*path).rowsBetween(Window.unboundedPreceding, -1)) if path else F.lit(0)
    offsets = sums.select(*part, *path, F.coalesce(before, F.lit(0)).alias("__off"), F.sum("__n").over(whole).alias(total_col))
    placed = freq.join(offsets, [*part, *path]) if part or path else freq.join(F.broadcast(offsets))
    ranked = placed.select(
        *part, value,
        (F.lit(1) + F.col("__off") + F.coalesce(F.sum("__c").over(inside.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias(rank_col),
        total_col,
        *([F.col("__c").alias(peers_col)] if peers_col else []),
    )
    return df.join(ranked, [*part, value], "left")


def rank_levels(most: int | None, buckets: int, per_bucket: int) -> int:
    """How often to cut ``most`` distinct values into ``buckets``."""
    levels, left = 0, most or 0
    while left > per_bucket:
        levels, left = levels + 1, -(-left // buckets)
    return levels


def latest_rows(df: DataFrame, keys: Sequence[str], order: str, n: int = 2) -> DataFrame:
    """Newest ``n`` rows per key with their position ``rn`` (1 = newest)."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return df.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)


def latest_prev_wide(facts: DataFrame, metrics: Sequence[str], order: str = "ord") -> DataFrame:
    """One row per company: ``<metric>`` and ``<metric>_prev`` from annual facts."""
    top = latest_rows(facts.filter(F.col("metric").isin(list(metrics))), ["company_id", "metric"], order)
    cell = lambda m, r: F.max(F.when((F.col("metric") == m) & (F.col("rn") == r), F.col("value")))
    return top.groupBy("company_id").agg(
        *[cell(m, 1).alias(m) for m in metrics], *[cell(m, 2).alias(f"{m}_prev") for m in metrics]
    )


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key by ``order``; ``min_by`` combines map-side before the shuffle."""
    cols = [c for c in df.columns if c not in keys]
    packed = F.min_by(F.struct(*cols), F.struct(*order)).alias("__r")
    return df.groupBy(*keys).agg(packed).select(*keys, "__r.*").select(*df.columns)


def growth(df: DataFrame, keys, order, value="value", periods=1, base="signed", out="growth_pct") -> DataFrame:
    """Percent change against ``periods`` rows back; ``base`` is ``signed`` or ``abs``."""
    prev = F.lag(value, periods).over(Window.partitionBy(*keys).orderBy(order))
    den = F.abs(prev) if base == "abs" else prev
    return df.withColumn(out, F.when(den != 0, (F.col(value) - prev) / den * 100))


def trailing_sum(df: DataFrame, keys, order, value="value", n=4, out="ttm") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(n - 1), 0)
    return df.withColumn(out, F.when(F.count(value).over(w) == n, F.sum(value).over(w)))


def last_n(df: DataFrame, keys, order, n) -> DataFrame:
    return latest_rows(df, keys, order, n)


def half_trend(df: DataFrame, keys, block, order, hit: Column, out_prefix="") -> DataFrame:
    """Hit counts in the first ``n//2`` rows and in the rest, per key."""
    pos = blocked_running(df.withColumn("__hit", hit), keys, block, order, {"__pos": F.lit(1)})
    first = F.col("__pos") < F.floor(F.col("__pos_total") / 2)
    p = out_prefix
    return pos.groupBy(*keys).agg(
        F.count("*").alias(f"{p}n"),
        F.count_if(first).alias(f"{p}first_n"),
        F.count_if(first & F.col("__hit")).alias(f"{p}first_hits"),
        F.count_if(~first & F.col("__hit")).alias(f"{p}second_hits"),
    )


def min_max_scale(df: DataFrame, keys: Sequence[str], value="value", out="scaled") -> DataFrame:
    """Column-wise min-max normalisation; ranges come from a small aggregate joined back."""
    rng = df.groupBy(*keys).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    span = F.col("__hi") - F.col("__lo")
    return df.join(rng, list(keys)).withColumn(out, F.when(span != 0, (F.col(value) - F.col("__lo")) / span).otherwise(F.lit(0.0))).drop("__lo", "__hi")
