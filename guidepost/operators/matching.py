"""Name matching against short parameter lists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def resolve_alias(name: Column, aliases: Mapping[str, str]) -> Column:
    """Exact alias, else the first alias contained either way, else the name itself."""
    key = F.replace(F.lower(F.trim(name)), F.lit("-"), F.lit("_"))
    exact = [F.when(key == a, F.lit(v)) for a, v in aliases.items()]
    partial = [F.when(F.contains(F.lit(a), key) | F.contains(key, F.lit(a)), F.lit(v)) for a, v in aliases.items()]
    return F.coalesce(*exact, *partial, name)


def _tokens(c: Column, extra: str = "") -> Column:
    t = F.translate(F.lower(c), "_-" + extra, "  ")
    return F.array_distinct(F.filter(F.split(t, " "), lambda w: w != ""))


def fuzzy_match(df: DataFrame, query: str, names: Sequence[str]) -> DataFrame:
    """Best of a short list of metric names: exact, then contained, then most shared words.

    The list is a literal, scored per row without a join. ``tier`` is 3, 2, 1 or null.
    """
    q = F.lower(F.trim(F.col(query)))
    words = _tokens(F.trim(F.col(query)))
    opts = []
    for i, n in enumerate(names):
        low = F.lit(n.lower())
        shared = F.size(F.array_intersect(words, _tokens(F.lit(n), "+%")))
        tier = F.when(q == low, 3).when(F.contains(low, q) | F.contains(q, low), 2).when(shared > 0, 1).otherwise(0)
        opts.append(F.struct(tier.alias("tier"), F.when(tier == 1, shared).otherwise(0).alias("shared"), F.lit(-i).alias("ord"), F.lit(n).alias("name")))
    best = F.array_max(F.array(*opts))
    out = df.withColumn("__best", best)
    hit = F.col("__best.tier") > 0
    return out.withColumns({"matched": F.when(hit, F.col("__best.name")), "tier": F.when(hit, F.col("__best.tier"))}).drop("__best")
