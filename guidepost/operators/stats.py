"""Series statistics, set overlap, concentration and catalogue aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ordered import global_rank


def series_stats(facts: DataFrame, keys: Sequence[str], order: str = "ord", value: str = "value") -> DataFrame:
    """Latest, min, max, mean, first/last, total change and CAGR in one aggregate."""
    v = F.col(value)
    g = facts.filter(v.isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n"), F.min(v).alias("min_value"), F.max(v).alias("max_value"), F.avg(v).alias("avg_value"),
        F.min_by(v, F.col(order)).alias("start_value"), F.max_by(v, F.col(order)).alias("end_value"),
    )
    s, e, n = F.col("start_value"), F.col("end_value"), F.col("n")
    return g.withColumn("total_change_pct", F.when(s != 0, (e - s) / F.abs(s) * 100)).withColumn(
        "cagr_pct", F.when((n > 1) & (s > 0) & (e > 0), (F.pow(e / s, F.lit(1.0) / (n - 1)) - 1) * 100)
    )


def average_rank(values: DataFrame, group: str, value: str, lower_is_better: Sequence[str] = ()) -> DataFrame:
    """Rank with ties averaged per ``group``; the listed groups rank ascending."""
    flip = F.when(F.col(group).isin(list(lower_is_better)), -F.col(value)).otherwise(F.col(value)) if lower_is_better else F.col(value)
    r = global_rank(values.withColumn("__v", flip), "__v", [group], peers_col="__peers")
    return r.withColumn("avg_rank", F.col("rank") + (F.col("__peers") - 1) / 2).drop("__v", "__peers", "rank", "total")


def set_overlap(members: DataFrame, requested: DataFrame, entity: str, member: str, by: Sequence[str]) -> DataFrame:
    """Shared, one-sided and Jaccard counts for the requested pairs of entities.

    ``requested`` lists (left_id, right_id). The left set of each pair is looked up
    in the right one by equality, so work is the size of the left sets; pairs that
    nobody asked for are never formed.
    """
    by = list(by)
    d = members.select(*by, entity, member).distinct()
    sizes = d.groupBy(*by, entity).agg(F.count("*").alias("size"))
    left = requested.join(d.withColumnRenamed(entity, "left_id"), "left_id")
    right = d.withColumnRenamed(entity, "right_id").withColumn("hit", F.lit(1))
    shared = left.join(right, [*by, "right_id", member], "left").groupBy(*by, "left_id", "right_id").agg(F.sum("hit").alias("shared"), F.count("*").alias("ls"))
    j = shared.join(sizes.withColumnRenamed(entity, "right_id").withColumnRenamed("size", "rs"), [*by, "right_id"], "left")
    n = F.coalesce("shared", F.lit(0))
    rs = F.coalesce("rs", F.lit(0))
    return j.select(
        *by, "left_id", "right_id", n.alias("shared"), (F.col("ls") - n).alias("only_left"), (rs - n).alias("only_right"),
        (100 * n / (F.col("ls") + rs - n)).alias("jaccard_pct"),
    )


def _distinct_members(members: DataFrame, entity: str, member: str, by: Sequence[str]) -> DataFrame:
    """Distinct (keys, ``entity``, ``member``) rows, dealt before they are compared: a task
    that folded its rows first would hold nearly all of them, as an entity's rows come
    from everywhere."""
    d = members.select(*by, F.col(entity).alias("entity"), F.col(member).alias("member")).filter(F.col("entity").isNotNull() & F.col("member").isNotNull())
    return d.repartition(*by, "entity", "member").distinct()


def similar_sets(members: DataFrame, entity: str, member: str, by: Sequence[str], percent: int) -> tuple[DataFrame, DataFrame]:
    """All pairs of member sets whose Jaccard overlap is at least ``percent``.

    Returns (pairs of representatives with ``shared``, ``only_left``, ``only_right`` and
    ``jaccard_pct``; membership ``entity`` -> ``rep``): entities with one and the same set
    are one class with its least entity as representative, as they relate alike to all
    others. Two sets of sizes a >= b can only reach the threshold if b is at least
    ``percent`` of a, and if they share one of their ``size - need + 1`` rarest members, so
    sets meet on these alone; every pair that meets is then counted exactly. Frequent
    members join nothing unless a set has nothing rarer.
    """
    by = list(by)
    sets = cut_lineage(_distinct_members(members, entity, member, by).groupBy(*by, "entity").agg(F.array_sort(F.collect_list("member")).alias("m")))
    classes = cut_lineage(sets.groupBy(*by, "m").agg(F.min("entity").alias("rep")).withColumn("size", F.size("m")))
    tok = classes.select(*by, "rep", "size", F.explode("m").alias("member"))
    often = tok.groupBy(*by, "member").agg(F.count("*").alias("df")).filter("df > 1")
    # members that no other set has are rarer still and use up the first places
    ranked = tok.join(often, [*by, "member"]).withColumn("rk", F.row_number().over(Window.partitionBy(*by, "rep").orderBy("df", "member")))
    own = ranked.withColumn("met", F.count("*").over(Window.partitionBy(*by, "rep")))
    prefix = F.col("size") - F.ceil(F.col("size") * percent / 100) + 1
    probe = own.filter(F.col("rk") <= prefix - (F.col("size") - F.col("met"))).select(*by, "member", "rep", "size")
    one = probe.select(*by, "member", F.col("rep").alias("left_id"), F.col("size").alias("ls"))
    two = probe.select(*by, "member", F.col("rep").alias("right_id"), F.col("size").alias("rs"))
    fits = 100 * F.least("ls", "rs") >= percent * F.greatest("ls", "rs")
    met = one.join(two, [*by, "member"]).filter((F.col("left_id") < F.col("right_id")) & fits).select(*by, "left_id", "right_id").distinct()
    j = met.join(classes.select(*by, F.col("rep").alias("left_id"), F.col("m").alias("lm")), [*by, "left_id"]).join(classes.select(*by, F.col("rep").alias("right_id"), F.col("m").alias("rm")), [*by, "right_id"])
    j = j.select(*by, "left_id", "right_id", F.size("lm").alias("ls"), F.size("rm").alias("rs"), F.size(F.array_intersect("lm", "rm")).alias("shared"))
    union = F.col("ls") + F.col("rs") - F.col("shared")
    pairs = j.filter(100 * F.col("shared") >= percent * union)
    pairs = pairs.select(*by, "left_id", "right_id", "shared", (F.col("ls") - F.col("shared")).alias("only_left"), (F.col("rs") - F.col("shared")).alias("only_right"), (100.0 * F.col("shared") / union).alias("jaccard_pct"))
    return pairs, sets.join(classes.select(*by, "m", "rep"), [*by, "m"]).select(*by, F.col("entity").alias(entity), "rep")


def concentration(rev: DataFrame, supply: DataFrame, threshold: float) -> DataFrame:
    """Revenue share of each market per company, with the new supply of that market."""
    total = rev.groupBy("company_id").agg(F.sum("revenue").alias("total"))
    j = rev.join(total, "company_id").withColumn("share_pct", F.col("revenue") / F.col("total") * 100)
    j = j.join(supply, "market", "left").withColumn("new_supply", F.coalesce("new_supply", F.lit(0)))
    return j.withColumn("exposed", (F.col("share_pct") >= threshold) & (F.col("new_supply") > 0)).drop("total")


def catalogue(facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct metrics and periods of every source, with the metric names."""
    cells = facts.select(*keys, "metric", "period").distinct()
    return cells.groupBy(*keys).agg(
        F.count_distinct("metric").alias("n_metrics"), F.count_distinct("period").alias("n_periods"), F.count("*").alias("n_cells"),
        F.array_join(F.array_sort(F.collect_set("metric")), ",").alias("metric_names"),
    )
