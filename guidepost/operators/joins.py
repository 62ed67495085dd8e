"""Joins the optimiser has no single operator for, built from equi joins.

Each keeps an equality key, so plans stay hash or sort-merge joins, and none
pairs a row with more than its bounded neighbourhood.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def series(facts: DataFrame, keys: Sequence[str], order: str, value: str, label: str) -> DataFrame:
    """One row per series holding its points in order.

    Points are first reduced to one per (series, order), so an array is as long as
    the calendar, however many fact rows arrive.
    """
    one = facts.groupBy(*keys, order).agg(F.max_by(F.struct(F.col(value).alias("v"), F.col(label).alias("p")), F.col(label)).alias("x"))
    point = F.struct(F.col(order).alias("o"), F.col("x.v").alias("v"), F.col("x.p").alias("p"))
    return one.groupBy(*keys).agg(F.sort_array(F.collect_list(point)).alias("points"))


def forward_window(left: DataFrame, points: DataFrame, keys: Sequence[str], left_on: str, n: Column, best: Column) -> DataFrame:
    """Next ``n`` reported points after ``left_on`` and the best of them.

    ``best`` is ``'max'`` or ``'min'`` per row. Ties keep the earliest period.
    """
    j = left.join(points, list(keys), "left")
    later = F.filter("points", lambda x: (x["o"] > F.col(left_on)) & x["v"].isNotNull())
    j = j.withColumn("__w", F.slice(later, F.lit(1), n))
    up = F.array_max(F.transform("__w", lambda x: F.struct(x["v"].alias("v"), (-x["o"]).alias("o"), x["p"].alias("p"))))
    down = F.array_min(F.transform("__w", lambda x: F.struct(x["v"].alias("v"), x["o"].alias("o"), x["p"].alias("p"))))
    pick = lambda f: F.when(best == "min", down[f]).otherwise(up[f])
    return j.select(
        *left.columns, pick("v").alias("window_value"), pick("p").alias("window_period"),
        F.transform("__w", lambda x: x["p"]).alias("window_periods"),
    )


def asof_backward(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_on: str,
    right_on: str,
    values: Sequence[str],
    block: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Latest right row with ``right_on <= left_on`` per key; nulls when none.

    Both sides are laid on one time line and the last right row is carried
    forward. ``block`` maps the order value to a coarser monotone value: each key is
    then split into blocks, and only one summary row per block crosses blocks, so a
    very large key is not one task.
    """
    keys, values = list(keys), list(values)
    payload = F.struct(F.col(right_on).alias("__k"), *values)
    lrows = left.select(*keys, F.col(left_on).alias("__t"), F.lit(1).alias("__side"), F.lit(None).alias("__p"), F.struct(*left.columns).alias("__row"))
    rrows = right.select(*keys, F.col(right_on).alias("__t"), F.lit(0).alias("__side"), payload.alias("__p"), F.lit(None).alias("__row"))
    line = lrows.unionByName(rrows)
    part = keys
    if block is not None:
        line = line.withColumn("__b", block(F.col("__t")))
        part = [*keys, "__b"]
        heads = right.select(*keys, block(F.col(right_on)).alias("__b"), payload.alias("__p"))
        heads = heads.groupBy(*part).agg(F.max("__p").alias("__p"))
        seen = lrows.select(*keys, block(F.col("__t")).alias("__b")).distinct().withColumn("__p", F.lit(None))
        marks = heads.unionByName(seen).groupBy(*part).agg(F.max("__p").alias("__p"))
        prior = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
        carry = marks.select(*part, F.last("__p", ignorenulls=True).over(prior).alias("__carry"))
        line = line.join(carry, part, "left")
    w = Window.partitionBy(*part).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    hit = F.last("__p", ignorenulls=True).over(w)
    if block is not None:
        hit = F.coalesce(hit, F.col("__carry"))
    out = line.withColumn("__hit", hit).filter(F.col("__side") == 1)
    return out.select("__row.*", F.col("__hit.__k").alias("asof_key"), *[F.col(f"__hit.{v}").alias(f"asof_{v}") for v in values])


def nearest_in_window(left: DataFrame, right: DataFrame, keys: Sequence[str], lo: str, hi: str, at: str, item: str) -> DataFrame:
    """Right row closest to the middle of the inclusive window ``[lo, hi]``.

    Left rows must be distinct: they are grouped back by all their columns.

    The window is a handful of integer steps, so each left row is expanded to
    those steps and joined by equality.
    """
    keys = list(keys)
    mid = (F.col(lo) + F.col(hi)) / 2
    wide = left.withColumn("__at", F.explode(F.sequence(F.col(lo), F.col(hi))))
    r = right.groupBy(*keys, F.col(at).alias("__at")).agg(F.min(item).alias("__item"))
    j = wide.join(r, [*keys, "__at"], "left")
    dist = F.when(F.col("__item").isNotNull(), F.struct(F.abs(F.col("__at") - mid), F.col("__at"), F.col("__item")))
    return j.groupBy(*left.columns).agg(F.min_by("__item", dist).alias(item))


def interval_lookup(points: DataFrame, spans: DataFrame, keys: Sequence[str], pos: str, start: str, end: str, value: str, width: int) -> DataFrame:
    """Span with ``start <= pos < end`` per key, matched through fixed-width cells.

    Points must be distinct rows. Each meets only the spans of its own cell.
    """
    keys = list(keys)
    cell = lambda c: F.floor(c / width).cast("long")
    s = spans.select(*keys, start, end, value, F.explode(F.sequence(cell(F.col(start)), cell(F.greatest(F.col(start), F.col(end) - 1)))).alias("__cell"))
    p = points.withColumn("__cell", cell(F.col(pos)))
    j = p.join(s, [*keys, "__cell"], "left")
    inside = (F.col(pos) >= F.col(start)) & (F.col(pos) < F.col(end))
    return j.groupBy(*points.columns).agg(F.max(F.when(inside, F.col(value))).alias(value))


def snapshot_diff(previous: DataFrame, current: DataFrame, key: str, digest: str) -> tuple[DataFrame, DataFrame]:
    """(changed rows, new state). A key seen for the first time sets a baseline only."""
    p = previous.select(key, F.col(digest).alias("__prev"))
    c = current.select(key, F.col(digest).alias("__cur"))
    j = p.join(c, key, "full")
    changed = j.filter(F.col("__prev").isNotNull() & F.col("__cur").isNotNull() & (F.col("__prev") != F.col("__cur")))
    state = j.select(key, F.coalesce("__cur", "__prev").alias(digest))
    return changed.select(key, F.col("__prev").alias("prev_hash"), F.col("__cur").alias("cur_hash")), state


def resolve_sources(cites: DataFrame, files: DataFrame) -> DataFrame:
    """Stored file of a cited document: ``<company>_..._<document>``, else exact name.

    File names are expanded to their suffixes after each underscore, which turns
    the prefix-and-suffix test into an equality.
    """
    parts = F.split(F.lower("file"), "_")
    suffix = F.explode(F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "_")))
    owned = files.filter(F.size(parts) > 1).select(F.upper(parts[0]).alias("company_id"), suffix.alias("doc"), "file").groupBy("company_id", "doc").agg(F.min("file").alias("owned"))
    exact = files.select(F.lower("file").alias("doc"), "file").groupBy("doc").agg(F.min("file").alias("exact"))
    c = cites.withColumn("doc", F.lower("document"))
    j = c.join(owned, ["company_id", "doc"], "left").join(exact, "doc", "left")
    return j.withColumn("file", F.coalesce("owned", "exact")).withColumn(
        "rule", F.when(F.col("owned").isNotNull(), "company_suffix").when(F.col("exact").isNotNull(), "exact").otherwise("none")
    ).drop("doc", "owned", "exact")
