"""Connected components of links between documents or vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guidepost.session import cut_lineage


def _hang_larger(edges: DataFrame) -> DataFrame:
    """Each node hands its larger neighbours to the least node around it."""
    both = edges.select("lo", "hi").unionByName(edges.select(F.col("hi").alias("lo"), F.col("lo").alias("hi"))).toDF("node", "other")
    least = both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("least"))
    handed = both.where("other > node").join(least, "node")
    return handed.select(F.col("least").alias("lo"), F.col("other").alias("hi"), (F.col("least") != F.col("node")).alias("moved"))


def _hang_smaller(edges: DataFrame) -> DataFrame:
    """Each node hands itself and its smaller neighbours to the least of them."""
    least = edges.groupBy("hi").agg(F.min("lo").alias("least"), F.max("moved").alias("moved"))
    handed = edges.join(least.drop("moved"), "hi").where("lo <> least")
    return handed.select(F.col("least").alias("lo"), F.col("lo").alias("hi"), F.lit(True).alias("moved")).unionByName(
        least.select(F.col("least").alias("lo"), "hi", "moved"))


def _once(edges: DataFrame) -> DataFrame:
    return edges.where("lo <> hi").groupBy("lo", "hi").agg(F.max("moved").alias("moved"))


def components(links: DataFrame) -> DataFrame:
    """(node, component): the least node reachable from each node of ``src`` and ``dst``.

    Two steps take turns until one round of both moves nothing: every node hands its larger
    neighbours, then its smaller ones, to the least node around it, so that chains fold and
    each component ends as a star. A step is a minimum per node, combined before the
    shuffle, and one join; rounds grow with the logarithm of the longest chain. A hot node
    is one row of minima, its links stay spread by adaptive joins. Each round is written
    with ``checkpoint()``. Repeated links, both directions and links of a node with itself
    are allowed; links with a null end are left out; no links give no rows.
    """
    known = links.where("src is not null and dst is not null").select("src", "dst")
    ends = F.explode(F.array("src", "dst")).alias("node")
    everyone = cut_lineage(known.select(ends).distinct())
    pairs = known.select(F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi"), F.lit(True).alias("moved"))
    edges = cut_lineage(_once(pairs))
    while edges.agg(F.max("moved")).first()[0]:
        edges = cut_lineage(_once(_hang_smaller(_once(_hang_larger(edges)))))
    label = edges.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("component"))
    return everyone.join(label, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
