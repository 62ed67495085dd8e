"""Entity co-occurrence graph: build, look-ups and iterative algorithms.

Nodes are ``type::name`` keys. Which companies mention a node is kept as a
membership table, not as an array on the node, so no row grows with the data.
"""

from __future__ import annotations

import itertools
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions.periods import let
from ..session import cut_lineage
from .text import METRIC_PATTERNS, tag_array, time_refs


#: Kinds of entities that are no nodes of a graph.
NO_NODES = ("METRIC",)


def entities(chunks: DataFrame, dictionaries: Mapping[str, Mapping[str, Sequence[str]]], drop: Sequence[str] = ()) -> DataFrame:
    """Adds ``entities`` (array of type::name keys, metrics may repeat) to each chunk, without
    those of the kinds in ``drop``, which are not searched for."""
    low = F.lower("text")
    dictionaries = {kind: names for kind, names in dictionaries.items() if kind not in drop}
    key = lambda kind, name: F.concat(F.lit(f"{kind}::"), name)
    tags = F.transform(tag_array(low, dictionaries), lambda t: F.concat_ws("::", t["type"], t["name"]))
    company = F.when(F.col("company").isNotNull(), F.array(key("COMPANY", F.col("company")))).otherwise(F.array().cast("array<string>"))
    times = F.transform(time_refs(F.col("text")), lambda t: key("TIME_PERIOD", t))
    sp = F.col("speaker")
    odd = F.lit(False)
    for w in ("http", "page", "bse", "nse", "limited"):
        odd = odd | F.contains(F.lower(sp), F.lit(w))
    named = sp.isNotNull() & ~sp.isin("", "Unknown") & (F.length(sp) < 80) & ~odd
    person = F.when(named, F.array(key("PERSON", sp))).otherwise(F.array().cast("array<string>"))
    metric = lambda kind, pattern: F.transform(
        F.regexp_extract_all(F.col("text"), F.lit(pattern), F.lit(1)), lambda v: key("METRIC", F.concat(F.replace(v, F.lit(","), F.lit("")), F.lit(f" ({kind})"))))
    metrics = F.concat(*[metric(k, p) for k, p in METRIC_PATTERNS])
    parts = [("COMPANY", company), (None, tags), ("TIME_PERIOD", times), ("PERSON", person), ("METRIC", metrics)]
    return chunks.withColumn("entities", F.concat(F.array().cast("array<string>"), *[p for kind, p in parts if kind not in drop]))


def recency(period: Column, table=L.RECENCY, default: float = 0.4) -> Column:
    low = F.lower(F.coalesce(period, F.lit("")))
    out = F.lit(default)
    for words, score in reversed(list(table)):
        test = F.lit(False)
        for w in words:
            test = test | F.contains(low, F.lit(w))
        out = F.when(test, score).otherwise(out)
    return out


def node_rollup(tagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes with counts, node-company membership) from chunks with entities.

    Mentions are first counted per (node, company, doc type, period); all other
    numbers roll up from that, so a very common node is spread over many tasks.
    """
    fine = tagged.select(F.explode("entities").alias("node"), "company", "doc_type", "period").groupBy("node", "company", "doc_type", "period").agg(F.count("*").alias("n"))
    nodes = fine.groupBy("node").agg(
        F.sum("n").alias("count"), F.count_distinct("company").alias("num_companies"),
        F.count_distinct("doc_type").alias("num_doc_types"), F.count_distinct("period").alias("num_periods"))
    members = fine.filter("company is not null").groupBy("node", "company").agg(F.sum("n").alias("mentions"))
    return nodes.withColumns({"type": F.substring_index("node", "::", 1), "label": F.substring_index("node", "::", -1)}), members


def keep_nodes(nodes: DataFrame, minimum: Mapping[str, int] = L.NODE_MIN_COUNTS, default: int = 3, drop: Sequence[str] = NO_NODES) -> DataFrame:
    need = F.lit(default)
    for kind, n in minimum.items():
        need = F.when(F.col("type") == kind, n).otherwise(need)
    return nodes.filter(~F.col("type").isin(list(drop)) & (F.col("count") >= need))


def cooccurrences(tagged: DataFrame, ident: str) -> DataFrame:
    """Unordered entity pairs of each chunk (metric-metric left out), built inside the row."""
    keys = F.array_sort(F.array_distinct("entities"))
    is_metric = lambda k: F.startswith(k, F.lit("METRIC::"))
    pairs = let(keys, lambda ks: F.flatten(F.transform(ks, lambda a, i: F.transform(
        F.filter(F.slice(ks, i + 2, F.size(ks)), lambda b: ~(is_metric(a) & is_metric(b))), lambda b: F.struct(a.alias("src"), b.alias("dst"))))))
    keep = [c for c in tagged.columns if c != "entities"]
    return tagged.select(*keep, F.inline(pairs)) if ident in keep else tagged.select(F.inline(pairs))


def edge_rollup(pairs: DataFrame, ident: str, score: Column) -> DataFrame:
    """Count, recency sum, companies and weight per edge, through per-company sums."""
    fine = pairs.groupBy("src", "dst", "company").agg(F.count("*").alias("n"), F.sum(score).alias("r"))
    e = fine.groupBy("src", "dst").agg(F.sum("n").alias("count"), F.sum("r").alias("recency_sum"), F.count("company").alias("num_companies"))
    return e.withColumn("weight", F.log(1 + F.col("count")) * F.col("recency_sum") / F.greatest(F.col("count"), F.lit(1)))


def edge_contexts(pairs: DataFrame, ident: str, text: str, n: int = 2, width: int = 200) -> DataFrame:
    """First ``n`` sample contexts per edge; the row limit is applied before the shuffle."""
    w = Window.partitionBy("src", "dst").orderBy(ident)
    top = pairs.select("src", "dst", ident, F.substring(text, 1, width).alias("context")).withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)
    return top.groupBy("src", "dst").agg(F.transform(F.sort_array(F.collect_list(F.struct("rn", "context"))), lambda x: x["context"]).alias("contexts"))


def semi_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends are both in ``nodes``."""
    k = nodes.select("node")
    return edges.join(k.withColumnRenamed("node", "src"), "src", "left_semi").join(k.withColumnRenamed("node", "dst"), "dst", "left_semi")


def kept_edges(tagged: DataFrame, ident: str, nodes: DataFrame, min_weight: float = 0.3, recency_table=L.RECENCY) -> DataFrame:
    """Edges of at least ``min_weight`` between ``nodes`` from chunks with entities."""
    pairs = cooccurrences(tagged.select(ident, "company", "period", "entities"), ident)
    return semi_edges(edge_rollup(pairs, ident, recency(F.col("period"), recency_table)).filter(F.col("weight") >= min_weight), nodes)


def build_graph(chunks: DataFrame, ident: str, dictionaries, min_weight: float = 0.3, recency_table=L.RECENCY) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, members) of the filtered graph."""
    # the text is read and searched once; nodes, members and edges start from the small result
    tagged = cut_lineage(entities(chunks, dictionaries, NO_NODES).select(ident, "company", "doc_type", "period", "entities"))
    nodes, members = node_rollup(tagged)
    nodes = keep_nodes(nodes)
    return nodes, kept_edges(tagged, ident, nodes, min_weight, recency_table), members.join(nodes.select("node"), "node", "left_semi")


def write_graph(chunks: DataFrame, ident: str, dictionaries, path: str, min_weight: float = 0.3, recency_table=L.RECENCY, width: int = 200) -> None:
    """The graph of :func:`build_graph` as tables ``nodes``, ``edges``, ``members`` and
    ``contexts`` (of all pairs of entities that may be nodes) in folders of ``path``.

    Chunks are made and searched once, and kept with the beginning of their text; later
    tables start from those before them. Metrics, nearly one a chunk, are never paired.
    """
    spark = chunks.sparkSession
    kept = lambda name: spark.read.parquet(f"{path}/{name}")
    found = entities(chunks, dictionaries, NO_NODES).select(ident, "company", "doc_type", "period", F.substring("text", 1, width).alias("text"), "entities")
    found.write.parquet(f"{path}/chunks")
    tagged = kept("chunks")
    nodes, members = node_rollup(tagged)
    keep_nodes(nodes).write.parquet(f"{path}/nodes")
    members.join(kept("nodes").select("node"), "node", "left_semi").write.parquet(f"{path}/members")
    kept_edges(tagged, ident, kept("nodes"), min_weight, recency_table).write.parquet(f"{path}/edges")
    edge_contexts(cooccurrences(tagged.select(ident, "text", "entities"), ident), ident, "text", width=width).write.parquet(f"{path}/contexts")


def both_ways(edges: DataFrame, *cols: str) -> DataFrame:
    return edges.select("src", "dst", *cols).unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *cols))


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))


def profile(nodes: DataFrame, members: DataFrame, company: str | None = None) -> DataFrame:
    """Entities of a company (or of each) by type, most mentioned first."""
    m = members if company is None else members.filter(F.col("company") == company)
    j = m.join(nodes.select("node", "type", "label", "count"), "node").filter("type <> 'COMPANY'")
    w = Window.partitionBy("company", "type").orderBy(F.desc("count"), "node")
    return j.select("company", "type", "label", F.col("count").alias("mentions"), F.row_number().over(w).alias("rank"))


def tier_search(nodes: DataFrame, text: str, kind: str | None = None, limit: int = 50) -> DataFrame:
    """Exact 3, prefix 2, contains 1, then mentions; ``limit`` is the result page."""
    low, q = F.lower("label"), text.strip().lower()
    n = nodes if kind is None else nodes.filter(F.col("type") == kind)
    tier = F.when(low == q, 3).when(F.startswith(low, F.lit(q)), 2).otherwise(1)
    hit = n.filter(F.contains(low, F.lit(q))).withColumn("relevance", tier)
    return hit.orderBy(F.desc("relevance"), F.desc("count"), "node").limit(limit)


def topic_leaders(nodes: DataFrame, edges: DataFrame, topic: str) -> DataFrame:
    """Companies joined to the best-matching topic node, heaviest edge first."""
    best = tier_search(nodes, topic, "TOPIC", 1).select("node")
    near = both_ways(edges, "weight", "count").join(F.broadcast(best.withColumnRenamed("node", "src")), "src")
    return near.filter(F.startswith("dst", F.lit("COMPANY::"))).select(F.col("src").alias("topic"), F.substring_index("dst", "::", -1).alias("company"), "weight", "count")


def neighbourhood(nodes: DataFrame, edges: DataFrame, center: str, limit: int = 50) -> tuple[DataFrame, DataFrame]:
    """One-hop neighbours by weight and all edges among them and the centre."""
    near = both_ways(edges, "weight").filter(F.col("src") == center).orderBy(F.round("weight", 9).desc(), "dst").limit(limit).select(F.col("dst").alias("node"))
    ids = near.unionByName(nodes.filter(F.col("node") == center).select("node"))
    return nodes.join(ids, "node", "left_semi"), semi_edges(edges, ids)


def company_subgraph(nodes: DataFrame, edges: DataFrame, members: DataFrame, company: str, limit: int = 100) -> tuple[DataFrame, DataFrame]:
    """Most mentioned nodes of a company and at most three edges per node, by weight."""
    own = members.filter(F.col("company") == company).select("node")
    top = nodes.join(own, "node", "left_semi").orderBy(F.desc("count"), "node").limit(limit)
    return top, semi_edges(edges, top).orderBy(F.round("weight", 9).desc(), "src", "dst").limit(limit * 3)


def _links(edges: DataFrame) -> DataFrame:
    return cut_lineage(both_ways(edges).distinct())


def _start(node: str, links: DataFrame) -> DataFrame:
    return cut_lineage(links.filter(F.col("src") == node).select(F.col("src").alias("node"), F.lit(None).cast("string").alias("parent")).limit(1))


def _next_level(links: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """Nodes one hop beyond the last level, each with its least neighbour there. Neighbours
    of a level lie in it, before it or beyond it, so only the last two are taken out."""
    step = levels[-1].select(F.col("node").alias("src")).join(links, "src").groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("parent"))
    for near in levels[-2:]:
        step = step.join(near.select("node"), "node", "left_anti")
    return cut_lineage(step)


def hop_distances(edges: DataFrame, source: str, max_hops: int | None = None) -> DataFrame:
    """(node, hops, parent) for every node within ``max_hops`` of ``source``, or at any
    distance; following ``parent`` gives a shortest path. A level is one join."""
    links = _links(edges)
    levels = [_start(source, links)]
    for _ in itertools.count(1) if max_hops is None else range(max_hops):
        level = _next_level(links, levels)
        if level.isEmpty():
            break
        levels.append(level)
    return reduce(DataFrame.unionByName, [level.withColumn("hops", F.lit(h)) for h, level in enumerate(levels)]).select("node", "hops", "parent")


def shortest_path(edges: DataFrame, source: str, target: str, max_hops: int | None = None) -> DataFrame:
    """One row (``hops``, ``path``) for a shortest path between two nodes, none if there is
    no path (of at most ``max_hops``).

    The search goes on from both ends in turn and always from the smaller level, so it sees
    about the square root of what one end alone would reach. Levels keep parents; the path
    is put together once the ends have met.
    """
    links = _links(edges)
    none = links.limit(0).select(F.lit(0).alias("hops"), F.array("src").alias("path"))
    sides = [[_start(source, links)], [_start(target, links)]]
    if any(s[0].isEmpty() for s in sides):
        return none
    if source == target:
        return sides[0][0].select(F.lit(0).alias("hops"), F.array("node").alias("path"))
    sizes = [1, 1]
    for hop in itertools.count(1):
        if max_hops is not None and hop > max_hops:
            return none
        own = 0 if sizes[0] <= sizes[1] else 1
        level = _next_level(links, sides[own])
        sides[own].append(level)
        other = sides[1 - own][-1].select("node", F.lit(1).alias("met"))
        seen = level.join(other, "node", "left").agg(F.count("*").alias("n"), F.min(F.when(F.col("met") == 1, F.col("node"))).alias("met")).first()
        if not seen["n"]:
            return none
        if seen["met"] is not None:
            break
        sizes[own] = seen["n"]
    path = sides[0][-1].filter(F.col("node") == seen["met"]).select(F.array("node").alias("path"))
    for levels, first in ((sides[0], True), (sides[1], False)):
        for level in reversed(levels[1:]):
            end = F.element_at("path", 1 if first else -1)
            up = level.select(F.col("node").alias("__n"), "parent")
            path = path.withColumn("__n", end).join(up, "__n")
            path = path.select((F.concat(F.array("parent"), "path") if first else F.concat("path", F.array("parent"))).alias("path"))
    return path.select((F.size("path") - 1).alias("hops"), "path")


def connections(nodes: DataFrame, edges: DataFrame, term1: str, term2: str, contexts: DataFrame | None = None) -> DataFrame:
    """How two terms are connected, as one row.

    Each term means the node that :func:`tier_search` puts first; ``node1`` or ``node2`` is
    null where there is none. ``directly_connected`` comes with the edge's ``weight``,
    ``count`` and (of ``contexts``, by edge) sample ``contexts``; ``path`` holds the labels
    of a shortest path, ``path_length`` its hops, -1 without one.
    """
    spark = nodes.sparkSession
    ends = [next(iter(tier_search(nodes, t, limit=1).select("node", "label").collect()), None) for t in (term1, term2)]
    one = spark.range(1).select(
        *[F.lit(t).alias(f"term{i}") for i, t in enumerate((term1, term2), 1)], *[F.lit(e and e["node"]).cast("string").alias(f"node{i}") for i, e in enumerate(ends, 1)])
    empty = {"directly_connected": "boolean", "path_length": "int", "path": "array<string>", "weight": "double", "count": "long", "contexts": "array<string>"}
    if None in ends:
        given = {"directly_connected": False, "path_length": -1}
        return one.select("*", *[F.lit(given.get(c)).cast(t).alias(c) for c, t in empty.items()])
    a, b = (e["node"] for e in ends)
    found = shortest_path(edges, a, b)
    labels = found.select(F.posexplode("path").alias("at", "node")).join(nodes.select("node", "label"), "node")
    labels = labels.agg(F.array_sort(F.collect_list(F.struct("at", "label"))).alias("steps")).select(F.col("steps.label").alias("path"))
    own = lambda df: df.filter((F.col("src") == min(a, b)) & (F.col("dst") == max(a, b)))
    edge = own(edges).select("weight", F.col("count").cast("long").alias("count")).limit(1)
    sample = (own(contexts).select("contexts") if contexts is not None else edge.select(F.lit(None).cast("array<string>").alias("contexts"))).limit(1)
    for part in (labels, edge, sample):
        one = one.join(F.broadcast(part), how="left")  # one row each
    n = F.size("path")
    return one.select("term1", "term2", "node1", "node2", F.col("weight").isNotNull().alias("directly_connected"), (n - 1).alias("path_length"),
                      F.when(n > 0, F.col("path")).alias("path"), "weight", "count", "contexts")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) with the least node of each component as its label.

    Alternating large-star and small-star rounds; each is a minimum per node
    (combined map-side) and one join, and the number of rounds grows with the
    logarithm of the longest chain.
    """
    e = cut_lineage(edges.filter("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct())
    everyone = cut_lineage(edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct())

    def mark(df):
        return df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()

    def large(df):
        both = df.unionByName(df.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        return both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b").filter("a <> b").distinct()

    def small(df):
        # rows are (lower, node): each node's lower neighbours and the node itself go to its minimum
        least = df.groupBy("b").agg(F.min("a").alias("m"))
        low = df.join(least, "b").select(F.col("m").alias("x"), F.col("a").alias("y"))
        own = least.select(F.col("m").alias("x"), F.col("b").alias("y"))
        return low.unionByName(own).filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()

    before = mark(e)
    while True:
        e = cut_lineage(small(large(e)))
        after = mark(e)
        if after == before:
            break
        before = after
    label = e.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component"))
    return everyone.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))


def topics(nodes: DataFrame, kind: str = "TOPIC") -> DataFrame:
    """Labels of all nodes of a type with their mentions, in order of text."""
    return nodes.filter(F.col("type") == kind).select("label", "count").orderBy("label")


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per number: nodes and edges, density, nodes by type, largest degree,
    connected components (a node without edges is one)."""
    n = nodes.agg(F.count("*").cast("double").alias("v")).withColumn("stat", F.lit("nodes"))
    m = edges.agg(F.count("*").cast("double").alias("v")).withColumn("stat", F.lit("edges"))
    kinds = nodes.groupBy(F.concat(F.lit("type:"), "type").alias("stat")).agg(F.count("*").cast("double").alias("v"))
    deg = degrees(edges).agg(F.max("degree").cast("double").alias("v")).withColumn("stat", F.lit("max_degree"))
    label = nodes.select("node").join(components(edges.select("src", "dst")), "node", "left")
    parts = label.agg(F.count_distinct(F.coalesce("component", "node")).cast("double").alias("v")).withColumn("stat", F.lit("components"))
    pair = n.select(F.col("v").alias("n"), F.lit(1).alias("k")).join(m.select(F.col("v").alias("m"), F.lit(1).alias("k")), "k")
    density = pair.select(F.lit("density").alias("stat"), F.when(F.col("n") > 1, 2 * F.col("m") / (F.col("n") * (F.col("n") - 1))).otherwise(0.0).alias("v"))
    return reduce(DataFrame.unionByName, (density, n, m, kinds, deg, parts)).select("stat", F.col("v").alias("value"))


def collisions(shares: DataFrame, threshold: float) -> DataFrame:
    """Pairs of companies in one market whose combined share reaches ``threshold``.

    One of the two must hold at least half the threshold; a market has at most
    ``2 / threshold`` such companies, so only those are paired with the others.
    """
    big = shares.filter(F.col("share") >= threshold / 2).select("market", F.col("company_id").alias("big_id"), F.col("share").alias("big_share"))
    j = shares.join(big, "market").filter((F.col("company_id") != F.col("big_id")) & (F.col("share") + F.col("big_share") >= threshold))
    both_big = F.col("share") >= threshold / 2
    j = j.filter(~both_big | (F.col("company_id") > F.col("big_id")))
    return j.select("market", F.least("company_id", "big_id").alias("left_id"), F.greatest("company_id", "big_id").alias("right_id"), (F.col("share") + F.col("big_share")).alias("combined_share"))
