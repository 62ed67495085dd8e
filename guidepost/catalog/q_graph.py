"""Graph queries over the transcript statements: build, look-ups, paths, components, merge."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import text as T
from ..session import cut_lineage, scratch_path
from ..sources import sinks as K
from . import views as V
from .q_facts import market_revenue
from .q_promises import call_text, q
from .q_text import _tag_sql, contains_any
from .registry import query, view

DICTS = {
    "TOPIC": {"growth": ["growth", "grow "], "debt": ["debt", "borrowings"], "margin": ["margin"], "demand": ["demand", "markets"], "profit": ["profit"]},
    "STRATEGY": {"deleverage": ["debt reduction", "bring borrowings"], "expansion": ["add ", "new properties"], "costs": ["input costs"]},
    "LOCATION": {"portfolio": ["portfolio"], "hotels": ["our hotels"]},
    "BRAND": {"ours": ["our company"]},
}
RECENT = [(("fy02",), 1.0), (("fy01",), 0.9), (("fy00",), 0.8), (("fy99",), 0.7), (("fy98",), 0.6)]
_EMPTY = "CAST([] AS VARCHAR[])"
_TIMES = "list_distinct(list_transform(" + " || ".join(f"regexp_extract_all(text, '{q(p)}', 0)" for p in T.TIME_PATTERNS) + ", lambda x: 'TIME_PERIOD::' || trim(x)))"
_METS = " || ".join(f"list_transform(regexp_extract_all(text, '{q(p)}', 1), lambda v: 'METRIC::' || replace(v, ',', '') || ' ({k})')" for k, p in T.METRIC_PATTERNS)
view("tagged", f"""
SELECT chunk_id, company, period, doc_type, text, ['COMPANY::' || company] || list_transform({_tag_sql('lower(text)', DICTS, '::')}, lambda x: string_split(x, '::')[1] || '::' || string_split(x, '::')[2]) || {_TIMES}
  || CASE WHEN speaker IN ('', 'Unknown') OR {contains_any('lower(speaker)', ['http', 'page', 'bse', 'nse', 'limited'])} THEN {_EMPTY} ELSE ['PERSON::' || speaker] END || {_METS} AS entities,
  CASE {' '.join(f"WHEN contains(lower(period), '{w[0]}') THEN {s}::DOUBLE" for w, s in RECENT)} ELSE 0.4::DOUBLE END AS recency FROM call_text""")
view("mentions", "SELECT chunk_id, company, period, doc_type, unnest(entities) AS node FROM tagged")
view("g_nodes_all", "SELECT node, count(*) AS count, count(DISTINCT company) AS num_companies, count(DISTINCT doc_type) AS num_doc_types, count(DISTINCT period) AS num_periods, string_split(node, '::')[1] AS type, string_split(node, '::')[2] AS label FROM mentions GROUP BY node")
view("g_nodes", "SELECT * FROM g_nodes_all WHERE type <> 'METRIC' AND count >= CASE type WHEN 'COMPANY' THEN 1 WHEN 'TIME_PERIOD' THEN 3 WHEN 'PERSON' THEN 2 WHEN 'TOPIC' THEN 2 WHEN 'BRAND' THEN 2 WHEN 'LOCATION' THEN 2 WHEN 'STRATEGY' THEN 2 ELSE 3 END")
view("g_pairs", """
SELECT a.chunk_id, a.company, a.text, a.recency, a.node AS src, b.node AS dst FROM (SELECT chunk_id, company, text, recency, unnest(list_distinct(entities)) AS node FROM tagged) a
JOIN (SELECT chunk_id, unnest(list_distinct(entities)) AS node FROM tagged) b ON a.chunk_id = b.chunk_id AND a.node < b.node WHERE NOT (starts_with(a.node, 'METRIC::') AND starts_with(b.node, 'METRIC::'))""")
view("g_edges_all", "SELECT src, dst, count(*) AS count, sum(recency) AS recency_sum, count(DISTINCT company) AS num_companies, ln(1 + count(*)) * sum(recency) / count(*) AS weight FROM g_pairs GROUP BY 1, 2")
view("g_edges", "SELECT * FROM g_edges_all WHERE weight >= 0.3 AND src IN (SELECT node FROM g_nodes) AND dst IN (SELECT node FROM g_nodes)")
view("g_both", "SELECT src, dst, weight, count FROM g_edges UNION ALL SELECT dst, src, weight, count FROM g_edges")


def built(spark, sf):
    return G.build_graph(call_text(spark, sf), "chunk_id", DICTS, recency_table=RECENT)


_STORED: dict[tuple[str, str], str] = {}


def loaded(spark, sf):
    """(nodes, edges, members, contexts) of the graph as tables in the shared folder, built
    by the first look-up of a session, as a user loads a graph once and asks it many times."""
    key = (spark.sparkContext.applicationId, sf)
    names = ("nodes", "edges", "members", "contexts")
    if key not in _STORED:
        root = scratch_path(spark, "graph")
        G.write_graph(call_text(spark, sf), "chunk_id", DICTS, root, recency_table=RECENT)
        _STORED[key] = root
    return tuple(spark.read.parquet(f"{_STORED[key]}/{n}") for n in names)


@query("j9_cooccur", "SELECT src, dst, count(*) AS n FROM g_pairs GROUP BY 1, 2")
def _(spark, sf):
    t = G.entities(call_text(spark, sf), DICTS)
    return G.cooccurrences(t.select("chunk_id", "entities"), "chunk_id").groupBy("src", "dst").agg(F.count("*").alias("n"))


@query("a8_nodes", "SELECT node, type, count, num_companies, num_doc_types, num_periods FROM g_nodes")
def _(spark, sf):
    nodes, _m = G.node_rollup(G.entities(call_text(spark, sf), DICTS))
    return G.keep_nodes(nodes).select("node", "type", "count", "num_companies", "num_doc_types", "num_periods")


@query("a9_edges", """
SELECT e.src, e.dst, e.count, e.num_companies, e.weight, c.contexts FROM g_edges_all e JOIN (SELECT src, dst, string_agg(md5(substr(text, 1, 200)), ',' ORDER BY chunk_id) AS contexts FROM (SELECT * FROM g_pairs QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY chunk_id) <= 2) GROUP BY 1, 2) c USING (src, dst) WHERE weight >= 0.3""", rounds="weight")
def _(spark, sf):
    t = cut_lineage(G.entities(call_text(spark, sf), DICTS).select("chunk_id", "company", "period", "text", "entities"))
    pairs = G.cooccurrences(t, "chunk_id")
    e = G.edge_rollup(pairs, "chunk_id", G.recency(F.col("period"), RECENT)).filter("weight >= 0.3")
    c = G.edge_contexts(pairs, "chunk_id", "text")
    return e.join(c, ["src", "dst"]).select("src", "dst", "count", "num_companies", "weight", F.array_join(F.transform("contexts", lambda x: F.md5(x)), ",").alias("contexts"))


@query("g1_graph", "SELECT src, dst, count, weight, num_companies FROM g_edges", rounds="weight")
def _(spark, sf):
    return built(spark, sf)[1].select("src", "dst", "count", "weight", "num_companies")


@query("j10_semi_edges", "SELECT src, dst, count FROM g_edges_all WHERE src IN (SELECT node FROM g_nodes WHERE type IN ('TOPIC', 'STRATEGY')) AND dst IN (SELECT node FROM g_nodes WHERE type IN ('TOPIC', 'STRATEGY'))")
def _(spark, sf):
    nodes, edges, _m = built(spark, sf)
    return G.semi_edges(edges, nodes.filter("type in ('TOPIC', 'STRATEGY')")).select("src", "dst", "count")


@query("g2_profile", """
SELECT m.company, n.type, n.label, n.count AS mentions, CAST(row_number() OVER (PARTITION BY m.company, n.type ORDER BY n.count DESC, n.node) AS INT) AS rank FROM (SELECT DISTINCT node, company FROM mentions) m JOIN g_nodes n USING (node) WHERE n.type <> 'COMPANY'""")
def _(spark, sf):
    nodes, _e, members, _c = loaded(spark, sf)
    return G.profile(nodes, members)


@query("g3_topic_leaders", "SELECT src AS topic, string_split(dst, '::')[2] AS company, weight, count FROM g_both WHERE src = 'TOPIC::margin' AND starts_with(dst, 'COMPANY::')", rounds="weight")
def _(spark, sf):
    nodes, edges, _m, _c = loaded(spark, sf)
    return G.topic_leaders(nodes, edges, "Marg")


@query("k2_top_degree", "SELECT src AS node, count(*) AS degree FROM g_both GROUP BY 1 ORDER BY degree DESC, node LIMIT 15")
def _(spark, sf):
    return G.degrees(loaded(spark, sf)[1]).orderBy(F.desc("degree"), "node").limit(15)


@query("k3_tier_search", "SELECT node, count, CASE WHEN lower(label) = 'fy0' THEN 3 WHEN starts_with(lower(label), 'fy0') THEN 2 ELSE 1 END AS relevance FROM g_nodes WHERE contains(lower(label), 'fy0') ORDER BY relevance DESC, count DESC, node LIMIT 50")
def _(spark, sf):
    nodes, _e, _m, _c = loaded(spark, sf)
    return G.tier_search(nodes, "FY0").select("node", "count", "relevance")


@query("j14_array_contains", "SELECT company, count(*) AS n_nodes, sum(count)::BIGINT AS mentions FROM (SELECT DISTINCT m.company, n.node, n.count FROM mentions m JOIN g_nodes n USING (node)) GROUP BY 1")
def _(spark, sf):
    """Nodes of every company through the membership table instead of array search."""
    nodes, _e, members, _c = loaded(spark, sf)
    return members.join(nodes.select("node", "count"), "node").groupBy("company").agg(F.count("*").alias("n_nodes"), F.sum("count").alias("mentions"))


_NB = "SELECT dst FROM g_both WHERE src = 'TOPIC::debt' ORDER BY round(weight, 9) DESC, dst LIMIT 25"


@query("g5_neighbors", f"WITH ids AS (SELECT dst AS node FROM ({_NB}) UNION ALL SELECT 'TOPIC::debt') SELECT src, dst, weight FROM g_edges WHERE src IN (SELECT node FROM ids) AND dst IN (SELECT node FROM ids)", rounds="weight")
def _(spark, sf):
    nodes, edges, _m, _c = loaded(spark, sf)
    return G.neighbourhood(nodes, edges, "TOPIC::debt", 25)[1].select("src", "dst", "weight")


@query("g6_subgraph", """
WITH top AS (SELECT node FROM g_nodes WHERE node IN (SELECT node FROM mentions WHERE company = 'C3') ORDER BY count DESC, node LIMIT 20)
SELECT src, dst, weight FROM g_edges WHERE src IN (SELECT node FROM top) AND dst IN (SELECT node FROM top) ORDER BY round(weight, 9) DESC, src, dst LIMIT 60""", rounds="weight")
def _(spark, sf):
    nodes, edges, members, _c = loaded(spark, sf)
    return G.company_subgraph(nodes, edges, members, "C3", 20)[1].select("src", "dst", "weight")


@query("g7_summary", """
WITH reach(node, seen) AS (SELECT DISTINCT src, src FROM g_both UNION SELECT r.node, b.dst FROM reach r JOIN g_both b ON b.src = r.seen)
SELECT 'nodes' AS stat, count(*)::DOUBLE AS value FROM g_nodes UNION ALL SELECT 'edges', count(*)::DOUBLE FROM g_edges UNION ALL SELECT 'type:' || type, count(*)::DOUBLE FROM g_nodes GROUP BY type
UNION ALL SELECT 'components', count(DISTINCT coalesce(c.component, n.node))::DOUBLE FROM g_nodes n LEFT JOIN (SELECT node, min(seen) AS component FROM reach GROUP BY 1) c USING (node)
UNION ALL SELECT 'max_degree', max(d)::DOUBLE FROM (SELECT count(*) AS d FROM g_both GROUP BY src) UNION ALL SELECT 'density', 2.0 * (SELECT count(*) FROM g_edges) / ((SELECT count(*) FROM g_nodes) * ((SELECT count(*) FROM g_nodes) - 1.0))""", rounds="value")
def _(spark, sf):
    nodes, edges, _m, _c = loaded(spark, sf)
    return G.summary(nodes, edges)


@query("g7_topics", "SELECT label, count FROM g_nodes WHERE type = 'TOPIC'")
def _(spark, sf):
    return G.topics(loaded(spark, sf)[0])


@query("g7_components", """
WITH reach(node, seen) AS (SELECT DISTINCT src, src FROM g_both UNION SELECT r.node, b.dst FROM reach r JOIN g_both b ON b.src = r.seen)
SELECT node, min(seen) AS component FROM reach GROUP BY 1""")
def _(spark, sf):
    """Connected components of the entity graph."""
    return G.components(loaded(spark, sf)[1].select("src", "dst"))


@query("g4_shortest_path", """
WITH start AS (SELECT min(src) AS s FROM g_both),
reach(node, hop) AS (SELECT s, 0 FROM start UNION SELECT b.dst, r.hop + 1 FROM reach r JOIN g_both b ON b.src = r.node WHERE r.hop < 12)
SELECT node, CAST(min(hop) AS INT) AS hops, CAST(min(hop) + 1 AS INT) AS path_nodes FROM reach GROUP BY 1""")
def _(spark, sf):
    """Hops from the first node of the entity graph to all it reaches, each with the node
    before it on a shortest path."""
    e = loaded(spark, sf)[1].select("src", "dst")
    start = G.both_ways(e).agg(F.min("src")).first()[0]
    return G.hop_distances(e, start).select("node", "hops", (F.col("hops") + 1).alias("path_nodes"))


_ASKS = [("margin", "debt"), ("C3", "growth"), ("C1", "C2"), ("ours", "C12"), ("debt", "debt"), ("fy0", "no such term"), ("no such term", "margin")]
view("g_asks", "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _ASKS) + ") t(term1, term2)")
view("g_found", """
SELECT term, arg_min(node, struct_pack(t := -tier, c := -count, n := node)) AS node FROM (
  SELECT t.term, n.node, n.count, CASE WHEN lower(n.label) = lower(t.term) THEN 3 WHEN starts_with(lower(n.label), lower(t.term)) THEN 2 ELSE 1 END AS tier
  FROM (SELECT term1 AS term FROM g_asks UNION SELECT term2 FROM g_asks) t JOIN g_nodes n ON contains(lower(n.label), lower(t.term))) GROUP BY 1""")
view("g_contexts", "SELECT src, dst, string_agg(md5(substr(text, 1, 200)), ',' ORDER BY chunk_id) AS contexts FROM (SELECT * FROM g_pairs QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY chunk_id) <= 2) GROUP BY 1, 2")


@query("g4_connections", """
WITH asked AS (SELECT a.*, x.node AS node1, y.node AS node2 FROM g_asks a LEFT JOIN g_found x ON x.term = a.term1 LEFT JOIN g_found y ON y.term = a.term2),
reach(node1, node, hop) AS (SELECT DISTINCT node1, node1, 0 FROM asked WHERE node1 IS NOT NULL UNION SELECT r.node1, b.dst, r.hop + 1 FROM reach r JOIN g_both b ON b.src = r.node WHERE r.hop < 8),
far AS (SELECT node1, node, min(hop) AS hop FROM reach GROUP BY 1, 2)
SELECT a.term1, a.term2, a.node1, a.node2, e.weight IS NOT NULL AS directly_connected, coalesce(f.hop, -1)::INT AS path_length, f.hop IS NOT NULL AS path_fits, e.weight, e.count, c.contexts
FROM asked a LEFT JOIN far f ON f.node1 = a.node1 AND f.node = a.node2
LEFT JOIN g_edges e ON e.src = least(a.node1, a.node2) AND e.dst = greatest(a.node1, a.node2) LEFT JOIN g_contexts c ON c.src = e.src AND c.dst = e.dst""", rounds="weight")
def _(spark, sf):
    """Connections of several pairs of terms: direct, over others, with itself, unknown.
    Of the paths, which need not be the only ones, the steps are checked to be edges."""
    nodes, edges, _m, contexts = loaded(spark, sf)
    got = reduce(DataFrame.unionByName, [G.connections(nodes, edges, a, b, contexts) for a, b in _ASKS])
    got = cut_lineage(got)
    label = nodes.select(F.col("label").alias("l"), F.col("node").alias("n"))
    steps = got.where("path is not null").select("term1", "term2", F.posexplode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("path") - 1, F.lit(1))), lambda i: F.struct(F.col("path")[i - 1].alias("x"), F.try_element_at("path", i + 1).alias("y")))).alias("i", "s")).select("term1", "term2", "i", "s.*")
    ways = G.both_ways(edges).join(label, F.col("src") == F.col("n")).select(F.col("l").alias("x"), "dst").join(label, F.col("dst") == F.col("n")).select("x", F.col("l").alias("y"), F.lit(1).alias("edge")).distinct()
    fits = steps.join(ways, ["x", "y"], "left").groupBy("term1", "term2").agg(F.min(F.coalesce("edge", F.when(F.col("y").isNull(), 1), F.lit(0))).alias("fits"))
    out = got.join(fits, ["term1", "term2"], "left").withColumn("path_fits", F.coalesce(F.col("fits") == 1, F.lit(False)))
    hashed = F.array_join(F.transform("contexts", lambda x: F.md5(x)), ",")
    return out.select("term1", "term2", "node1", "node2", "directly_connected", "path_length", "path_fits", "weight", "count", hashed.alias("contexts"))


@query("g8_graph_upsert", """
SELECT node, type, CAST(count + CASE WHEN length(node) % 3 = 0 THEN 10 ELSE 0 END AS BIGINT) AS count FROM g_nodes UNION ALL SELECT 'COMPANY::NEW', 'COMPANY', 1""")
def _(spark, sf):
    """Node table merged by key: newer rows replace, late ones do not, new ones are added."""
    nodes = loaded(spark, sf)[0].select("node", "type", F.col("count").cast("bigint").alias("count"))
    third = F.length("node") % 3
    newer = nodes.where(third == 0).withColumns({"count": F.col("count") + 10, "version": F.lit(2)})
    late = nodes.where(third == 1).withColumns({"count": F.lit(-1).cast("bigint"), "version": F.lit(0)})
    added = spark.range(1).select(F.lit("COMPANY::NEW").alias("node"), F.lit("COMPANY").alias("type"), F.lit(1).cast("bigint").alias("count"), F.lit(1).alias("version"))
    out = K.upsert(nodes.withColumn("version", F.lit(1)), newer.unionByName(late).unionByName(added), ["node"], ["version"])
    return out.drop("version")


@query("g10_collision", """
WITH s AS (SELECT company_id, market, revenue / sum(revenue) OVER (PARTITION BY market) * 100 AS share FROM market_revenue)
SELECT a.market, a.company_id AS left_id, b.company_id AS right_id, a.share + b.share AS combined_share FROM s a JOIN s b ON a.market = b.market AND a.company_id < b.company_id WHERE a.share + b.share >= 2.4""", rounds="combined_share")
def _(spark, sf):
    m = market_revenue(spark, sf)
    total = m.groupBy("market").agg(F.sum("revenue").alias("total"))
    return G.collisions(m.join(total, "market").select("company_id", "market", (F.col("revenue") / F.col("total") * 100).alias("share")), 2.4)
