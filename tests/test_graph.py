import random
from collections import deque

from guidepost.operators import graph as G


def bfs(edges, start):
    near: dict = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    hops, todo = ({start: 0} if start in near else {}), deque([start])
    while todo:
        x = todo.popleft()
        for y in near.get(x, ()):
            if y not in hops:
                hops[y] = hops[x] + 1
                todo.append(y)
    return hops


def test_paths_from_both_ends_are_shortest(spark):
    r = random.Random(3)
    edges = list({tuple(sorted((f"n{r.randint(0, 60)}", f"n{r.randint(0, 60)}"))) for _ in range(75)} | {("p0", "p1"), ("p1", "p2"), ("p2", "p3"), ("p3", "p4")})
    edges = [e for e in edges if e[0] != e[1]]
    df = spark.createDataFrame(edges, "src string, dst string").cache()
    known = set(edges) | {(b, a) for a, b in edges}
    for a, b in [("p0", "p4"), ("n1", "n2"), ("n3", "n50"), ("n7", "n7"), ("n1", "p1"), ("n1", "absent")]:
        want = bfs(edges, a).get(b)
        got = G.shortest_path(df, a, b).collect()
        assert [x.hops for x in got] == ([] if want is None else [want])
        for x in got:
            assert x.path[0] == a and x.path[-1] == b and len(x.path) == want + 1 and all(s in known for s in zip(x.path, x.path[1:]))
    assert {x.node: x.hops for x in G.hop_distances(df, "p1").collect()} == bfs(edges, "p1")
    assert {x.node for x in G.hop_distances(df, "p1", 1).collect()} == {"p0", "p1", "p2"}


def test_connections_of_terms(spark):
    nodes = spark.createDataFrame([("TOPIC::debt", "debt", "TOPIC", 9), ("TOPIC::debts", "debts", "TOPIC", 50), ("C::A", "Alpha", "COMPANY", 5), ("C::B", "Beta", "COMPANY", 3), ("X::lone", "lone", "TOPIC", 1)], "node string, label string, type string, count long")
    edges = spark.createDataFrame([("C::A", "TOPIC::debt", 1.5, 4), ("C::B", "TOPIC::debt", 0.5, 2), ("C::B", "TOPIC::debts", 0.5, 2)], "src string, dst string, weight double, count long")
    contexts = spark.createDataFrame([("C::A", "TOPIC::debt", ["said so"])], "src string, dst string, contexts array<string>")
    ask = lambda a, b: G.connections(nodes, edges, a, b, contexts).first().asDict()
    got = ask("debt", "alph")
    assert (got["node1"], got["node2"], got["directly_connected"], got["path"], got["weight"], got["contexts"]) == ("TOPIC::debt", "C::A", True, ["debt", "Alpha"], 1.5, ["said so"])
    assert ask("alpha", "beta")["path"] == ["Alpha", "debt", "Beta"] and not ask("alpha", "beta")["directly_connected"]
    assert ask("alpha", "lone")["path_length"] == -1 and ask("alpha", "nothing")["node2"] is None
    assert [x.label for x in G.topics(nodes).collect()] == ["debt", "debts", "lone"]
    assert {x.stat: x.value for x in G.summary(nodes, edges).collect()}["components"] == 2


def test_stored_graph_searches_chunks_once(spark, tmp_path):
    """The stored tables are those of the whole build, from one look at the texts; metrics,
    which are no nodes, are neither searched for nor paired."""
    seen = spark.sparkContext.accumulator(0)

    def count(frames):
        for f in frames:
            seen.add(len(f))
            yield f

    rows = [(i, f"C{i % 3}", "call", f"Q{i % 4 + 1} FY02", "Asha Rao", f"Growth of {i}% and debt of INR {i} crore in FY{i % 3 + 1:02d}. " + "x" * 300) for i in range(60)]
    chunks = spark.createDataFrame(rows, "chunk_id long, company string, doc_type string, period string, speaker string, text string")
    dicts = {"TOPIC": {"growth": ["growth"], "debt": ["debt"]}}
    G.write_graph(chunks.mapInPandas(count, chunks.schema), "chunk_id", dicts, f"{tmp_path}/g")
    assert seen.value == 60
    whole = G.entities(chunks, dicts)
    assert any(e.startswith("METRIC::") for r in whole.collect() for e in r.entities)
    contexts = G.edge_contexts(G.cooccurrences(whole.select("chunk_id", "text", "entities"), "chunk_id"), "chunk_id", "text").where("not startswith(src, 'METRIC') and not startswith(dst, 'METRIC')")
    rounded = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else str(v) for v in r) for r in df.select(*sorted(df.columns)).collect())
    for name, want in zip(("nodes", "edges", "members", "contexts"), (*G.build_graph(chunks, "chunk_id", dicts), contexts)):
        got = rounded(spark.read.parquet(f"{tmp_path}/g/{name}"))
        assert got and got == rounded(want)
