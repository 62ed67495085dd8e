"""Joins, de-duplication, graph and streaming operators against brute force."""

import random

import pytest

from pyspark.sql import functions as F

from guidepost.operators import graph as G
from guidepost.operators import joins as J
from guidepost.operators import news as N
from guidepost.operators import promises as M
from guidepost.operators import retrieval as R
from guidepost.operators import text as T
from guidepost.sources import documents as D
from guidepost.sources import sinks as K
from guidepost.streaming import jobs as ST


def test_token_set_ratio_known_values():
    assert N.token_set_ratio(["a", "b"], ["b", "a", "c"]) == 100.0
    assert N.token_set_ratio([], ["a"]) == 0.0
    assert abs(N.token_set_ratio(["hotel"], ["hotels"]) - 100 * (1 - 1 / 11)) < 1e-9
    assert N.token_set_ratio(["x"], ["y"]) == 0.0


def brute_dedupe(rows):
    kept = []
    for i, day, title in sorted(rows):
        if not any(d == day and N.token_set_ratio(title.split(), t.split()) >= 92 for _, d, t in kept):
            kept.append((i, day, title))
    return {i for i, *_ in kept}


def test_fuzzy_dedupe_equals_brute_force(spark):
    rnd = random.Random(11)
    vocab = ["the", "the", "the", "profit", "growth", "quarter", "hotel", "margin", "outlook", "results", "guidance", "expansion", "raises", "cuts"]
    rows = []
    for i in range(260):
        words = [rnd.choice(vocab) for _ in range(rnd.randrange(1, 9))]
        if rows and rnd.random() < 0.5:
            words = rnd.choice(rows)[2].split()
            k = rnd.randrange(max(len(words), 1)) if words else 0
            if words and rnd.random() < 0.6:
                w = words[k]
                words[k] = rnd.choice([w + "s", w[:-1] or w, w[:1] + "x" + w[1:]])
        rows.append((i, f"d{rnd.randrange(3)}", " ".join(words)))
    rows.append((260, "d0", ""))
    df = spark.createDataFrame(rows, "doc_id int, day string, title string")
    got = {r.doc_id for r in N.fuzzy_dedupe(df, "doc_id", "day", "title").select("doc_id").collect()}
    assert got == brute_dedupe(rows)


def test_asof_with_and_without_blocks(spark):
    rnd = random.Random(5)
    left = spark.createDataFrame([(i, rnd.choice("ab"), rnd.randrange(100)) for i in range(200)], "id int, k string, t int")
    right_rows = [(k, t, t * 10) for k in "ab" for t in sorted(rnd.sample(range(100), 20))]
    right = spark.createDataFrame(right_rows, "k string, t int, v int")
    plain = {r.id: (r.asof_key, r.asof_v) for r in J.asof_backward(left, right, ["k"], "t", "t", ["v"]).collect()}
    blocks = {r.id: (r.asof_key, r.asof_v) for r in J.asof_backward(left, right, ["k"], "t", "t", ["v"], block=lambda c: F.floor(c / 7)).collect()}
    assert plain == blocks
    for r in left.collect():
        best = max((t for k, t, _ in right_rows if k == r.k and t <= r.t), default=None)
        assert plain[r.id] == (best, None if best is None else best * 10)


def test_components_against_union_find(spark):
    rnd = random.Random(9)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + j) for j in range(1, 30)] + [(rnd.randrange(200, 260), rnd.randrange(200, 260)) for _ in range(40)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = {r.node: r.component for r in G.components(spark.createDataFrame(edges, "src int, dst int")).collect()}
    assert got == {x: find(x) for x in parent}


def test_shortest_path_and_hop_cap(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("a", "x"), ("x", "d")], "src string, dst string")
    r = G.shortest_path(e, "a", "d").first()
    assert r.hops == 2 and r.path == ["a", "x", "d"]
    assert G.shortest_path(e, "a", "c", max_hops=1).count() == 0


def test_first_kept_resolution_follows_chains(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "src int, dst int")
    assert {r.id for r in N.resolve_first_kept(e).collect()} == {2, 4}


def fold(flags):
    x = 80.0
    for f in flags:
        x = max(0.0, x - 8) if f == "MISS" else min(100.0, x + 3) if f == "BEAT" else x
    return x


def test_meter_composition_hits_both_limits(spark):
    runs = {"floor": ["MISS"] * 14 + ["BEAT"] * 2, "ceiling": ["BEAT"] * 9 + ["MISS"], "mixed": [random.Random(4).choice(["MISS", "BEAT", "IN-LINE"]) for _ in range(300)]}
    rows = [(k, i // 3, i, f) for k, fs in runs.items() for i, f in enumerate(fs)]
    df = spark.createDataFrame(rows, "k string, blk int, i int, flag string")
    got = {r.k: r.meter for r in ST.meter_batch(df, "k", "blk", ["i"]).collect()}
    assert got == {k: fold(fs) for k, fs in runs.items()}


def test_upsert_newest_update_wins_and_append_keeps_old(spark):
    t = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "id int, v string, ver int")
    u = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "id int, v string, ver int")
    assert {(r.id, r.v) for r in K.upsert(t, u, ["id"], ["ver"]).collect()} == {(1, "a"), (2, "y"), (3, "z")}
    assert {(r.id, r.v) for r in K.append_new(t, u.filter("ver = 1"), ["id"]).collect()} == {(1, "a"), (2, "b"), (3, "z")}


def test_json_recovery_and_routing(spark):
    raw = 'Sure! ```json\n[{"table":"GUIDANCE_CLAIM","company_id":"C1","source_document":"d","verbatim_quote":"we will","guidance_value_low":"abc"},{"table":"nope"}]\n``` done'
    df = spark.createDataFrame([(1, raw), (2, "no array"), (3, "[{broken")], "id int, t string")
    items = D.parse_items(df, "t", ["id"])
    tables, rejects = D.route_items(items)
    claim = tables["guidance_claims"].first()
    assert claim.metric_type == "other" and claim.guidance_value_low is None
    assert [r.reject_reason for r in rejects.collect()] == ["unknown_table"]


def test_promise_verification_ladder(spark):
    c = spark.createDataFrame([(9.0, 10.0, None, "down", ""), (10.4, 10.0, None, "down", ""), (11.0, 10.0, 10.2, "up", ""), (10.0, 10.0, 10.2, "up", ""), (8.0, 10.0, None, "up", ""), (7.9, 10.0, None, "up", ""), (8.9, 10.0, None, "up", "below")],
                              "a double, lo double, hi double, d string, c string")
    got = [r[0] for r in c.select(M.classify(F.col("a"), F.col("lo"), F.col("hi"), F.col("d"), F.col("c"))).collect()]
    assert got == ["EXCEEDED", "KEPT", "EXCEEDED", "KEPT", "PARTIAL", "BROKEN", "EXCEEDED"]


def test_chunking_covers_the_text_and_can_drop_contained_tails(spark):
    text = "".join(random.Random(6).choice("abc ") for _ in range(1000)).strip()
    df = spark.createDataFrame([(1, text)], "id int, t string")
    parts = T.chunk(df, "t", 300, 50).orderBy("chunk_index").collect()
    assert "".join(p.chunk_text if i == 0 else p.chunk_text[50:] for i, p in enumerate(parts)) == text
    assert T.chunk(df, "t", 300, 50, drop_contained=True).count() <= len(parts)


def test_ivf_recall_is_full_when_all_lists_are_probed(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    q = e.first().embedding
    index, cents = R.build_ivf(e, "embedding", 4)
    near = {r.vec_id for r in R.ivf_topk(index, cents, "embedding", q, 10, 4, "vec_id").collect()}
    assert near == {r.vec_id for r in R.cosine_topk(e, "embedding", q, 10, "vec_id").collect()}


def test_health_counters_observed_on_a_stream(spark, sf):
    events = spark.readStream.schema(spark.read.parquet(f"{sf}/events.parquet").schema).parquet(f"{sf}/events*.parquet")
    tagged = ST.observe_health(events.withColumn("drop_reason", F.when(F.col("value") < 10, "low_relevance")))
    q = tagged.writeStream.format("noop").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = [p["observedMetrics"]["health"] for p in q.recentProgress if p.get("observedMetrics")]
    n = spark.read.parquet(f"{sf}/events.parquet").count()
    assert sum(r["input"] for r in rows) == n and sum(r["accepted"] + r["dropped"] for r in rows) == n


def test_fuzzy_dedupe_finds_split_joined_and_long_tokens(spark):
    rnd = random.Random(23)
    long = ["annuityfundmanagement", "counterrevolutionaryinterdenominational", "donaudampfschifffahrtsgesellschaft", "rindfleischetikettierungsgesetz", "kraftfahrzeughaftpflichtversicherung", "a", "of", "q4", "ebitda"]
    titles = ["annuity fundmanagement", "annuityfundmanagement", "counterrevolutionaryinterdenominational", "counterrevolutionaryinterdenominatil", "a b c d e f g", "a b c d e f h", "x y", "x z"]
    for _ in range(180):
        words = [rnd.choice(long) for _ in range(rnd.randrange(1, 5))]
        for _ in range(rnd.randrange(3)):
            k = rnd.randrange(len(words))
            w, cut = words[k], rnd.randrange(len(words[k]) + 1)
            words[k] = rnd.choice([w[:cut] + w[cut + 1 :], w[:cut] + "z" + w[cut:], w[:cut] + " " + w[cut:]])
        titles.append(" ".join(words))
    rows = [(i, f"d{i % 2}" if i >= 8 else "d0", t) for i, t in enumerate(titles)]
    df = spark.createDataFrame(rows, "doc_id int, day string, title string")
    got = {r.doc_id for r in N.fuzzy_dedupe(df, "doc_id", "day", "title").select("doc_id").collect()}
    assert got == brute_dedupe(rows)
    assert 1 not in got and 3 not in got


def test_upsert_keeps_a_newer_stored_row(spark):
    t = spark.createDataFrame([(1, "new", 10), (2, "old", 1)], "id int, v string, ver int")
    late = spark.createDataFrame([(1, "late", 5), (2, "mid", 3), (2, "up", 4), (3, "first", 2)], "id int, v string, ver int")
    assert {(r.id, r.v) for r in K.upsert(t, late, ["id"], ["ver"]).collect()} == {(1, "new"), (2, "up"), (3, "first")}
    assert {(r.id, r.v) for r in K.upsert(K.upsert(t.limit(0), late, ["id"], ["ver"]), t, ["id"], ["ver"]).collect()} == {(1, "new"), (2, "up"), (3, "first")}


def test_facts_of_any_year_and_whole_pages(spark):
    from guidepost.sources import documents as D
    from guidepost.sources import statements as ST

    facts = spark.createDataFrame([("C1", "revenue", "FY95", 1995, 1.5), ("C1", "revenue", "FY30", 2030, 2.5)], "company_id string, metric string, period string, fy int, value double")
    columns = ST.year_columns(facts)
    assert columns == {"FY95": "Mar 1995", "FY30": "Mar 2030"}
    back = ST.melt_statement(ST.statement_table(facts, columns), ["company_id"], "row")
    assert {(r.period, r.value) for r in back.collect()} == {("FY95", 1.5), ("FY30", 2.5)}
    page = spark.createDataFrame([("<title>t</title>" + "<p>word</p>" * 2000 + "".join(f'<a href="/{i}">a link text of some length {i}</a>' for i in range(300)),)], "html string")
    assert len(D.pages_text(page).first().page_text) > 6000
    assert D.extract_links(page.selectExpr("html", "'http://h/x' as url"), "html", "url", []).count() == 300


def test_cluster_needs_a_shared_folder():
    from guidepost import session

    class Conf:
        def get(self, key, default):
            return default

    class Spark:
        conf = Conf()

        class sparkContext:
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(Spark())


def test_daily_run_is_its_steps(spark, sf):
    from guidepost.catalog import QUERIES
    from guidepost.catalog import q_news as Q

    items = sorted(Q.accepted(spark, sf).select("doc_id", "uid", "published_date", "content_signature", "title").collect())
    first, second, titles = {}, {}, []
    for r in items:
        if first.setdefault(r.uid, r.doc_id) == r.doc_id and second.setdefault((r.published_date, r.content_signature), r.doc_id) == r.doc_id:
            titles.append((r.doc_id, r.published_date, r.title))
    kept = brute_dedupe(titles)
    rows = QUERIES["n7_daily"](spark, sf).collect()
    assert rows and {r.doc_id for r in rows} <= kept and all(r.url for r in rows)
    steps = {}
    for r in QUERIES["n7_health"](spark, sf).collect():
        steps[r.step] = steps.get(r.step, 0) + r.n
    assert (steps["accepted"], steps["exact"], steps["fuzzy"]) == (len(items), len(titles), len(kept)) and steps["evidence"] <= len(kept)


def brute_packs(lengths, most):
    room, pack, out = 0, 0, []
    for n in lengths:
        if room and room + n + 1 > most:
            room, pack = 0, pack + 1
        room += n + 1
        out.append(pack)
    return out


def test_packs_equal_a_walk_over_the_pages(spark):
    rnd = random.Random(3)
    docs = {
        "many": [rnd.choice([0, 1, 5, 40, 99, 100, 101, 350]) for _ in range(700)], "one": [12], "giant": [1000, 0, 0, 2000, 5],
        "exact": [49, 49, 49, 49, 99, 99], "empty": [0] * 250, "null": [None, 30, None, 80],
    }
    rows = [(d, i * 3 + 1, None if n is None else "x" * n) for d, ns in docs.items() for i, n in enumerate(ns)]
    got = {}
    packs = T.pack_pages(spark.createDataFrame(rows, "doc string, page int, txt string"), "doc", "page", "txt", 100)
    assert "Python" not in packs._jdf.queryExecution().executedPlan().toString() and "InPandas" not in packs._jdf.queryExecution().executedPlan().toString()
    for r in packs.collect():
        got.setdefault(r.doc, []).append((r.pack, r.n_pages, r.first_page, r.last_page))
    for d, ns in docs.items():
        want = brute_packs([n or 0 for n in ns], 100)
        spans = [(p, want.count(p), want.index(p) * 3 + 1, (len(want) - 1 - want[::-1].index(p)) * 3 + 1) for p in sorted(set(want))]
        assert sorted(got[d]) == spans, d
    assert T.pack_pages(spark.createDataFrame([], "doc string, page int, txt string"), "doc", "page", "txt", 100).count() == 0


def test_index_along_a_document(spark):
    rows = [("a", 2, 0), ("a", 1, 0), ("a", 1, 1), ("a", 10, 0), ("b", 5, 0)]
    got = T.document_index(spark.createDataFrame(rows, "doc string, page int, chunk_index int"), ["doc"], ["page", "chunk_index"], "i").collect()
    assert sorted((r.doc, r.page, r.chunk_index, r.i) for r in got) == [("a", 1, 0, 0), ("a", 1, 1, 1), ("a", 2, 0, 2), ("a", 10, 0, 3), ("b", 5, 0, 0)]


def test_files_of_entities_and_calls(spark, tmp_path):
    plain = tmp_path / "plain"
    for path, text in {"ACME/Annual_Reports/2023.txt": "one\ntwo", "ACME/Call_Notes/2024_Feb.json": "three", "Other/Misc/notes.txt": "x", "Other/Misc/empty.txt": ""}.items():
        (plain / path).parent.mkdir(parents=True, exist_ok=True)
        (plain / path).write_text(text)
    got = sorted((r.company_id, r.doc_type, r.period or "", r.value) for r in D.load_entity_dirs(spark, str(plain), {"ACME": "A"}).collect())
    assert got == [("A", "annual_report", "FY23", "one\ntwo"), ("A", "call_transcript", "Feb 2024", "three"), ("UNMAPPED", "other", "", "x")]
    rows = spark.createDataFrame([("ACME", "Annual_Reports", "2023.pdf", "l1"), ("ACME", "Annual_Reports", "2023.pdf", "l2")], "entity string, kind string, name string, value string")
    rows.write.partitionBy("entity", "kind", "name").text(str(tmp_path / "parted"))
    back = D.load_entity_dirs(spark, str(tmp_path / "parted"), {"ACME": "A"}, whole=False).collect()
    assert sorted((r.company_id, r.period, r.file_name, r.value) for r in back) == [("A", "FY23", "2023.pdf", "l1"), ("A", "FY23", "2023.pdf", "l2")]
    calls = tmp_path / "calls"
    calls.mkdir()
    (calls / "2024_Feb.json").write_text('[{"speaker": "S", "text": "one two three"}, {"speaker": "T", "text": "short"}]')
    turns = D.read_transcripts_json(spark, str(calls), min_words=2).collect()
    assert [(r.speaker, r.period, r.text) for r in turns] == [("S", "Feb 2024", "one two three")] and turns[0].reported_quarter


def test_routed_items_are_written_in_one_pass(spark, tmp_path):
    blank = dict.fromkeys(D.ITEM_FIELDS)
    made = [
        {"table": "HOTEL_OPS_METRIC", "company_id": "A", "source_document": "d", "value": "12.5", "period": "FY24"},
        {"table": "financials", "company_id": "A", "source_document": "d", "value": "n/a"}, {"table": "raw_data", "company_id": "", "source_document": "d", "value_text": "t"},
        {"table": "raw_data", "company_id": "A", "source_document": "d", "value_text": "t", "value_numeric": "7"}, {"table": None, "company_id": "A", "source_document": "d"},
        {"table": "risk_flags", "company_id": "A", "source_document": "d", "description": "x", "value": "9"},
    ]
    items = spark.createDataFrame([tuple((blank | m)[f] for f in D.ITEM_FIELDS) for m in made], ", ".join(f"`{f}` string" for f in D.ITEM_FIELDS))
    D.write_routed(items, str(tmp_path / "routed"))
    back = spark.read.parquet(str(tmp_path / "routed")).collect()
    good = {r.target: r for r in back if r.reject_reason is None}
    assert (good["financials"].value, good["financials"].metric, good["financials"].period_label) == (12.5, "unknown", "FY24")
    assert (good["raw_data"].value_numeric, good["raw_data"].category, good["risk_flags"].category, good["risk_flags"].value) == (7.0, "other", "operational", None)
    assert sorted(r.reject_reason for r in back if r.target == "rejected") == ["missing_required", "missing_source", "unknown_table"]


def test_health_report_counts_every_loss(spark, sf):
    from guidepost.catalog import QUERIES
    from guidepost.catalog import q_news as Q

    rows = QUERIES["n7_report"](spark, sf).collect()
    total = lambda section, name=None: sum(r.n for r in rows if r.section == section and name in (None, r.name))
    d = Q.enriched(spark, sf)
    assert total("raw") == d.count() and total("gate") == total("lost", "gates") == d.filter("drop_reason is not null").count()
    items = sorted(Q.accepted(spark, sf).select("doc_id", "title").collect())
    assert total("raw") - total("lost") == total("final") > 0 and total("lost", "same_key") + total("lost", "same_signature") > 0
    assert 0 < total("missing", "title") <= sum(r.doc_id % 7 == 4 for r in items)
    assert total("lost", "no_evidence") <= total("missing")
