"""Document, page, citation and text-mining queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import periods as P
from ..functions import values as X
from ..functions.citations import parse_citation
from ..operators import joins as J
from ..operators import dictionary as D2
from ..operators import text as T
from ..session import scratch_path
from ..sources import documents as D
from . import views as V
from .registry import query, view

# Words drawn from the given documents, standing in for the default lexicons.
TOPICS = {
    "TOPIC": {"articles": ["the ", "der ", "que "], "endings": ["tion", "mente"], "rare": ["thher", "quela", "ndnd"]},
    "BRAND": {"north": ["schver", "nicht"], "south": ["ción", "para"], "east": ["eaux", "ouel"]},
    "STRATEGY": {"grow": ["ingre", "anderst"], "hold": ["ich", "ment "]},
}
GROUPS = {"g_the": ["the ", "that ", "thther"], "g_der": ["der ", "und ", "ichich"], "g_que": ["que ", "los "], "g_mix": ["tion", "ing ", "ment"]}
SKIP, SIGNAL = ["the ", "der ", "que ", "les "], ["ther", "mente", "schen", "tionou"]
ALIASES = {"C_THE": ["thand", "theth"], "C_DER": ["undder", "schund"], "C_QUE": ["quelos", "queen"], "C_ION": ["tiontion"]}
STOP = ["the", "and", "of", "in", "to", "that", "was", "der", "die", "und", "que", "los", "les", "des"]


def contains_sum(col, words):
    return "(" + " + ".join(f"CAST(contains({col}, '{w}') AS INT)" for w in words) + ")"


def contains_any(col, words):
    return "(" + " OR ".join(f"contains({col}, '{w}')" for w in words) + ")"


WORDS_SQL = "len(list_filter(string_split_regex({c}, '\\s+'), lambda w: w <> ''))"
CLEAN_SQL = "regexp_replace(regexp_replace(replace(regexp_replace(coalesce({c}, ''), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g'), chr(160), ' '), ' {{2,}}', ' ', 'g'), '^\\s+|\\s+$', '', 'g')"
USEFUL_SQL = ("(length({c}) >= 20 AND " + WORDS_SQL + " >= 5 AND NOT starts_with({c}, 'http') AND NOT starts_with({c}, 'www.') "
              "AND length(regexp_replace({c}, '[^\\p{{L}}]', '', 'g')) / greatest(length({c}), 1) >= 0.3 AND NOT (" + contains_any("lower({c})", T.L.BOILERPLATE) + " AND length({c}) < 200))")
NORM_SQL = "trim(regexp_replace(coalesce({c}, ''), '\\s+', ' ', 'g'))"


def paged(spark, sf):
    """Documents as nested pages: five lines to a page."""
    d = V.table(spark, sf, "documents").select("doc_id", "source", F.split("text", "\n").alias("lines"))
    n_pages = F.ceil(F.size("lines") / 5).cast("int")
    pages = F.transform(F.sequence(F.lit(1), n_pages), lambda i: F.struct(i.alias("page_number"), F.slice("lines", (i - 1) * 5 + 1, 5).alias("paragraphs")))
    return d.select("doc_id", "source", pages.alias("pages"))


view("paras", """
SELECT doc_id, source, CAST((i - 1) // 5 + 1 AS INT) AS page_number, CAST((i - 1) % 5 AS INT) AS paragraph_no, line FROM (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)""")
view("doc_pages", "SELECT doc_id, page_number, string_agg(line, chr(10) ORDER BY paragraph_no) AS page_text FROM paras GROUP BY 1, 2")


def doc_pages(spark, sf):
    return paged(spark, sf).select("doc_id", F.inline("pages")).select("doc_id", "page_number", F.array_join("paragraphs", "\n").alias("page_text"))


_CL = CLEAN_SQL.format(c="line")


@query("s4_doc_flatten", f"SELECT doc_id, page_number, paragraph_no, md5(text) AS text_md5, source FROM (SELECT *, {_CL} AS text FROM paras) WHERE {USEFUL_SQL.format(c='text')}")
def _(spark, sf):
    """Nested documents written as JSON arrays, a bounded number to a file, and read back."""
    path = scratch_path(spark, "documents-json")
    one = F.to_json(F.struct(F.col("doc_id").cast("string").alias("source_file"), F.col("source").alias("company_id"), "pages"))
    files = paged(spark, sf).select(F.floor(F.col("doc_id") / 64).alias("file"), one.alias("doc")).groupBy("file").agg(F.concat(F.lit("["), F.array_join(F.collect_list("doc"), ","), F.lit("]")).alias("value"))
    files.write.partitionBy("file").text(path)
    back = D.read_documents_json(spark, path)
    return back.select(F.col("source_file").cast("long").alias("doc_id"), "page_number", "paragraph_no", F.md5("text").alias("text_md5"), F.col("company_id").alias("source"))


@query("s5_turns", f"""
SELECT conv_id, turn, 'Speaker ' || role AS speaker, period, md5(text) AS text_md5 FROM (SELECT conv_id, turn, role, {CLEAN_SQL.format(c='text')} AS text,
  (['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'])[conv_id % 12 + 1] || ' ' || (2020 + conv_id % 5) AS period FROM conversations) WHERE {WORDS_SQL.format(c='text')} >= 8""")
def _(spark, sf):
    """Turns written as JSON lines to a folder per call month, and read back."""
    call = F.concat((2020 + F.col("conv_id") % 5).cast("string"), F.lit("_"), P.month_name(F.col("conv_id") % 12 + 1))
    path = scratch_path(spark, "transcripts")
    t = V.table(spark, sf, "conversations").select("conv_id", "turn", F.concat(F.lit("Speaker "), "role").alias("speaker"), "text", call.alias("call"))
    t.write.partitionBy("call").json(path)
    back = D.read_transcripts_json(spark, path, extra="conv_id bigint, turn bigint", multi_line=False)
    return back.select("conv_id", "turn", "speaker", "period", F.md5("text").alias("text_md5"))


def _unesc(c):
    for a, b in (("&nbsp;", "' '"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "'\"'"), ("&#39;", "''''"), ("&amp;", "'&'")):
        c = f"replace({c}, '{a}', {b})"
    return c


_STRIP = "regexp_replace(regexp_replace(regexp_replace({c}, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"
_VIS = NORM_SQL.format(c=_unesc(_STRIP.format(c="html")))


view("page_texts", f"SELECT page_id, url, {NORM_SQL.format(c=_unesc('''regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)'''))} AS title, {_VIS} AS full_text FROM pages")


@query("s6_page_text", "SELECT page_id, url, title, full_text AS page_text FROM page_texts")
def _(spark, sf):
    return D.pages_text(V.table(spark, sf, "pages")).drop("html")


_LINK_WORDS = ["the", "en", "der", "que", "att"]


@query("s7_links", f"""
SELECT page_id, url, CAST(link_no - 1 AS INT) AS link_no, link_text, CASE WHEN starts_with(h, '/') THEN regexp_extract(url, '^(https?://[^/?#]+)', 1) || h ELSE h END AS href, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host
FROM (SELECT page_id, url, link_no, trim(regexp_extract(a, '(?is)href="([^"]*)"', 1)) AS h, {NORM_SQL.format(c=_unesc("regexp_replace(a, '(?s)<[^>]*>', ' ', 'g')"))} AS link_text
  FROM (SELECT page_id, url, unnest(l) AS a, generate_subscripts(l, 1) AS link_no FROM (SELECT page_id, url, regexp_extract_all(html, '(?is)(<a\\s[^>]*href="[^"]*"[^>]*>.*?</a>)', 1) AS l FROM pages)))
WHERE length(link_text) >= 3 AND {contains_any('lower(link_text)', _LINK_WORDS)}""")
def _(spark, sf):
    return D.extract_links(V.table(spark, sf, "pages"), "html", "url", _LINK_WORDS, min_len=3)


@query("r8_url_norm", """
SELECT page_id, lower(regexp_replace(base || CASE WHEN q <> '' THEN '?' || q ELSE '' END, '/$', '')) AS norm_url
FROM (SELECT page_id, regexp_extract(u, '^([^?]*)', 1) AS base, array_to_string(list_filter(string_split(regexp_extract(u, '\\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT starts_with(lower(p), 'utm_')), '&') AS q
  FROM (SELECT page_id, regexp_replace(trim(url), '#.*$', '') AS u FROM pages))""")
def _(spark, sf):
    """Plain and redirect-wrapped links must normalise alike; the wrapped form is fed in."""
    p = V.table(spark, sf, "pages")
    wrapped = F.concat(F.lit("https://www.google.com/url?sa=t&url="), F.url_encode("url"), F.lit("&usg=1"))
    fed = F.when(F.col("page_id") % 2 == 0, wrapped).otherwise(F.col("url"))
    return p.select("page_id", X.normalize_url(fed).alias("norm_url"))


@query("r9_clean_text", f"SELECT doc_id, md5({CLEAN_SQL.format(c='t')}) AS clean_md5, length({CLEAN_SQL.format(c='t')}) AS n FROM (SELECT doc_id, '  ' || chr(1) || replace(text, ' ', chr(160) || ' ') || chr(10) AS t FROM documents)")
def _(spark, sf):
    dirty = F.concat(F.lit("  \u0001"), F.replace(F.col("text"), F.lit(" "), F.lit("  ")), F.lit("\n"))
    c = X.clean_text(dirty)
    return V.table(spark, sf, "documents").select("doc_id", F.md5(c).alias("clean_md5"), F.length(c).cast("bigint").alias("n"))


@query("r10_date_parse", "SELECT kind, d, count(*) AS n FROM (SELECT o_orderkey % 6 AS kind, CASE WHEN o_orderkey % 6 = 5 THEN '2024-06-30' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS d FROM orders) GROUP BY ALL")
def _(spark, sf):
    o, k, d = V.table(spark, sf, "orders"), F.col("o_orderkey") % 6, F.col("o_orderdate")
    fmt = lambda f: F.date_format(d, f)
    cell = (F.when(k == 0, fmt("yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 1, fmt("dd MMM yyyy")).when(k == 2, fmt("MMM dd, yyyy")).when(k == 3, fmt("dd/MM/yyyy"))
            .when(k == 4, F.concat(fmt("EEE, dd MMM yyyy"), F.lit(" 10:00:00 GMT"))).otherwise("soon"))
    return o.select(k.alias("kind"), X.parse_date(cell, "2024-06-30").alias("d")).groupBy("kind", "d").agg(F.count("*").alias("n"))


_NURL = "lower('https://' || source || '.example.com/' || lang || '/' || (doc_id % 700) || '?id=' || (doc_id % 350))"
_NT, _NS = f"lower({NORM_SQL.format(c='title')})", f"lower({NORM_SQL.format(c='summary')})"


@query("r11_hash_keys", f"""
SELECT doc_id, sha1({_NURL} || '|' || {_NT}) AS uid, sha1({_NT} || '|' || substr({_NS}, 1, 140) || '|' || published_date) AS signature,
  'promise_' || substr(sha1(source || '|' || lang || '|' || substr(content, 1, 500)), 1, 12) AS promise_id, sha1(content) AS content_sha FROM news""")
def _(spark, sf):
    n = V.news(spark, sf)
    pid = F.concat(F.lit("promise_"), F.substring(F.sha1(F.concat_ws("|", "source", "lang", F.substring("content", 1, 500))), 1, 12))
    return n.select("doc_id", X.item_key(F.col("url"), F.col("title")).alias("uid"), X.content_signature(F.col("title"), F.col("summary"), F.col("published_date")).alias("signature"),
                    pid.alias("promise_id"), F.sha1("content").alias("content_sha"))


@query("r12_summary", f"SELECT doc_id, CASE WHEN t = '' THEN 'No summary available from source payload.' WHEN length(t) <= 280 THEN t ELSE rtrim(substr(t, 1, 277)) || '...' END AS summary FROM (SELECT doc_id, {NORM_SQL.format(c='text')} AS t FROM documents)")
def _(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", X.short_summary(F.col("text")).alias("summary"))


@query("r13_citation", "SELECT claim_id, '[' || source_document || ' | ' || coalesce(source_timestamp, 'p.' || source_page) || ' | ' || statement_quarter || ']' AS citation FROM claims")
def _(spark, sf):
    from ..plans.scoring import citation

    page = F.coalesce(F.col("source_timestamp"), F.concat(F.lit("p."), F.col("source_page").cast("string")))
    return V.claims(spark, sf).select("claim_id", citation(F.col("source_document"), page, F.col("statement_quarter")).alias("citation"))


@query("r14_parse_citation", """
SELECT claim_id, CASE k WHEN 0 THEN fy || '.pdf' WHEN 1 THEN fy || '_Aug.json' WHEN 2 THEN fy || '.pdf' WHEN 3 THEN 'Q2 FY' || yy || ' Earnings Call' WHEN 4 THEN 'Sep_' || (fy - 1) || '.pdf' WHEN 5 THEN 'balance_sheet.csv' WHEN 6 THEN 'Dec_' || fy || '.pdf' ELSE fy || '_Sep_25.pdf' END AS document,
  CASE WHEN k IN (0, 2, 6) THEN source_page END AS page,
  CASE k WHEN 0 THEN 'annual_report' WHEN 1 THEN 'transcript' WHEN 2 THEN 'annual_label' WHEN 3 THEN 'call_label' WHEN 4 THEN 'quarterly_label' WHEN 5 THEN 'statement_csv' WHEN 6 THEN 'quarterly_report' ELSE 'filing' END AS kind
FROM (SELECT claim_id, fy, source_page, lpad(CAST(fy % 100 AS VARCHAR), 2, '0') AS yy, (skey + fy + source_page) % 8 AS k FROM claims)""")
def _(spark, sf):
    c = V.claims(spark, sf)
    k = (F.col("skey") + F.col("fy") + F.col("source_page")) % 8
    fy, yy, pg = F.col("fy").cast("string"), F.lpad((F.col("fy") % 100).cast("string"), 2, "0"), F.col("source_page").cast("string")
    s = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in p])
    ref = (F.when(k == 0, s("[", fy, ".pdf | p.", pg, " | FY", yy, "]")).when(k == 1, s("[", fy, "_Aug.json | 12:41 | Q1 FY", yy, "]")).when(k == 2, s("AR FY", yy, " | Page ", pg))
           .when(k == 3, s("Q2 FY", yy, " Earnings Call")).when(k == 4, s("Quarterly results Q2 FY", yy)).when(k == 5, s("balance_sheet export")).when(k == 6, s("[Dec_", fy, ".pdf | p.", pg, " | Q3]"))
           .otherwise(s("[", fy, "_Sep_25.pdf | x | FY]")))
    return c.select("claim_id", parse_citation(ref).alias("c")).select("claim_id", "c.*")


@query("r18_snippet", f"""
SELECT doc_id, array_to_string(s, ' ') AS snippet, array_to_string(list_filter(s, lambda w: NOT list_contains([{', '.join(repr(s) for s in STOP)}], lower(w)) AND length(w) > 3), ' ') AS informative
FROM (SELECT doc_id, list_slice(w, greatest(coalesce(list_position(list_transform(w, lambda x: NOT list_contains([{', '.join(repr(s) for s in STOP)}], lower(x))), true), 1), 1), greatest(coalesce(list_position(list_transform(w, lambda x: NOT list_contains([{', '.join(repr(s) for s in STOP)}], lower(x))), true), 1), 1) + 9) AS s
  FROM (SELECT doc_id, list_filter(string_split({NORM_SQL.format(c='text')}, ' '), lambda x: x <> '') AS w FROM documents))""")
def _(spark, sf):
    a, b = X.first_words_snippet(F.col("text"), STOP)
    return V.table(spark, sf, "documents").select("doc_id", a.alias("snippet"), b.alias("informative"))


@query("t1_useful", f"SELECT doc_id, page_number, paragraph_no, {USEFUL_SQL.format(c='line')} AS useful FROM paras")
def _(spark, sf):
    p = paged(spark, sf).select("doc_id", F.inline("pages")).select("doc_id", "page_number", F.posexplode("paragraphs").alias("paragraph_no", "line"))
    return p.select("doc_id", "page_number", "paragraph_no", T.is_useful(F.col("line")).alias("useful"))


_LINES = "list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x)), lambda x: x <> '')"


@query("t2_tablelike", f"""
SELECT doc_id, len({_LINES}) > 2 AND len(list_filter({_LINES}, lambda x: length(regexp_replace(x, '[^0-9.,%\\-₹() ]', '', 'g')) / length(x) > 0.7 AND length(x) < 100)) / greatest(len({_LINES}), 1) > 0.6 AS table_like,
  {WORDS_SQL.format(c='t')} >= 8 AND NOT regexp_matches(lower(t), '^(confidential|disclaimer|page \\d+|©)') AS meaningful, length(trim(regexp_replace(trim(regexp_replace(t, '\\s+', ' ', 'g')), 'Page\\s+\\d+\\s+of\\s+\\d+', '', 'g'))) AS clean_n
FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN regexp_replace(text, '[a-z]', '7', 'g') ELSE 'Page 1 of 9 ' || text END AS t FROM documents)""")
def _(spark, sf):
    """Every third text has its letters turned to digits, so that tables occur."""
    t = F.when(F.col("doc_id") % 3 == 0, F.regexp_replace("text", "[a-z]", "7")).otherwise(F.concat(F.lit("Page 1 of 9 "), "text"))
    d = V.table(spark, sf, "documents").select("doc_id", t.alias("t"))
    c = F.col("t")
    return d.select("doc_id", T.is_table_like(c).alias("table_like"), T.is_meaningful(c).alias("meaningful"), F.length(T.clean_paragraph(c)).cast("bigint").alias("clean_n"))


_STRIPPED = "regexp_replace(text, '^\\s+|\\s+$', '', 'g')"
view("chunks", f"""
SELECT 'C' || (doc_id % 200) AS company_id, doc_id, source, lang, CAST(s AS INT) AS chunk_start, CAST(s // 2600 AS INT) AS chunk_index, substr(t, s + 1, 3000) AS chunk_text
FROM (SELECT doc_id, source, lang, t, unnest(generate_series(0, length(t) - 1, 2600)) AS s FROM (SELECT doc_id, source, lang, {_STRIPPED} AS t FROM documents) WHERE t <> '')
WHERE regexp_matches(substr(t, s + 1, 3000), '\\S')""")


def chunks(spark, sf):
    d = V.table(spark, sf, "documents").select(F.concat(F.lit("C"), F.col("doc_id") % 200).alias("company_id"), "doc_id", "source", "lang", "text")
    return T.chunk(d, "text").drop("text")


@query("t3_chunk", "SELECT doc_id, chunk_index, chunk_start, md5(chunk_text) AS chunk_md5 FROM chunks")
def _(spark, sf):
    return chunks(spark, sf).select("doc_id", "chunk_index", "chunk_start", F.md5("chunk_text").alias("chunk_md5"))


@query("t3_document_index", """
WITH pieces AS (SELECT doc_id, page_number, CAST(s / 160 AS INT) AS chunk_index, substr(t, s + 1, 200) AS chunk_text FROM (
  SELECT doc_id, page_number, t, unnest(generate_series(0, greatest(length(t) - 1, 0), 160)) AS s FROM (SELECT doc_id, page_number, regexp_replace(page_text, '^\\s+|\\s+$', '', 'g') AS t FROM doc_pages) WHERE t <> '') WHERE regexp_matches(substr(t, s + 1, 200), '\\S'))
SELECT doc_id, page_number, chunk_index, row_number() OVER (PARTITION BY doc_id ORDER BY page_number, chunk_index) - 1 AS document_index, md5(chunk_text) AS chunk_md5 FROM pieces""")
def _(spark, sf):
    """Pages cut into pieces that are numbered through each document."""
    c = T.document_index(T.chunk(doc_pages(spark, sf), "page_text", 200, 40), ["doc_id"], ["page_number", "chunk_index"], "document_index")
    return c.select("doc_id", "page_number", "chunk_index", "document_index", F.md5("chunk_text").alias("chunk_md5"))


@query("t4_pack", """
WITH seq AS (SELECT doc_id, page_number, length(page_text) + 1 AS n FROM doc_pages),
walk(doc_id, page_number, room, pack) AS (
  SELECT doc_id, page_number, n, 0 FROM seq WHERE page_number = 1
  UNION ALL SELECT s.doc_id, s.page_number, CASE WHEN w.room + s.n > 3000 THEN s.n ELSE w.room + s.n END, CASE WHEN w.room + s.n > 3000 THEN w.pack + 1 ELSE w.pack END
  FROM walk w JOIN seq s ON s.doc_id = w.doc_id AND s.page_number = w.page_number + 1)
SELECT w.doc_id, CAST(pack AS BIGINT) AS pack, count(*) AS n_pages, min(w.page_number) AS first_page, max(w.page_number) AS last_page, md5(string_agg(p.page_text, chr(10) ORDER BY w.page_number)) AS pack_md5
FROM walk w JOIN doc_pages p USING (doc_id, page_number) GROUP BY 1, 2""")
def _(spark, sf):
    p = T.pack_pages(doc_pages(spark, sf), "doc_id", "page_number", "page_text", 3000)
    return p.select("doc_id", "pack", "n_pages", "first_page", "last_page", F.md5("pack_text").alias("pack_md5"))


# RE2 has no look-ahead: two marks before each run of blanks leave one for an opener that follows another.
_SENT = f"""
SELECT doc_id, trim(s2) AS sentence FROM (
  SELECT doc_id, unnest(CASE WHEN length(s) <= 1200 THEN [s] ELSE string_split(replace(regexp_replace(regexp_replace(s, '(\\s+)', chr(2) || chr(2) || '\\1', 'g'), '\\x02\\s+((?:We|The\\x02\\x02 company|This|Our|At|By)(?:[^\\p{{L}}\\p{{N}}_]|$))', chr(1) || '\\1', 'g'), chr(2), ''), chr(1)) END) AS s2 FROM (
    SELECT doc_id, trim(unnest(string_split(regexp_replace({CLEAN_SQL.format(c='text')}, '([.!?])\\s+([A-Z0-9"''(\\-])', '\\1' || chr(1) || '\\2', 'g'), chr(1)))) AS s FROM documents))
WHERE {WORDS_SQL.format(c='s2')} >= 8"""


@query("t5_sentences", f"SELECT doc_id, md5(sentence) AS sentence_md5, count(*) AS n FROM ({_SENT}) GROUP BY ALL")
def _(spark, sf):
    s = T.sentences(V.table(spark, sf, "documents").select("doc_id", "text"))
    return s.groupBy("doc_id", F.md5("sentence").alias("sentence_md5")).agg(F.count("*").alias("n"))


_SPEAKERS = ["Asha Rao (MD & CEO)", "Ben Okoro (Analyst)", "Moderator", "Carla Diaz – CFO", "Dev Shah", "Elif Kaya from Alpha Securities", "Management", "Unknown"]


def _speaker(k):
    return V._pick(_SPEAKERS, k % 8)


_SPK_SQL = "([" + ", ".join(f"'{s}'" for s in _SPEAKERS) + "])[({k}) % 8 + 1]"


@query("t6_speaker_blocks", f"""
SELECT conv_id, count(*) AS n_blocks, string_agg(DISTINCT name, ',' ORDER BY name) AS speakers, count(*) FILTER (WHERE name IN ('Asha Rao')) AS n_management, sum(n)::BIGINT AS chars FROM (
  SELECT conv_id, turn, ['Asha Rao', 'Ben Okoro', 'Moderator'][(turn % 3 + 1)::INT] AS name, length(regexp_replace('[00:' || lpad(CAST(turn % 60 AS VARCHAR), 2, '0') || '] ' || replace(text, chr(10), ' '), '^\\s+|\\s+$', '', 'g')) AS n FROM conversations) GROUP BY 1""")
def _(spark, sf):
    """Conversations written out as one transcript each, then cut into speaker turns."""
    c = V.table(spark, sf, "conversations")
    head = V._pick(["Asha Rao (MD & CEO)", "Ben Okoro (Analyst)", "Moderator"], F.col("turn") % 3)
    line = F.concat(head, F.lit(": [00:"), F.lpad((F.col("turn") % 60).cast("string"), 2, "0"), F.lit("] "), F.replace(F.col("text"), F.lit("\n"), F.lit(" ")))
    full = c.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]), "\n").alias("text"))
    b = T.speaker_blocks(full)
    return b.groupBy("conv_id").agg(
        F.count("*").alias("n_blocks"), F.array_join(F.array_sort(F.collect_set("speaker_name")), ",").alias("speakers"),
        F.count_if("is_management").alias("n_management"), F.sum(F.length("block_text")).alias("chars"))


@query("t7_mgmt", f"""
SELECT speaker, role, count(*) AS n, bool_or(speaker IN ('Asha Rao (MD & CEO)', 'Carla Diaz – CFO')) AS by_title, bool_or(speaker IN ('Asha Rao (MD & CEO)', 'Carla Diaz – CFO', 'Dev Shah', 'Management', 'Unknown')) AS by_registry,
  bool_or(speaker NOT IN ('Moderator', 'Ben Okoro (Analyst)', 'Unknown')) AS by_promise
FROM (SELECT role, {_SPK_SQL.format(k='conv_id + turn')} AS speaker FROM conversations) GROUP BY 1, 2""")
def _(spark, sf):
    g = V.table(spark, sf, "conversations").groupBy(_speaker(F.col("conv_id") + F.col("turn")).alias("speaker"), "role").agg(F.count("*").alias("n"))
    s = F.col("speaker")
    return g.select("speaker", "role", "n", T.is_management(s).alias("by_title"), T.is_management(s, "registry").alias("by_registry"), T.is_management(s, "promise").alias("by_promise"))


def _tag_sql(col, dicts, sep=":"):
    parts = []
    for kind, names in dicts.items():
        for name, words in names.items():
            case = "CASE " + " ".join(f"WHEN contains({col}, '{w}') THEN '{kind}{sep}{name}{sep}{w}'" for w in words) + " END"
            parts.append(case)
    return f"list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL)"


@query("t8_tag", f"SELECT doc_id, array_to_string({_tag_sql('lower(text)', TOPICS)}, ',') AS tags FROM documents")
def _(spark, sf):
    d = V.table(spark, sf, "documents")
    tags = T.tag_array(F.lower("text"), TOPICS)
    return d.select("doc_id", F.array_join(F.transform(tags, lambda t: F.concat_ws(":", t["type"], t["name"], t["keyword"])), ",").alias("tags"))


def _gs_sql(col, groups):
    cells = ", ".join(f"{{'neg': -{contains_sum(col, ws)}, 'ord': {i}, 'name': '{g}'}}" for i, (g, ws) in enumerate(groups.items()))
    return f"list_sort(list_filter([{cells}], lambda s: s.neg < 0))"


@query("t10_score_groups", f"SELECT doc_id, array_to_string(list_transform({_gs_sql('lower(text)', GROUPS)}, lambda s: s.name || '=' || (-s.neg)), ',') AS dims FROM documents")
def _(spark, sf):
    s = T.group_scores(F.lower("text"), GROUPS)
    return V.table(spark, sf, "documents").select("doc_id", F.array_join(F.transform(s, lambda x: F.concat_ws("=", x["name"], x["score"].cast("string"))), ",").alias("dims"))


@query("t11_high_signal", f"SELECT doc_id, chunk_index, {contains_sum('lower(chunk_text)', SKIP)} < 3 AND {contains_any('lower(chunk_text)', SIGNAL)} AS high_signal FROM chunks")
def _(spark, sf):
    return chunks(spark, sf).select("doc_id", "chunk_index", T.is_high_signal(F.lower("chunk_text"), SKIP, SIGNAL).alias("high_signal"))


_SECTIONS = ["the ", "der ", "le "]
view("toc", "SELECT doc_id, s.name AS section, CAST(s.start + doc_id % 2 AS INT) AS start_page FROM documents, (VALUES ('chairman message', 1), ('management discussion', 3), ('notes', 6)) s(name, start)")


@query("t12_section", f"""
SELECT p.doc_id, p.page_number, coalesce(p.heading, t.section) AS section, CASE WHEN p.heading IS NOT NULL THEN 'heading' WHEN t.section IS NOT NULL THEN 'toc' ELSE 'none' END AS rule
FROM (SELECT doc_id, page_number, CASE {' '.join(f"WHEN regexp_matches(lower(page_text), '(^|\\n)\\s*{s}') THEN '{s}'" for s in _SECTIONS)} END AS heading FROM doc_pages) p
ASOF LEFT JOIN toc t ON t.doc_id = p.doc_id AND t.start_page <= p.page_number""")
def _(spark, sf):
    """Heading at a line start, else the latest table-of-contents entry at or before the page."""
    d = V.table(spark, sf, "documents").select("doc_id")
    entry = F.array(*[F.struct(F.lit(n).alias("section"), (F.lit(s) + F.col("doc_id") % 2).cast("int").alias("start_page")) for n, s in (("chairman message", 1), ("management discussion", 3), ("notes", 6))])
    toc = d.select("doc_id", F.inline(entry))
    p = doc_pages(spark, sf).select("doc_id", "page_number", T.heading_section(F.col("page_text"), _SECTIONS).alias("heading"))
    j = J.asof_backward(p, toc, ["doc_id"], "page_number", "start_page", ["section"])
    rule = F.when(F.col("heading").isNotNull(), "heading").when(F.col("asof_section").isNotNull(), "toc").otherwise("none")
    return j.select("doc_id", "page_number", F.coalesce("heading", "asof_section").alias("section"), rule.alias("rule"))


@query("j6_interval", """
SELECT c.doc_id, c.chunk_index, c.chunk_start, p.page_number AS page FROM chunks c LEFT JOIN (
  SELECT doc_id, page_number, sum(n) OVER (PARTITION BY doc_id ORDER BY page_number) - n AS start, sum(n) OVER (PARTITION BY doc_id ORDER BY page_number) AS stop FROM (SELECT doc_id, page_number, length(page_text) + 1 AS n FROM doc_pages)) p
ON p.doc_id = c.doc_id AND c.chunk_start >= p.start AND c.chunk_start < p.stop""")
def _(spark, sf):
    """Chunk offsets to pages through running page lengths and fixed-width cells."""
    from pyspark.sql import Window

    pg = doc_pages(spark, sf).select("doc_id", "page_number", (F.length("page_text") + 1).alias("n"))
    w = Window.partitionBy("doc_id").orderBy("page_number")
    spans = pg.select("doc_id", F.col("page_number").alias("page"), (F.sum("n").over(w) - F.col("n")).alias("lo"), F.sum("n").over(w).alias("hi"))
    pts = chunks(spark, sf).select("doc_id", "chunk_index", "chunk_start")
    return J.interval_lookup(pts, spans, ["doc_id"], "chunk_start", "lo", "hi", "page", 1000)


@query("j12_snapshot_diff", """
SELECT c.url, p.h AS prev_hash, c.h AS cur_hash FROM (SELECT url, max(sha1(full_text)) AS h FROM page_texts GROUP BY 1) c JOIN (SELECT url, max(sha1(CASE WHEN page_id % 3 = 0 THEN 'old ' || full_text ELSE full_text END)) AS h FROM page_texts WHERE page_id % 10 <> 9 GROUP BY 1) p USING (url) WHERE p.h <> c.h""")
def _(spark, sf):
    """Pages whose text hash differs from the earlier snapshot; first sightings stay silent."""
    t = V.table(spark, sf, "pages").select("page_id", "url", D.visible_text(F.col("html"), None).alias("t"))
    old = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("old "), "t")).otherwise(F.col("t"))
    prev = t.filter("page_id % 10 <> 9").groupBy("url").agg(F.max(F.sha1(old)).alias("h"))
    return J.snapshot_diff(prev, t.groupBy("url").agg(F.max(F.sha1("t")).alias("h")), "url", "h")[0]


@query("t20_detect_company", f"SELECT doc_id, array_to_string(list_filter([{', '.join(f'''CASE WHEN {contains_any('lower(text)', ws)} THEN '{c}' END''' for c, ws in ALIASES.items())}], lambda x: x IS NOT NULL), ',') AS companies, CASE {' '.join(f'''WHEN {contains_any('lower(text)', ws)} THEN '{c}' ''' for c, ws in ALIASES.items())} END AS first_company FROM documents")
def _(spark, sf):
    t = F.lower("text")
    return V.table(spark, sf, "documents").select("doc_id", F.array_join(T.detect(t, ALIASES), ",").alias("companies"), T.detect(t, ALIASES, "first").alias("first_company"))


_NAME_ALIASES = {"small ring": "RING_S", "widget": "WIDGET", "gear": "GEAR", "blue": "BLUE"}


@query("t21_alias", f"""
SELECT name, CASE {' '.join(f"WHEN k = '{a}' THEN '{v}'" for a, v in _NAME_ALIASES.items())} {' '.join(f"WHEN contains('{a}', k) OR contains(k, '{a}') THEN '{v}'" for a, v in _NAME_ALIASES.items())} ELSE name END AS resolved, n
FROM (SELECT p_name AS name, replace(lower(trim(p_name)), '-', '_') AS k, count(*) AS n FROM part GROUP BY ALL)""")
def _(spark, sf):
    from ..operators.matching import resolve_alias

    g = V.table(spark, sf, "part").groupBy(F.col("p_name").alias("name")).agg(F.count("*").alias("n"))
    return g.select("name", resolve_alias(F.col("name"), _NAME_ALIASES).alias("resolved"), "n")


_WS = "list_filter(string_split_regex(lower(coalesce({c}, '')), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: w <> '')"


def _phrase_sql(c, n=None):
    """A text as its words, or its first ``n``."""
    return f"array_to_string({_WS.format(c=c)}{f'[1:{n}]' if n else ''}, ' ')"


view("text_words", f"SELECT doc_id, {_WS.format(c='text')} AS ws FROM documents")
view("text_groups", "SELECT doc_id, array_to_string(ws[i:i + n - 1], ' ') AS phrase FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM text_words, (SELECT unnest([1, 2, 3]) AS n))")
view("phrase_table", f"""
SELECT 'passage' AS type, 'item_' || (item_id % 40) AS name, {_phrase_sql('text', 3)} AS keyword, item_id AS ord FROM benchmark
UNION ALL SELECT 'opening', 'item_' || (item_id % 40), {_phrase_sql('text', 2)}, item_id FROM benchmark
UNION ALL SELECT 'part', p_name, p_name, p_partkey FROM part UNION ALL SELECT 'word', 'w_' || (item_id % 7), {_phrase_sql('text', 1)}, item_id FROM benchmark""")


def phrase_table(spark, sf):
    """A dictionary read from tables: beginnings of the benchmark's passages, names of parts."""
    b = V.table(spark, sf, "benchmark")
    start = lambda n: F.array_join(F.slice(D2.words(F.col("text")), 1, n), " ")
    rows = lambda kind, name, n: b.select(F.lit(kind).alias("type"), name.alias("name"), start(n).alias("keyword"), F.col("item_id").alias("ord"))
    item = F.concat(F.lit("item_"), (F.col("item_id") % 40).cast("string"))
    part = V.table(spark, sf, "part").select(F.lit("part").alias("type"), F.col("p_name").alias("name"), F.col("p_name").alias("keyword"), F.col("p_partkey").alias("ord"))
    return rows("passage", item, 3).unionByName(rows("opening", item, 2)).unionByName(part).unionByName(rows("word", F.concat(F.lit("w_"), (F.col("item_id") % 7).cast("string")), 1))


@query("t8_tag_table", """
SELECT g.doc_id, p.type, p.name, arg_min(p.keyword, {'ord': p.ord, 'keyword': p.keyword}) AS keyword, sum(g.hits)::BIGINT AS hits
FROM (SELECT doc_id, phrase, count(*) AS hits FROM text_groups GROUP BY 1, 2) g JOIN phrase_table p ON p.keyword = g.phrase GROUP BY 1, 2, 3""")
def _(spark, sf):
    """Tags of every document from a dictionary that is a table."""
    return D2.tag_by_table(V.table(spark, sf, "documents"), "doc_id", "text", phrase_table(spark, sf))


@query("t20_detect_table", """
WITH f AS (SELECT g.doc_id, p.name AS code, min(p.ord) AS ord FROM (SELECT DISTINCT doc_id, phrase FROM text_groups) g JOIN phrase_table p ON p.keyword = g.phrase WHERE p.type IN ('passage', 'part') GROUP BY 1, 2)
SELECT d.doc_id, coalesce(string_agg(f.code, ',' ORDER BY f.ord, f.code), '') AS codes, arg_min(f.code, {'ord': f.ord, 'code': f.code}) AS first_code FROM documents d LEFT JOIN f ON f.doc_id = d.doc_id GROUP BY 1""")
def _(spark, sf):
    """Codes whose aliases stand in a document, all and first."""
    a = phrase_table(spark, sf).where("type in ('passage', 'part')").select(F.col("name").alias("code"), F.col("keyword").alias("alias"), "ord")
    d = D2.detect_by_table(V.table(spark, sf, "documents"), "doc_id", "text", a)
    return d.select("doc_id", F.array_join("codes", ",").alias("codes"), "first_code")


view("part_aliases", f"""
SELECT {_phrase_sql('p_name')} AS alias, 'P' || min(p_partkey) AS code, min(p_partkey) AS ord FROM part WHERE p_size <= 2 GROUP BY 1
UNION ALL SELECT split_part(p_name, ' ', 2), 'K_' || split_part(p_name, ' ', 2), 100000 + min(p_partkey) FROM part WHERE p_size BETWEEN 3 AND 5 AND p_name <> '' GROUP BY 1, 2
UNION ALL SELECT p_name || ' ' || lower(p_type), 'T' || min(p_partkey), 200000 + min(p_partkey) FROM part WHERE p_size >= 45 GROUP BY 1""")


@query("t21_alias_table", """
WITH n AS (SELECT p_name AS name, count(*) AS n FROM part GROUP BY 1 UNION ALL SELECT 'no ' || p_brand, count(*) FROM part GROUP BY 1),
k AS (SELECT name, n, """ + _phrase_sql("name") + """ AS key FROM n), a AS (SELECT *, """ + _phrase_sql("alias") + """ AS akey FROM part_aliases),
m AS (SELECT k.name, a.code, a.ord, CASE WHEN a.akey = k.key THEN 1 ELSE 2 END AS tier FROM k JOIN a ON contains(' ' || k.key || ' ', ' ' || a.akey || ' ') OR contains(' ' || a.akey || ' ', ' ' || k.key || ' ') WHERE a.akey <> '' AND k.key <> '')
SELECT k.name, k.n, coalesce(arg_min(m.code, {'tier': m.tier, 'ord': m.ord, 'code': m.code}), k.name) AS resolved FROM k LEFT JOIN m ON m.name = k.name GROUP BY k.name, k.n""")
def _(spark, sf):
    """Names of parts and brands resolved through an alias table made of parts."""
    p = V.table(spark, sf, "part")
    kind = F.split_part("p_name", F.lit(" "), F.lit(2))
    alias = lambda rows, key, tag, base: rows.groupBy(key.alias("alias")).agg(F.min("p_partkey").alias("k")).select("alias", tag.alias("code"), (F.col("k") + base).alias("ord"))
    a = alias(p.where("p_size <= 2"), D2.phrase(F.col("p_name")), F.concat(F.lit("P"), F.col("k").cast("string")), 0)
    a = a.unionByName(alias(p.where("p_size between 3 and 5 and p_name <> ''"), kind, F.concat(F.lit("K_"), "alias"), 100000))
    a = a.unionByName(alias(p.where("p_size >= 45"), F.concat("p_name", F.lit(" "), F.lower("p_type")), F.concat(F.lit("T"), F.col("k").cast("string")), 200000))
    names = p.groupBy(F.col("p_name").alias("name")).agg(F.count("*").alias("n")).unionByName(p.groupBy(F.concat(F.lit("no "), "p_brand").alias("name")).agg(F.count("*").alias("n")))
    return D2.resolve_by_table(names, "name", a)


_METRIC_NAMES = ["Red Widget", "small ring +", "Large Gear %", "green_bolt", "Blue-Panel Growth", "ring"]


def _tokens_sql(x):
    return f"list_distinct(list_filter(string_split(replace(replace(replace(replace(lower({x}), '_', ' '), '-', ' '), '+', ''), '%', ''), ' '), lambda w: w <> ''))"


@query("t22_fuzzy_match", f"""
WITH q AS (SELECT DISTINCT p_name AS q FROM part), m AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{n}')" for i, n in enumerate(_METRIC_NAMES))}) t(ord, name)),
s AS (SELECT q, name, ord, CASE WHEN lower(name) = lower(trim(q)) THEN 3 WHEN contains(lower(name), lower(trim(q))) OR contains(lower(trim(q)), lower(name)) THEN 2 WHEN shared > 0 THEN 1 ELSE 0 END AS tier, shared
  FROM (SELECT q, name, ord, len(list_intersect(list_distinct(list_filter(string_split(replace(replace(lower(trim(q)), '_', ' '), '-', ' '), ' '), lambda w: w <> '')), {_tokens_sql('name')})) AS shared FROM q, m))
SELECT q AS query, b.name AS matched, CAST(b.tier AS INT) AS tier FROM (SELECT q, max_by({{'name': name, 'tier': tier}}, tier * 10000 + CASE WHEN tier = 1 THEN shared ELSE 0 END * 100 - ord) AS b FROM s GROUP BY 1) WHERE b.tier > 0""")
def _(spark, sf):
    from ..operators.matching import fuzzy_match

    q = V.table(spark, sf, "part").select(F.col("p_name").alias("query")).distinct()
    return fuzzy_match(q, "query", _METRIC_NAMES).filter("matched is not null").select("query", "matched", "tier")


_HEDGE, _COMMIT = ["may ", "que ", "ou ", "und "], ["will ", "the ", "der ", "les "]


@query("t23_tone", f"""
SELECT conv_id AS company, quarter, sum(h)::BIGINT AS hedging, sum(c)::BIGINT AS commitment, count(*) FILTER (WHERE c > h) AS hard_turns, 100.0::DOUBLE * sum(c) / nullif(sum(h) + sum(c), 0) AS hard_share
FROM (SELECT conv_id % 50 AS conv_id, 'Q' || (turn % 4 + 1) AS quarter, {contains_sum('lower(text)', _HEDGE)} AS h, {contains_sum('lower(text)', _COMMIT)} AS c FROM conversations) GROUP BY 1, 2""", rounds="hard_share")
def _(spark, sf):
    t = F.lower("text")
    c = V.table(spark, sf, "conversations").select((F.col("conv_id") % 50).alias("company"), F.concat(F.lit("Q"), F.col("turn") % 4 + 1).alias("quarter"), T.hits(t, _HEDGE).alias("h"), T.hits(t, _COMMIT).alias("c"))
    total = F.sum(F.col("h") + F.col("c"))
    return c.groupBy("company", "quarter").agg(F.sum("h").alias("hedging"), F.sum("c").alias("commitment"), F.count_if(F.col("c") > F.col("h")).alias("hard_turns"),
        F.when(total > 0, 100.0 * F.sum("c") / total).alias("hard_share"))
