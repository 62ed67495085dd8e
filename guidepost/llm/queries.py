"""Queries opN_<name> over the given tables, and SQL that states the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from guidepost.llm import bpe, centroid_clustering, chat, embedding_dedup, jaccard, mixing, ppm, quality_classifier, quality_rules, token_counts, toxicity, vector_codes, warc
from guidepost.llm.common import crc_mod, store, table
from guidepost.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def byte_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of every whole document, base rules, and limits from quantile sketches."""
    got = quality_rules.judge(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLES["op1_quality_rules"] = r"""
WITH base AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents
), wins AS (
  SELECT doc_id, i, array_to_string(ws[i:i+4], ' ') AS win
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM base WHERE len(ws) >= 5)
), often AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM wins) WHERE c > 1
), reps AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM often, (SELECT unnest(range(5)) AS k) GROUP BY doc_id
), facts AS (
  SELECT b.doc_id, lang, source, len(ws)::BIGINT AS n_words,
    coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM base b LEFT JOIN reps r ON r.doc_id = b.doc_id
), judged AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM facts
), measured AS (
  SELECT doc_id, lang, source, n_words, base_failed, m.measure, m.num, m.free, m.slack, m.habit,
    CASE WHEN n_words > 0 THEN 1000 * m.num // n_words END AS v
  FROM judged, LATERAL (VALUES ('symbols', n_symbols, 5, 20, 500), ('lines', n_dup_lines, 2, 10, 50), ('repeats', n_repeat_words, 20, 25, 50), ('chars', word_chars, 20, 250, 3000)) AS m(measure, num, free, slack, habit)
), sketch AS (
  SELECT lang, source, measure, slack, habit, (v >> greatest(length(bin(v)) - 6, 0)) << greatest(length(bin(v)) - 6, 0) AS b, count(*) AS n
  FROM measured WHERE NOT base_failed GROUP BY ALL
), levels AS (
  SELECT 1 AS level, lang, source, measure, slack, habit, b, n FROM sketch
  UNION ALL SELECT 2, lang, NULL, measure, slack, habit, b, sum(n) FROM sketch GROUP BY ALL
  UNION ALL SELECT 3, NULL, NULL, measure, slack, habit, b, sum(n) FROM sketch GROUP BY ALL
), ranked AS (
  SELECT *, sum(n) OVER (PARTITION BY level, lang, source, measure ORDER BY b) AS upto, sum(n) OVER (PARTITION BY level, lang, source, measure) AS total FROM levels
), q AS (
  SELECT level, lang, source, measure, slack, habit, max(total) AS rows,
    min(b) FILTER (10 * upto >= total) AS low, min(b) FILTER (10 * upto >= 5 * total) AS mid, min(b) FILTER (4 * upto >= 3 * total) AS upper, min(b) FILTER (10 * upto >= 9 * total) AS high
  FROM ranked GROUP BY ALL
), lim AS (
  SELECT a.lang, a.source, a.measure,
    CASE WHEN a.rows >= 200 THEN a.mid + 4 * (greatest(a.mid - a.low, least(a.upper - a.mid, a.habit)) + a.slack) WHEN l.rows >= 200 THEN l.mid + 4 * (greatest(l.mid - l.low, least(l.upper - l.mid, a.habit)) + l.slack) ELSE e.mid + 4 * (greatest(e.mid - e.low, least(e.upper - e.mid, a.habit)) + e.slack) END AS most,
    CASE WHEN a.rows >= 200 THEN a.mid - 4 * (a.high - a.mid + a.slack) WHEN l.rows >= 200 THEN l.mid - 4 * (l.high - l.mid + l.slack) ELSE e.mid - 4 * (e.high - e.mid + e.slack) END AS least
  FROM q a JOIN q l ON l.level = 2 AND l.lang IS NOT DISTINCT FROM a.lang AND l.measure = a.measure
  JOIN q e ON e.level = 3 AND e.measure = a.measure WHERE a.level = 1
), out AS (
  SELECT m.doc_id, bool_or(coalesce(1000 * (num - free) > most * n_words OR (m.measure = 'chars' AND 1000 * (num + free) < least * n_words), false)) AS outlier
  FROM measured m LEFT JOIN lim ON lim.lang IS NOT DISTINCT FROM m.lang AND lim.source IS NOT DISTINCT FROM m.source AND lim.measure = m.measure
  GROUP BY m.doc_id
)
SELECT j.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT o.outlier AS kept
FROM judged j JOIN out o ON o.doc_id = j.doc_id
"""


@query
def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document encoded with forced boundaries, and decoded again."""
    return bpe.digests(bpe.round_trip(table(spark, sf_dir, "documents"), byte_bpe_path()))


@query
def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one that holds the template's own marks, formatted and
    read back from the formatted text."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = r"\### Assistant: </turn> ok"
    marks = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"))
    done = chat.format_conversations(turns.unionByName(marks))
    back = done.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLES["op3_chat"] = r"""
WITH marks AS (
  SELECT -7 AS conv_id, 0 AS turn, 'user' AS role, '\### Assistant: </turn> ok' AS text
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM marks
), parts AS (
  SELECT *, role IS DISTINCT FROM lag(role) OVER w AS first_of_run,
    length(text) + length(regexp_replace(text, '\\|###|<turn/|</turn', 'x', 'g'))
      - length(regexp_replace(text, '\\|###|<turn/|</turn', '', 'g')) AS escaped_chars
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(escaped_chars + CASE WHEN first_of_run THEN length('### ' || role || ':') + 1 + length('</turn>') + 2 ELSE length('<turn/>') + 2 END)::BIGINT AS formatted_chars
FROM parts GROUP BY conv_id
"""


def _judged(scored: DataFrame, folds: int, held_fold: int, threshold: float = 0.3) -> DataFrame:
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), folds) == held_fold).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole document."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), "toxic", 4, 2)
    return _judged(toxicity.score(docs, model), 4, 2)


@query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole document."""
    docs = table(spark, sf_dir, "documents")
    model = quality_classifier.train(docs, table(spark, sf_dir, "labels"), "quality", 5, 0)
    return _judged(quality_classifier.score(docs, model), 5, 0)


@query
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to the target weights of their sources."""
    got = mixing.mix(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


@query
def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate vectors within a label, with links and components."""
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLES["op9_embedding_dedup"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
), ok AS (
  SELECT * FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
  SELECT a, b FROM pairs UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON p.a = r.b
)
SELECT v.vec_id, coalesce(l.n, 0)::BIGINT AS n_links, least(v.vec_id, coalesce(c.m, v.vec_id)) AS component_id,
  v.vec_id = least(v.vec_id, coalesce(c.m, v.vec_id)) AS kept
FROM v LEFT JOIN (SELECT a, count(*) AS n FROM pairs GROUP BY a) l ON l.a = v.vec_id
LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) c ON c.a = v.vec_id
"""


@query
def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under five-word shingles and similarity 0.75."""
    return jaccard.join_components(table(spark, sf_dir, "documents"))


ORACLES["op4_jaccard_join"] = r"""
WITH RECURSIVE base AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), sh AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, array_to_string(ws[i:i+4], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM base WHERE len(ws) >= 5)
    UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM base WHERE len(ws) BETWEEN 1 AND 4)
), sz AS (
  SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM common JOIN sz p ON p.doc_id = x JOIN sz q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)
), reach AS (
  SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y
)
SELECT b.doc_id, coalesce(sz.n, 0)::BIGINT AS n_shingles, least(b.doc_id, coalesce(m.y, b.doc_id)) AS component_id
FROM base b LEFT JOIN sz ON sz.doc_id = b.doc_id LEFT JOIN (SELECT x, min(y) AS y FROM reach GROUP BY x) m ON m.x = b.doc_id
"""


@query
def op6_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code length of every whole document under a byte trie, beside word unigrams."""
    return ppm.score(table(spark, sf_dir, "documents"))


@query
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every whole document before and after three edits of it: twelve
    bytes at a third of the text replaced by its first twenty, thirty bytes at two
    thirds deleted, the first twenty put to the end."""
    raw = F.col("text")
    n, head = F.octet_length(raw), F.substring(raw, 1, 20)
    edit = lambda seq, start, end, new: F.struct(F.lit(seq).alias("seq"), start.cast("int").alias("start"), end.cast("int").alias("end"), new.alias("new"))
    edits = F.array(edit(1, n / 3, n / 3 + 12, head), edit(2, n * 2 / 3, n * 2 / 3 + 30, F.lit(b"")), edit(3, n + 20, n + 20, head))
    kept = store(token_counts.build(table(spark, sf_dir, "documents"), byte_bpe_path()), scratch_path(spark, "trees"))
    got = token_counts.recount_inline(kept, byte_bpe_path(), edits)
    return got.select("doc_id", "n_before", "n_after", "n_bytes", "n_encoded", "n_built", F.sha2("text", 256).alias("edited_sha256"))


@query
def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records in ZIP archives and read back by ranges."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


ORACLES["op11_warc"] = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS b FROM pages
), f AS (
  SELECT page_id, octet_length(b) AS n, sha256(b) AS digest, min(page_id) OVER (PARTITION BY sha256(b)) AS first FROM p
), r AS (
  SELECT *, coalesce(n >= 100 AND first IS DISTINCT FROM page_id AND first IS NOT NULL, false) AS again FROM f
)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to
FROM r
"""


@query
def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors in sixteen clusters, found by Orchard's search."""
    return centroid_clustering.cluster(table(spark, sf_dir, "embeddings"))


def _whole_sql(scale: int, where: str, columns: str) -> str:
    """``kept``: usable rows with whole components ``x``, numbered by ``row``."""
    return f"""raw AS (
  SELECT {columns}, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
), fine AS (
  SELECT * FROM raw WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row, {columns}, list_transform(v, lambda x: floor(least(greatest({scale} * x, -33554432.0), 33554432.0))::BIGINT) AS x FROM fine {where}
)"""


def _rounds_sql(rounds: int, part: bool) -> str:
    """Assign and move in turn. ``px`` has (row, part, pos, x), ``c0`` (c, part, pos, x);
    ``part`` only where vectors are cut into parts."""
    key = "part, " if part else ""
    p, c = ("p.part, ", "c.part, ") if part else ("", "")
    both = lambda x, y: f" AND {x}.part = {y}.part" if part else ""
    out = []
    for r in range(rounds + 1):
        out.append(f"""d{r} AS (
  SELECT p.row, {p}c.c, sum((p.x - c.x) * (p.x - c.x)) AS d FROM px p JOIN c{r} c ON p.pos = c.pos{both('p', 'c')} GROUP BY ALL
), a{r} AS MATERIALIZED (
  SELECT row, {key}c, d FROM d{r} QUALIFY row_number() OVER (PARTITION BY {key}row ORDER BY d, c) = 1
)""")
        if r < rounds:
            out.append(f"""m{r} AS (
  SELECT a.c, {p}p.pos, sum(p.x) AS s, count(*) AS n FROM px p JOIN a{r} a ON a.row = p.row{both('a', 'p')} GROUP BY ALL
), c{r + 1} AS MATERIALIZED (
  SELECT c.c, {c}c.pos, coalesce((m.s - ((m.s % m.n) + m.n) % m.n) // m.n, c.x)::BIGINT AS x
  FROM c{r} c LEFT JOIN m{r} m ON m.c = c.c AND m.pos = c.pos{both('m', 'c')}
)""")
    return ",\n".join(out)


ORACLES["op12_centroids"] = f"""
WITH {_whole_sql(64, "WHERE len(v) = 64", "vec_id")}, start AS (
  SELECT row, row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, x) - 1 AS c FROM kept QUALIFY c < 16
), px AS MATERIALIZED (
  SELECT row, unnest(range(64)) AS pos, unnest(x) AS x FROM kept
), c0 AS MATERIALIZED (
  SELECT s.c, p.pos, p.x FROM start s JOIN px p ON p.row = s.row
), {_rounds_sql(3, False)}, sums AS (
  SELECT c, least(sum(d), 9223372036854775807)::BIGINT AS cluster_inertia, least(sum(sum(d)) OVER (), 9223372036854775807)::BIGINT AS inertia FROM a3 GROUP BY c
), digest AS (
  SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY pos)) AS centroid_sha256 FROM c3 GROUP BY c
)
SELECT k.vec_id, a.c::INT AS cluster, a.d::BIGINT AS distance, cluster_inertia, inertia, centroid_sha256
FROM kept k JOIN a3 a ON a.row = k.row JOIN sums USING (c) JOIN digest USING (c)
"""


@query
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight-part codes of all vectors, refined under adaptive distance bounds."""
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


ORACLES["op13_vector_codes"] = f"""
WITH {_whole_sql(4096, "WHERE len(v) = (SELECT len(v) FROM fine WHERE len(v) % 8 = 0 GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)", "vec_id, label")}, start AS (
  SELECT row, row_number() OVER (ORDER BY vec_id NULLS LAST, x) - 1 AS c FROM kept QUALIFY c < 16
), px AS MATERIALIZED (
  SELECT row, i * 8 // n AS part, i % (n // 8) AS pos, x FROM (SELECT row, len(x) AS n, unnest(range(len(x))) AS i, unnest(x) AS x FROM kept)
), c0 AS MATERIALIZED (
  SELECT s.c, p.part, p.pos, p.x FROM start s JOIN px p ON p.row = s.row
), {_rounds_sql(6, True)}, coded AS (
  SELECT row, string_agg(printf('%02x', c::INT), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a6 GROUP BY row
), digest AS (
  SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, c, pos)) AS codebooks_sha256 FROM c6
)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
FROM kept JOIN coded USING (row), digest
"""
