"""Promise mining and verification queries over statements written from the facts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import periods as P
from ..operators import promises as M
from ..operators import text as T
from ..operators.rows import computed_once
from ..session import cut_lineage
from . import views as V
from .q_text import CLEAN_SQL, WORDS_SQL, contains_any
from .registry import query, view

# Sentence forms; {a} {b} amounts with thousands commas, {p} {r} percents, {y} target label.
TEMPLATES = [
    "We expect revenue to reach Rs {a} crore in {y} on the back of strong demand across markets.",
    "The company is targeting EBITDA margin of around {p}-{r}% by {y} as input costs ease further.",
    "Our management intends debt reduction of {a} crore over the next financial year as free cash improves.",
    "We believe net profit should see growth of {p}% in this financial year for our company overall.",
    "Our portfolio plan is to add {p} rooms and keys in {y} across the new properties we manage.",
    "Could the team say how you expect revenue to grow {p}% next year or if you see risk there?",
    "Going forward we expect revenue growth of at least {p}% in the coming quarters from our hotels.",
    "Debt was at Rs {b} crore last year and after that we aim to bring borrowings below Rs {a} crore within two years from now.",
]
TAIL = " Thank you all for joining us on this call today and for the questions."


def _fill_spark(t, a, b, p, r, y):
    parts, vals = [], {"{a}": a, "{b}": b, "{p}": p, "{r}": r, "{y}": y}
    while t:
        at = min((t.find(k) for k in vals if k in t), default=-1)
        if at < 0:
            parts.append(F.lit(t))
            break
        if at:
            parts.append(F.lit(t[:at]))
        parts.append(vals[t[at:at + 3]])
        t = t[at + 3:]
    return F.concat(*parts)


def call_text(spark, sf, wide=None):
    """One transcript turn per claim: a statement written from its figures.

    The line items are summed once, for the claims and for the figures.
    """
    wide = cut_lineage(V.facts_wide(spark, sf).filter("period_type = 'annual'")) if wide is None else wide
    c = V.claims(spark, sf, wide).join(F.broadcast(V.metric_map(spark).select("metric_type", "metric", "mi")), "metric_type")
    f = wide.filter("period_type = 'annual'").select("company_id", "fy", F.col("revenue").alias("rev"), F.col("borrowings").alias("bor"))
    c = c.join(f, ["company_id", "fy"])
    k = (F.col("skey") * 3 + F.col("fy") + F.col("mi")) % 8
    base = F.when(k.isin(2, 7), F.col("bor")).otherwise(F.col("rev"))
    pct = (5 + (F.col("skey") * 7 + F.col("fy") * 3 + F.col("mi")) % 30).cast("int")
    amount = F.floor(base / 1000 * (80 + pct) / 100 / F.when(k == 2, 10).otherwise(1)).cast("bigint")
    prior = F.floor(base / 1000).cast("bigint")
    args = (F.format_number(amount, 0), F.format_number(prior, 0), pct.cast("string"), (pct + 3).cast("string"), P.fy_label(F.col("fy")))
    text = F.lit(None).cast("string")
    for i, t in enumerate(TEMPLATES):
        text = F.when(k == i, _fill_spark(t, *args)).otherwise(text)
    return c.select(
        F.col("company_id").alias("company"), F.concat(text, F.lit(TAIL)).alias("text"), P.quarter_label(F.col("fy") - 1, 1 + F.col("skey") % 4).alias("period"),
        F.when(F.col("mi") == 7, "annual_report").when(F.col("mi") == 6, "announcement").otherwise("call_transcript").alias("doc_type"),
        V._pick(["Asha Rao", "Moderator", "Dev Shah", "Carla Diaz", "Unknown", "Elif Kaya"], (F.col("skey") + F.col("mi")) % 6).alias("speaker"),
        F.concat(F.lit("call_"), "fy", F.lit(".json")).alias("source_file"), F.col("claim_id").alias("chunk_id"))


def _fill_sql(t):
    t = t.replace("'", "''")
    for key, expr in (("{a}", "fa"), ("{b}", "fb"), ("{p}", "pct"), ("{r}", "(pct + 3)"), ("{y}", "y")):
        t = t.replace(key, f"' || {expr} || '")
    return f"'{t}'"


view("call_text", f"""
SELECT company_id AS company, CASE k {' '.join(f'WHEN {i} THEN {_fill_sql(t)}' for i, t in enumerate(TEMPLATES))} END || '{TAIL}' AS text,
  'Q' || (1 + skey % 4) || ' FY' || lpad(CAST((fy - 1) % 100 AS VARCHAR), 2, '0') AS period, CASE mi WHEN 7 THEN 'annual_report' WHEN 6 THEN 'announcement' ELSE 'call_transcript' END AS doc_type,
  (['Asha Rao', 'Moderator', 'Dev Shah', 'Carla Diaz', 'Unknown', 'Elif Kaya'])[(skey + mi) % 6 + 1] AS speaker, 'call_' || fy || '.json' AS source_file, claim_id AS chunk_id
FROM (SELECT *, format('{{:,}}', CAST(floor(base / 1000 * (80 + pct) / 100 / CASE WHEN k = 2 THEN 10 ELSE 1 END) AS BIGINT)) AS fa, format('{{:,}}', CAST(floor(base / 1000) AS BIGINT)) AS fb,
  'FY' || lpad(CAST(fy % 100 AS VARCHAR), 2, '0') AS y FROM (
    SELECT c.*, m.mi, (c.skey * 3 + c.fy + m.mi) % 8 AS k, CASE WHEN (c.skey * 3 + c.fy + m.mi) % 8 IN (2, 7) THEN w.borrowings ELSE w.revenue END AS base, 5 + (c.skey * 7 + c.fy * 3 + m.mi) % 30 AS pct
    FROM claims c JOIN metric_map m USING (metric_type) JOIN facts_wide w ON w.company_id = c.company_id AND w.fy = c.fy AND w.period_type = 'annual'))""")


def q(s):
    return s.replace("'", "''")


_FWD, _LOWT = q(M.FORWARD), "lower(sentence)"
view("call_sentences", f"""
SELECT company, period, doc_type, speaker, source_file, chunk_id, CAST(i - 1 AS INT) AS sentence_no, trim(s) AS sentence FROM (
  SELECT *, unnest(p) AS s, generate_subscripts(p, 1) AS i FROM (SELECT *, list_filter(string_split(regexp_replace({CLEAN_SQL.format(c='text')}, '([.!?])\\s+([A-Z0-9"''(\\-])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: {WORDS_SQL.format(c='x')} >= 8) AS p FROM call_text))""")
_FORWARD_SQL = (f"(NOT {contains_any(_LOWT, L.STATEMENT_BOILERPLATE)} AND NOT (ends_with(trim(sentence), '?') OR (contains(sentence, '?') AND regexp_matches({_LOWT}, '{q(M.ADDRESS)}'))) AND regexp_matches({_LOWT}, '{_FWD}'))")
_SCOPED_SQL = contains_any("(' ' || lower(sentence) || ' ')", L.SCOPE_WORDS)


def _metrics_sql(names):
    return "list_filter([" + ", ".join(f"CASE WHEN {contains_any(_LOWT, L.PROMISE_METRICS[m])} THEN '{m}' END" for m in names) + "], lambda x: x IS NOT NULL)"


def spoken(spark, sf):
    return T.sentences(call_text(spark, sf))


@query("t13_forward", f"SELECT chunk_id, sentence_no, {_FORWARD_SQL} AS forward, {_SCOPED_SQL} AS scoped FROM call_sentences")
def _(spark, sf):
    s = F.col("sentence")
    return spoken(spark, sf).select("chunk_id", "sentence_no", M.is_forward(s).alias("forward"), M.is_company_scoped(s).alias("scoped"))


@query("t14_map_metrics", f"SELECT chunk_id, sentence_no, array_to_string({_metrics_sql(L.PROMISE_METRICS)}, ',') AS metrics, array_to_string({_metrics_sql(L.VERIFIABLE_METRICS)}, ',') AS verifiable FROM call_sentences")
def _(spark, sf):
    s = F.col("sentence")
    return spoken(spark, sf).select("chunk_id", "sentence_no", F.array_join(M.metrics_of(s), ",").alias("metrics"), F.array_join(M.metrics_of(s, only=L.VERIFIABLE_METRICS), ",").alias("verifiable"))


_T9 = [q(p) for p in T.TIME_PATTERNS]


@query("t9_time_refs", "SELECT chunk_id, array_to_string(list_sort(list_distinct(list_transform(" + " || ".join(f"regexp_extract_all(text, '{p}', 0)" for p in _T9) + ", lambda x: trim(x)))), ',') AS refs FROM call_text")
def _(spark, sf):
    return call_text(spark, sf).select("chunk_id", F.array_join(F.array_sort(T.time_refs(F.col("text"))), ",").alias("refs"))


def _spans_sql(src, text, pattern, extra):
    """Matches with 0-based offsets: gap lengths plus earlier match lengths."""
    return f"""SELECT {extra}, h[i] AS hit, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0) AS INT) AS pos, i
      FROM (SELECT *, unnest(generate_series(1, len(h))) AS i FROM (SELECT *, regexp_extract_all({text}, '{pattern}', 0) AS h, string_split_regex({text}, '{pattern}') AS g FROM {src}) WHERE len(h) > 0)"""


@query("t9_numeric_metrics", " UNION ALL ".join(
    f"SELECT chunk_id, '{t}' AS type, replace(regexp_extract(hit, '{q(p)}', 1), ',', '') AS value, pos AS position, trim(substr(text, greatest(pos - 40, 0) + 1, least(length(text), pos + length(hit) + 40) - greatest(pos - 40, 0))) AS context FROM ({_spans_sql('call_text', 'text', q(p), 'chunk_id, text')})"
    for t, p in T.METRIC_PATTERNS))
def _(spark, sf):
    return T.numeric_metrics(call_text(spark, sf), "text", ["chunk_id"])


@query("t17_target_period", f"""
SELECT chunk_id, sentence_no, CASE WHEN y2 <> '' THEN 'FY' || y2 WHEN nextfy THEN 'FY' || lpad(CAST((fy + 1) % 100 AS VARCHAR), 2, '0') WHEN thisfy THEN 'FY' || lpad(CAST(fy % 100 AS VARCHAR), 2, '0') WHEN hz THEN 'FY' || lpad(CAST((fy + 3) % 100 AS VARCHAR), 2, '0') ELSE 'Unknown' END AS target_period,
  CASE WHEN y2 <> '' THEN 'explicit' WHEN nextfy OR thisfy OR hz THEN 'relative' WHEN near THEN 'near_term' ELSE 'unknown' END AS basis
FROM (SELECT *, regexp_extract(sentence, 'FY(\\d\\d)', 1) AS y2, contains({_LOWT}, 'next financial year') AS nextfy, contains({_LOWT}, 'this financial year') AS thisfy, contains({_LOWT}, 'two years from now') AS hz, contains({_LOWT}, 'coming quarters') AS near,
  CASE WHEN CAST(right(period, 2) AS INT) < 50 THEN 2000 ELSE 1900 END + CAST(right(period, 2) AS INT) AS fy FROM call_sentences)""")
def _(spark, sf):
    t = spoken(spark, sf).withColumn("tp", M.target_period(F.col("sentence"), F.col("period")))
    return t.select("chunk_id", "sentence_no", F.col("tp.period").alias("target_period"), F.col("tp.basis").alias("basis"))


# Every way to name a target period: statement, then what it must be read as. Numbers are
# years after the fiscal year of the call; the SQL states these values, not the patterns.
PERIOD_FORMS = [
    ("We expect revenue to double over FY2026-28 on the back of strong demand.", "FY28", "explicit"),
    ("We expect revenue to reach the target over fiscal year 26/27 in all our markets.", "FY27", "explicit"),
    ("We expect margins to improve by Q3 FY26 as our input costs ease further.", "Q3 FY26", "explicit"),
    ("We expect margins to improve in FY'27 as our input costs ease further.", "FY27", "explicit"),
    ("We expect margins to improve in financial year 2029 as our input costs ease.", "FY29", "explicit"),
    ("We expect our borrowings to be nil by 2031 with the cash we generate.", "FY31", "explicit"),
    ("We expect our borrowings to fall in this fiscal year with free cash.", 0, "relative"),
    ("We expect our borrowings to fall within the current year with free cash.", 0, "relative"),
    ("We expect our borrowings to fall in the next fiscal year with free cash.", 1, "relative"),
    ("We expect to be free of debt some three years from now at this pace.", 4, "relative"),
    ("We expect to be free of debt two to four years down the line at most.", 5, "relative"),
    ("We expect to be free of debt about 1.5 years out at this pace.", 2, "relative"),
    ("We expect revenue growth to hold up in the next few quarters at least.", "Unknown", "near_term"),
    ("We expect revenue growth to hold up across all markets we are in.", "Unknown", "unknown"),
    ("We expected three years of growth and got them before this call began.", "Unknown", "unknown"),
]


def _form_sql():
    read = lambda p: f"'{p}'" if isinstance(p, str) else f"'FY' || (20 + conv_id % 7 + {p})"
    pick = lambda i, f: "CASE (conv_id + turn) % {n} ".format(n=len(PERIOD_FORMS)) + " ".join(f"WHEN {k} THEN {f(x[i])}" for k, x in enumerate(PERIOD_FORMS)) + " END"
    return f"SELECT conv_id, turn, {pick(1, read)} AS target_period, {pick(2, lambda b: repr(b))} AS basis FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL"


def _closing(spark, sf, forms, number):
    """The last sentence of every conversation turn's whole text, once one of ``forms`` was added."""
    said = F.concat(F.coalesce("text", F.lit("")), F.lit(". "), V._pick([x[0] for x in forms], number % len(forms)))
    turns = V.table(spark, sf, "conversations").filter("conv_id is not null and turn is not null")
    return turns.select("conv_id", "turn", F.element_at(T.sentences_of(T.clean_text(said)), -1).alias("sentence"))


@query("t17b_period_forms", _form_sql())
def _(spark, sf):
    """Each turn of a conversation ends with one of the forms; the last sentence of its
    whole text is read, against a quarter that follows from the conversation."""
    source = P.quarter_label(2020 + F.col("conv_id") % 7, 1 + F.col("turn") % 4)
    last = _closing(spark, sf, PERIOD_FORMS, F.col("conv_id") + F.col("turn")).withColumn("period", source)
    read = last.withColumn("tp", M.target_period(F.col("sentence"), F.col("period")))
    return read.select("conv_id", "turn", F.col("tp.period").alias("target_period"), F.col("tp.basis").alias("basis"))


# ---- target extraction and assembly ---------------------------------------------------
_SPK = " OR ".join(f"contains(lower(speaker), '{w}')" for w in L.NON_MANAGEMENT)
view("prom_sent", f"""
SELECT *, {_metrics_sql(L.VERIFIABLE_METRICS)} AS metrics FROM call_sentences
WHERE doc_type IN ('call_transcript', 'quarterly_results', 'announcement') AND (doc_type <> 'call_transcript' OR NOT (lower(speaker) IN ('', 'unknown') OR {_SPK})) AND {_FORWARD_SQL} AND {_SCOPED_SQL} AND len({_metrics_sql(L.VERIFIABLE_METRICS)}) > 0""")
_KW = [(i, m, w) for i, m in enumerate(L.VERIFIABLE_METRICS) for w in L.PROMISE_METRICS[m]]
view("prom_kw", f"""
SELECT chunk_id, sentence_no, ord, metric, w, CAST(list_sum(list_transform(g[1:j], lambda x: length(x))) + (j - 1) * length(w) AS INT) AS at FROM (
  SELECT *, unnest(generate_series(1, len(g) - 1)) AS j FROM (SELECT chunk_id, sentence_no, k.*, string_split(lower(sentence), k.w) AS g FROM prom_sent,
    (VALUES {', '.join(f"({i}, '{m}', '{w}')" for i, m, w in _KW)}) k(ord, metric, w) WHERE contains(lower(sentence), k.w)))""")
_TG = q(M.TARGET)
_CTX = "substr(lower(sentence), greatest(pos - {w}, 0) + 1, least(length(sentence), pos + length(hit) + {w}) - greatest(pos - {w}, 0))"
view("prom_cand", f"""
SELECT *, CASE WHEN unit0 = '' THEN 'currency' ELSE unit0 END AS unit FROM (
  SELECT chunk_id, sentence_no, sentence, i, pos, hit, trim(hit) AS raw, regexp_extract(hit, '{_TG}', 1) AS prefix, lower(regexp_extract(hit, '{_TG}', 2)) AS comparator,
    CAST(replace(regexp_extract(hit, '{_TG}', 3), ',', '') AS DOUBLE) AS low, TRY_CAST(replace(regexp_extract(hit, '{_TG}', 4), ',', '') AS DOUBLE) AS high, lower(regexp_extract(hit, '{_TG}', 5)) AS unit0
  FROM ({_spans_sql('prom_sent', 'sentence', _TG, 'chunk_id, sentence_no, sentence')}))
WHERE pos >= length(string_split_regex(lower(sentence), '{_FWD}')[1]) AND (unit0 <> '' OR prefix <> '') AND NOT regexp_matches({_CTX.format(w=30)}, '{q(M.SURE)}') AND NOT regexp_matches({_CTX.format(w=30)}, '{q(M.PAST)}') AND NOT regexp_matches(raw, '{q(M.DAY)}')""")
view("prom_best", f"""
SELECT *, coalesce(near, 0) + CASE WHEN regexp_matches({_CTX.format(w=90)}, '{_FWD}') THEN 4 ELSE 0 END + CASE WHEN regexp_matches({_CTX.format(w=90)}, '{q(M.CUE)}') THEN 3 ELSE 0 END - CASE WHEN regexp_matches({_CTX.format(w=90)}, '{q(M.SPEND)}') THEN 4 ELSE 0 END
  + CASE WHEN unit0 <> '' THEN 2 ELSE 0 END + CASE WHEN prefix <> '' THEN 2 ELSE 0 END + CASE WHEN high IS NOT NULL THEN 2 ELSE 0 END AS score
FROM prom_cand c LEFT JOIN (SELECT chunk_id, sentence_no, i, CAST(sum(CASE WHEN d <= 140 THEN greatest(1, CAST(floor(12 - d / 15.0) AS INT)) ELSE 1 END) AS INT) AS near FROM (
    SELECT c.chunk_id, c.sentence_no, c.i, k.ord, k.w, min(abs(k.at - c.pos)) AS d FROM prom_cand c JOIN prom_kw k USING (chunk_id, sentence_no) GROUP BY ALL) GROUP BY ALL) n USING (chunk_id, sentence_no, i)
QUALIFY row_number() OVER (PARTITION BY chunk_id, sentence_no ORDER BY score DESC, i) = 1""")


@query("t15_target", "SELECT chunk_id, sentence_no, raw, low, high, unit, comparator, CAST(score AS INT) AS score, pos FROM prom_best")
def _(spark, sf):
    """Best-scored number of each promise sentence; offsets rebuilt from split lengths."""
    s = F.col("sentence")
    d = M.candidate_sentences(call_text(spark, sf)).filter(F.size(M.metrics_of(s, only=L.VERIFIABLE_METRICS)) > 0)
    d = computed_once(d, {"b": M.best_target(s)}).filter("b is not null").select("chunk_id", "sentence_no", "b.t.*")
    return d.select("chunk_id", "sentence_no", "raw", "low", "high", "unit", "comparator", "score", "pos")


# Ways to state a target: sentence, then low and high number, unit and metric.
TARGET_FORMS = [
    ("We expect revenue to reach Rs 1,250 crore by FY26 in our core markets.", 1250.0, None, "crore", "Revenue"),
    ("We are targeting EBITDA margin of 32-34% by FY26 across the portfolio.", 32.0, 34.0, "%", "EBITDA Margin"),
    ("We expect net profit growth of at least 15% in FY26 for the company.", 15.0, None, "%", "Net Profit"),
    ("We expect to bring debt below Rs 300 crore by FY26 as our cash improves.", 300.0, None, "crore", "Debt"),
    ("We expect revenue growth of 12 to 14 percent in FY26 in our markets.", 12.0, 14.0, "percent", "Revenue"),
    ("After growth of 9% last year we expect revenue to grow 11% in FY26.", 11.0, None, "%", "Revenue"),
    ("We are confident 100% that we will see revenue growth of 8% in FY26.", 8.0, None, "%", "Revenue"),
    ("We expect revenue to keep growing in FY26 across all our markets.", None, None, None, None),
]


def _target_forms_sql():
    value = lambda v: "NULL" if v is None else repr(v)
    case = lambda i, kind: f"CAST(CASE (conv_id * 3 + turn) % {len(TARGET_FORMS)} " + " ".join(f"WHEN {k} THEN {value(x[i])}" for k, x in enumerate(TARGET_FORMS)) + f" END AS {kind})"
    return f"""SELECT conv_id, turn, {case(1, 'DOUBLE')} AS low, {case(2, 'DOUBLE')} AS high, {case(3, 'VARCHAR')} AS unit, {case(4, 'VARCHAR')} AS metric
FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL"""


@query("t15b_target_forms", _target_forms_sql())
def _(spark, sf):
    """Each turn of a conversation ends with one of the forms; the last sentence of its
    whole text is read."""
    last = _closing(spark, sf, TARGET_FORMS, F.col("conv_id") * 3 + F.col("turn")).withColumn("b", M.best_target(F.col("sentence")))
    return last.select("conv_id", "turn", F.col("b.t.low").alias("low"), F.col("b.t.high").alias("high"), F.col("b.t.unit").alias("unit"), F.col("b.metric").alias("metric"))


view("prom_primary", """
SELECT b.*, m.metric AS primary_metric FROM prom_best b JOIN (SELECT b.chunk_id, b.sentence_no, min_by(k.metric, abs(k.at - b.pos) * 100 + k.ord) AS metric FROM prom_best b JOIN prom_kw k USING (chunk_id, sentence_no) GROUP BY ALL) m USING (chunk_id, sentence_no)""")


@query("t16_primary_metric", "SELECT chunk_id, sentence_no, primary_metric FROM prom_primary")
def _(spark, sf):
    s = F.col("sentence")
    d = M.candidate_sentences(call_text(spark, sf)).filter(F.size(M.metrics_of(s, only=L.VERIFIABLE_METRICS)) > 0)
    return computed_once(d, {"b": M.best_target(s)}).filter("b is not null").select("chunk_id", "sentence_no", F.col("b.metric").alias("primary_metric"))


_TPSQL = """SELECT chunk_id, sentence_no, target_period, basis, sfy FROM (SELECT *, CASE WHEN y2 <> '' THEN 'FY' || y2 WHEN nextfy THEN 'FY' || lpad(CAST((sfy + 1) % 100 AS VARCHAR), 2, '0') WHEN thisfy THEN 'FY' || lpad(CAST(sfy % 100 AS VARCHAR), 2, '0') WHEN hz THEN 'FY' || lpad(CAST((sfy + 3) % 100 AS VARCHAR), 2, '0') ELSE 'Unknown' END AS target_period,
  CASE WHEN y2 <> '' THEN 'explicit' WHEN nextfy OR thisfy OR hz THEN 'relative' WHEN near THEN 'near_term' ELSE 'unknown' END AS basis
FROM (SELECT chunk_id, sentence_no, regexp_extract(sentence, 'FY(\\d\\d)', 1) AS y2, contains(lower(sentence), 'next financial year') AS nextfy, contains(lower(sentence), 'this financial year') AS thisfy, contains(lower(sentence), 'two years from now') AS hz, contains(lower(sentence), 'coming quarters') AS near,
  CASE WHEN CAST(right(period, 2) AS INT) < 50 THEN 2000 ELSE 1900 END + CAST(right(period, 2) AS INT) AS sfy FROM prom_sent))"""
view("promises_sql", f"""
SELECT 'promise_' || substr(sha1(s.company || '|' || s.source_file || '|' || s.speaker || '|' || substr(s.sentence, 1, 500) || '|' || p.raw), 1, 12) AS id, s.company, s.period AS source_period, t.target_period, t.basis AS target_period_basis,
  s.doc_type, s.speaker, s.source_file, s.sentence AS text, array_to_string(s.metrics, ',') AS metrics, p.primary_metric, p.raw AS target, p.low AS target_low, p.high AS target_high, p.unit AS target_unit, p.comparator,
  CASE WHEN p.primary_metric = 'Debt' THEN 'down' WHEN regexp_matches(lower(s.sentence), '{q(M.HOLD)}') THEN 'maintain' ELSE 'up' END AS direction,
  (t.sfy - 1) * 12 + 3 + 3 * CAST(substr(s.period, 2, 1) AS INT) AS source_key,
  CASE WHEN t.target_period <> 'Unknown' THEN (CASE WHEN CAST(right(t.target_period, 2) AS INT) < 50 THEN 2000 ELSE 1900 END + CAST(right(t.target_period, 2) AS INT)) * 12 + 3 END AS target_key
FROM prom_sent s JOIN prom_primary p USING (chunk_id, sentence_no) JOIN ({_TPSQL}) t USING (chunk_id, sentence_no)
WHERE p.unit NOT IN ('rooms', 'keys', 'hotels', 'properties', 'sqft', 'square feet') AND NOT (p.unit IN ('lakh', 'lakhs') AND p.prefix = '')
  AND NOT (p.primary_metric = 'Debt' AND p.unit IN ('%', 'percent', 'percentage', 'bps', 'basis points')) AND p.unit NOT IN ('x', 'times')
  AND NOT (p.primary_metric <> 'Debt' AND regexp_matches(lower(s.sentence), '{q(M.PROJECT)}') AND NOT regexp_matches(lower(s.sentence), '{q(M.COMPANY)}'))
  AND NOT (t.target_period = 'Unknown' AND t.basis = 'unknown')""")
view("promises_final", "SELECT * FROM promises_sql WHERE coalesce(target_key > source_key, true) QUALIFY row_number() OVER (PARTITION BY id ORDER BY company) = 1")
_PCOLS = "id company source_period target_period target_period_basis doc_type speaker source_file text metrics primary_metric target target_low target_high target_unit comparator direction".split()


@query("t18_promises", f"SELECT {', '.join(_PCOLS)} FROM promises_final")
def _(spark, sf):
    return M.extract_promises(call_text(spark, sf)).select(*_PCOLS)


_VM = ["revenue", "revenue_growth", "opm", "operating_profit", "net_profit", "net_profit_growth", "debt_to_equity", "borrowings"]


def verification_facts(spark, sf, wide=None):
    """Long facts for verification: money in thousands, growth against the year before."""
    w = V.facts_wide(spark, sf) if wide is None else wide
    win = Window.partitionBy("company_id", "period_type").orderBy("ord")
    back = lambda c: F.when(F.col("period_type") == "annual", F.lag(c, 1).over(win)).otherwise(F.lag(c, 4).over(win))
    pct = lambda c: (F.col(c) - back(c)) / F.abs(back(c)) * 100
    w = w.select(
        F.col("company_id").alias("company"), "period_type", "period", ((F.col("fy") - 1) * 12 + 3 + F.coalesce(F.col("q"), F.lit(4)) * 3).cast("int").alias("key"),
        *[(F.col(c) / 1000).alias(c) for c in ("revenue", "operating_profit", "net_profit", "borrowings")], "opm",
        pct("revenue").alias("revenue_growth"), pct("net_profit").alias("net_profit_growth"), (F.col("borrowings") / F.when(F.col("equity") != 0, F.col("equity"))).alias("debt_to_equity"))
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in _VM])
    return w.select("company", "period_type", "period", "key", F.inline(cells))


view("ver_facts", """
SELECT company, period_type, period, key, metric, value FROM (SELECT company_id AS company, period_type, period, CAST((fy - 1) * 12 + 3 + coalesce(q, 4) * 3 AS INT) AS key, revenue / 1000 AS revenue, operating_profit / 1000 AS operating_profit, net_profit / 1000 AS net_profit, borrowings / 1000 AS borrowings, opm,
  CASE WHEN period_type = 'annual' THEN (revenue - lag(revenue, 1) OVER w) / abs(lag(revenue, 1) OVER w) * 100 ELSE (revenue - lag(revenue, 4) OVER w) / abs(lag(revenue, 4) OVER w) * 100 END AS revenue_growth,
  CASE WHEN period_type = 'annual' THEN (net_profit - lag(net_profit, 1) OVER w) / abs(lag(net_profit, 1) OVER w) * 100 ELSE (net_profit - lag(net_profit, 4) OVER w) / abs(lag(net_profit, 4) OVER w) * 100 END AS net_profit_growth,
  borrowings / nullif(equity, 0) AS debt_to_equity FROM facts_wide WINDOW w AS (PARTITION BY company_id, period_type ORDER BY ord))
  UNPIVOT INCLUDE NULLS (value FOR metric IN (revenue, operating_profit, net_profit, borrowings, opm, revenue_growth, net_profit_growth, debt_to_equity))""")
_LAD = lambda a, b, c: f"CASE WHEN {a} THEN 'EXCEEDED' WHEN {b} THEN 'KEPT' WHEN {c} THEN 'PARTIAL' ELSE 'BROKEN' END"
view("ver_pick", f"""
SELECT *, CASE WHEN primary_metric <> 'Debt' AND target_period = 'Unknown' THEN 'quarterly' ELSE 'annual' END AS period_type,
  CASE WHEN v_kind = 'debt_reduction' THEN 'up' WHEN primary_metric = 'Debt' THEN 'down' ELSE direction END AS v_direction,
  CASE WHEN target_unit IN ('%') OR v_kind LIKE 'percentage%' THEN target_low WHEN target_unit IN ('crore', 'currency') THEN target_low END AS low, target_high AS high
FROM (SELECT *, CASE WHEN primary_metric = 'Revenue' AND target_unit = '%' THEN 'revenue_growth' WHEN primary_metric = 'Revenue' THEN 'revenue'
    WHEN primary_metric = 'EBITDA Margin' AND (target_unit = '%' OR contains(lower(text), 'margin')) THEN 'opm' WHEN primary_metric = 'EBITDA Margin' THEN 'operating_profit'
    WHEN primary_metric = 'Net Profit' AND target_unit = '%' THEN 'net_profit_growth' WHEN primary_metric = 'Net Profit' THEN 'net_profit' ELSE 'borrowings' END AS v_metric,
  CASE WHEN primary_metric IN ('Revenue', 'Net Profit') AND target_unit = '%' THEN 'percentage_growth' WHEN primary_metric = 'EBITDA Margin' THEN 'percentage_level'
    WHEN primary_metric = 'Debt' AND regexp_matches(lower(text), '{q(M.REPAY)}') THEN 'debt_reduction' ELSE 'currency' END AS v_kind FROM promises_final)""")
view("verified", f"""
SELECT id, company, primary_metric, v_metric, v_kind, period_type, source_period, target_period, actual_period, CASE WHEN NOT pending THEN actual END AS actual_value, base_value, low AS target_low, high AS target_high,
  CASE WHEN pending THEN 'PENDING' WHEN v_direction = 'down' THEN {_LAD('actual <= coalesce(high, low) * 0.9', 'actual <= coalesce(high, low) * 1.05', 'actual <= coalesce(high, low) * 1.2')}
    WHEN high IS NOT NULL THEN {_LAD('actual > high * 1.05', 'actual >= low AND actual <= high * 1.05', 'actual >= low * 0.85')}
    WHEN regexp_matches(comparator, 'less than|below|under|up to|upto') THEN {_LAD('actual < low * 0.9', 'actual <= low * 1.05', 'actual <= low * 1.2')}
    ELSE {_LAD('actual >= low * 1.05', 'actual >= low * 0.95', 'actual >= low * 0.8')} END AS status,
  CASE WHEN target_key IS NULL THEN 'forward_window' ELSE 'exact_period' END AS method, CASE WHEN target_key IS NULL THEN coalesce(wp, '') END AS window_periods
FROM (SELECT v.*, CASE WHEN v.target_key IS NULL THEN w.n IS NULL ELSE e.period IS NULL END AS pending, CASE WHEN v.target_key IS NULL THEN w.bp ELSE coalesce(e.period, v.target_period) END AS actual_period, w.wp,
    CASE WHEN v_kind = 'debt_reduction' THEN b.value END AS base_value,
    CASE WHEN v_kind = 'debt_reduction' THEN b.value - CASE WHEN v.target_key IS NULL THEN w.bv ELSE e.value END ELSE CASE WHEN v.target_key IS NULL THEN w.bv ELSE e.value END END AS actual
  FROM ver_pick v LEFT JOIN ver_facts e ON e.company = v.company AND e.period_type = v.period_type AND e.metric = v.v_metric AND e.key = v.target_key
  LEFT JOIN (SELECT id, count(*) AS n, string_agg(period, ',' ORDER BY key) AS wp, CASE WHEN any_value(d) = 'down' THEN min(value) ELSE max(value) END AS bv, CASE WHEN any_value(d) = 'down' THEN arg_min(period, value) ELSE arg_max(period, value) END AS bp
    FROM (SELECT v.id, v.v_direction AS d, f.key, f.period, f.value, v.period_type FROM ver_pick v JOIN ver_facts f ON f.company = v.company AND f.period_type = v.period_type AND f.metric = v.v_metric AND f.key > v.source_key AND f.value IS NOT NULL WHERE v.target_key IS NULL
      QUALIFY row_number() OVER (PARTITION BY v.id ORDER BY f.key) <= CASE WHEN v.period_type = 'quarterly' THEN 4 ELSE 2 END) GROUP BY 1) w USING (id)
  LEFT JOIN (SELECT v.id, arg_max(f.value, f.key) AS value FROM ver_pick v JOIN ver_facts f ON f.company = v.company AND f.period_type = v.period_type AND f.metric = v.v_metric AND f.key <= v.source_key GROUP BY 1) b USING (id))
WHERE pending OR (actual IS NOT NULL AND low IS NOT NULL)""")
_VCOLS = "id company primary_metric v_metric v_kind period_type source_period target_period actual_period actual_value base_value target_low target_high status method window_periods".split()


def verified(spark, sf):
    """Statement rows are computed once and feed both the promises and the facts."""
    wide = cut_lineage(V.facts_wide(spark, sf))
    return M.verify_promises(M.extract_promises(call_text(spark, sf, wide)), verification_facts(spark, sf, wide))


@query("x15_verify", f"SELECT {', '.join(_VCOLS)} FROM verified", rounds="actual_value base_value")
def _(spark, sf):
    return verified(spark, sf).select(*_VCOLS)


@query("a4_status_rollup", """
SELECT coalesce(company, 'ALL') AS company, count(*) AS total, count(*) FILTER (WHERE status = 'EXCEEDED') AS exceeded, count(*) FILTER (WHERE status = 'KEPT') AS kept, count(*) FILTER (WHERE status = 'PARTIAL') AS partial,
  count(*) FILTER (WHERE status = 'BROKEN') AS broken, count(*) FILTER (WHERE status = 'PENDING') AS pending, count(*) FILTER (WHERE status <> 'PENDING') AS resolved,
  coalesce(greatest(0, least(100, sum(CASE status WHEN 'EXCEEDED' THEN 1.2::DOUBLE WHEN 'KEPT' THEN 1 WHEN 'PARTIAL' THEN 0.5 WHEN 'BROKEN' THEN -0.5 ELSE 0 END) / nullif(count(*) FILTER (WHERE status <> 'PENDING'), 0) * 100)), 50.0) AS fulfilment
FROM verified GROUP BY ROLLUP (company)""", rounds="fulfilment")
def _(spark, sf):
    return M.status_rollup(verified(spark, sf))
