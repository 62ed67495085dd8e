"""Forward-looking promises: mining from text and verification against facts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import periods as P
from ..functions.values import clean_text, promise_id, to_base_unit
from .joins import series
from .ordered import keep_first
from .rows import computed_once
from .text import any_hit, is_management, match_spans, sentences_of

# Fixed patterns of the promise language.
FORWARD = (
    r"\b(expect(?:s|ed|ing)?|anticipat(?:e|es|ed|ing)|target(?:s|ed|ing)?|aim(?:s|ed|ing)?|plan(?:s|ning)?|guidance|outlook|"
    r"forecast(?:s|ed|ing)?|projecting|going forward|likely to|poised to|committed to|on track|confident|aspire|vision|pipeline|should see|"
    r"hope to|intend(?:s|ed|ing)?|strategy is to|roadmap|"
    r"will\s+(?:achieve|deliver|grow|expand|increase|maintain|improve|reduce|open|add|reach|be|have|cross|commission|complete))\b"
)
ADDRESS = r"\b(would|could|do|does|can|should|if)\s+you\b"
TARGET = (
    r"(?i)(Rs\.?|INR|rupees)?\s*(at least|atleast|minimum|min|not less than|more than|over|above|greater than|less than|below|under|up to|upto|"
    r"around|approximately|approx\.?|about|nearly|close to|between|exceed|exceeds|surpass|north of)?\s*(\d[\d,]*(?:\.\d+)?)"
    r"(?:\s*(?:-|to|and)\s*(\d[\d,]*(?:\.\d+)?))?\s*"
    r"(%|percent|percentage|bps|basis points|crore|crores|cr|million|mn|billion|bn|lakh|lakhs|x|times|rooms|keys|hotels|properties|sqft|square feet)?"
)
SURE = r"\b(confidence|confident|sure|certainty|guarantee)\b"
PAST = r"\b(historically|already|reported|posted|clocked|achieved|spent|stood at|was at|were at)\b"
DAY = r"(?i)\b\d{1,2}\s+(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"
CUE = r"\b(yield|contribute|add|deliver|north of|exceed|target|guidance)\b"
SPEND = r"\b(capital work|cwip|capex|spent|investment|cost)\b"
FY_RANGE = r"(?i)\b(?:FY|financial year|fiscal year)\s*'?(?:20)?(\d{2})\s*[-/]\s*(?:20)?(\d{2})\b"
FY_ANY = (
    r"(?i)\b(?:Q([1-4])\s*)?FY\s*['-]?(\d{2,4})\b|\b(?:financial year|fiscal year)\s*(\d{2,4})\b|"
    r"\b(?:by|in|for|before|end of)\s+(20[2-3]\d)\b"
)
HORIZON = (
    r"\b(\d+(?:\.\d+)?|one|two|three|four|five)(?:\s+and\s+a\s+half)?(?:\s+to\s+(\d+(?:\.\d+)?|one|two|three|four|five))?"
    r"\s+years?\s+(?:away|out|from now|from today|down the line)\b"
)
NEAR = r"\bcoming quarters|next few quarters|near term|going forward\b"
RATIO_TALK = r"(?i)debt[- ]?to[- ]?equity|debt equity|leverage ratio"
PROJECT = r"\b(project|projects|property|properties|tower|towers|office|commercial|specific hotel|new hotel|four hotels|these hotels)\b"
COMPANY = r"\b(company|consolidated|portfolio|full[- ]year|for the year|this financial year|our revenue|our ebitda|we will do|guidance)\b"
REPAY = r"\brepayment|pay down|repay|reduction|reduce by|bring down by\b"
HOLD = r"\bmaintain|sustain|stable|hold\b"
DOCS = ["call_transcript", "quarterly_results", "announcement"]
NUMBER_WORDS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5}
PERCENT = ["%", "percent", "percentage", "bps", "basis points"]


def _has(c: Column, pattern: str) -> Column:
    return F.rlike(c, F.lit(pattern))


def is_forward(text: Column, boilerplate: Sequence[str] = L.STATEMENT_BOILERPLATE) -> Column:
    def judge(low: Column) -> Column:
        question = F.endswith(F.trim(text), F.lit("?")) | (F.contains(text, F.lit("?")) & _has(low, ADDRESS))
        return ~any_hit(low, boilerplate) & ~question & _has(low, FORWARD)

    return P.let(F.lower(text), judge)


def is_company_scoped(text: Column, terms: Sequence[str] = L.SCOPE_WORDS) -> Column:
    return P.let(F.concat(F.lit(" "), F.lower(text), F.lit(" ")), lambda low: any_hit(low, terms))


def metrics_of(text: Column, words: Mapping[str, Sequence[str]] = L.PROMISE_METRICS, only: Sequence[str] | None = None) -> Column:
    names = [m for m in words if only is None or m in only]
    found = lambda low: F.array(*[F.when(any_hit(low, words[m]), F.lit(m)) for m in names])
    return F.filter(P.let(F.lower(text), found), lambda m: m.isNotNull())


def keyword_positions(text: Column, words: Mapping[str, Sequence[str]], only: Sequence[str]) -> Column:
    """``array<struct<ord,metric,at>>``: every keyword that occurs and all its offsets."""
    entry = lambda i, m, w: F.struct(F.lit(i).alias("ord"), F.lit(m).alias("metric"), F.lit(w).alias("w"))
    table = F.array(*[entry(i, m, w) for i, m in enumerate(only) for w in words[m]])

    def offsets(low: Column, w: Column) -> Column:
        gaps = F.split(low, F.concat(F.lit(r"\Q"), w, F.lit(r"\E")), -1)
        before = lambda g, i: F.aggregate(F.slice(g, F.lit(1), i), F.lit(0), lambda a, x: a + F.length(x)) + (i - 1) * F.length(w)
        return P.let(gaps, lambda g: F.transform(F.sequence(F.lit(1), F.size(g) - 1), lambda i: before(g, i)))

    return P.let(F.lower(text), lambda low: F.transform(
        F.filter(table, lambda k: F.contains(low, k["w"])),
        lambda k: F.struct(k["ord"].alias("ord"), k["metric"].alias("metric"), offsets(low, k["w"]).alias("at"))))


def _around(low: Column, pos: Column, n: Column, width: int) -> Column:
    start = F.greatest(pos - width, F.lit(0))
    return F.substring(low, start + 1, F.least(F.length(low), pos + n + width) - start)


def target_candidates(text: Column, kws: Column) -> Column:
    """Scored numeric candidates after the first forward word, context rules applied."""
    bound = F.struct(F.lower(text).alias("low"), (F.regexp_instr(F.lower(text), F.lit(FORWARD)) - 1).alias("first"))
    return P.let(bound, lambda b: _candidates(text, kws, b["low"], b["first"]))


def _candidates(text: Column, kws: Column, low: Column, first: Column) -> Column:
    group = lambda h, i: F.regexp_extract(h, TARGET, i)
    number = lambda s: F.replace(s, F.lit(","), F.lit("")).try_cast("double")
    parsed = F.transform(match_spans(text, TARGET), lambda m, i: F.struct(
        i.alias("i"), m["pos"].alias("pos"), F.length(m["hit"]).alias("n"), F.trim(m["hit"]).alias("raw"),
        group(m["hit"], 1).alias("prefix"), F.lower(group(m["hit"], 2)).alias("comparator"),
        number(group(m["hit"], 3)).alias("low"), number(group(m["hit"], 4)).alias("high"), F.lower(group(m["hit"], 5)).alias("unit")))
    kept = F.filter(parsed, lambda c: (
        (c["pos"] >= first) & ((c["unit"] != "") | (c["prefix"] != ""))
        & ~_has(_around(low, c["pos"], c["n"], 30), SURE) & ~_has(_around(low, c["pos"], c["n"], 30), PAST) & ~_has(c["raw"], DAY)))

    def points(c):
        near = F.aggregate(kws, F.lit(0), lambda acc, k: acc + P.let(
            F.array_min(F.transform(k["at"], lambda p: F.abs(p - c["pos"]))),
            lambda d: F.when(d <= 140, F.greatest(F.lit(1), F.floor(F.lit(12) - d / 15).cast("int"))).otherwise(1)))
        yes = lambda cond, n: F.when(cond, n).otherwise(0)
        window = _around(low, c["pos"], c["n"], 90)
        return (near + yes(_has(window, FORWARD), 4) + yes(_has(window, CUE), 3) - yes(_has(window, SPEND), 4)
                + yes(c["unit"] != "", 2) + yes(c["prefix"] != "", 2) + yes(c["high"].isNotNull(), 2))

    return F.transform(kept, lambda c: F.struct(
        points(c).alias("score"), (-c["i"]).alias("neg_i"), c["pos"].alias("pos"), c["raw"].alias("raw"), c["prefix"].alias("prefix"),
        c["comparator"].alias("comparator"), c["low"].alias("low"), c["high"].alias("high"),
        F.when(c["unit"] != "", c["unit"]).otherwise("currency").alias("unit")))


def best_target(text: Column, words=L.PROMISE_METRICS, verifiable: Sequence[str] = L.VERIFIABLE_METRICS) -> Column:
    """``struct<t,metric>``: best-scored candidate and the metric nearest to it."""
    return P.let(keyword_positions(text, words, list(verifiable)), lambda k: P.let(
        F.array_max(target_candidates(text, k)),
        lambda t: F.when(t.isNotNull(), F.struct(t.alias("t"), nearest_metric(k, t["pos"]).alias("metric")))))


def nearest_metric(kws: Column, pos: Column) -> Column:
    """Metric whose keyword lies closest to the target; list order on ties."""
    near = F.transform(kws, lambda k: F.struct(F.array_min(F.transform(k["at"], lambda p: F.abs(p - pos))).alias("d"), k["ord"].alias("o"), k["metric"].alias("m")))
    return F.array_min(near)["m"]


def target_period(text: Column, source_period: Column) -> Column:
    """``struct<period,basis>`` named by the sentence, or implied relative to its source.

    Every pattern runs at most once over a sentence, and only if it has the pattern's
    words at all; groups are read from the short match.
    """
    got = lambda t, p, i: F.nullif(F.regexp_extract(t, p, i), F.lit(""))
    fy2 = lambda c: F.concat(F.lit("FY"), F.right(c, F.lit(2)))
    res = lambda p, b: F.struct(p.alias("period"), F.lit(b).alias("basis"))
    words = F.create_map(*[F.lit(x) for kv in NUMBER_WORDS.items() for x in kv])

    def horizon(hit: Column, fy: Column) -> Column:
        span = F.coalesce(got(hit, HORIZON, 2), got(hit, HORIZON, 1))
        years = F.coalesce(F.try_element_at(words, span), F.floor(span.try_cast("double")).cast("int"))
        year = F.coalesce(F.nullif(F.regexp_extract(source_period, r"(20\d{2})", 1), F.lit("")).cast("int"), fy)
        return res(P.fy_label(year + years + 1), "relative")

    def relative(low: Column, fy: Column) -> Column:
        year = F.contains(low, F.lit("year"))
        return P.let(F.when(year, got(low, HORIZON, 0)), lambda hit: (
            F.when(fy.isNull(), res(F.lit("Unknown"), "unknown"))
            .when(year & (_has(low, r"\b(current|this)\s+(financial|fiscal)\s+year\b") | _has(low, r"\b(current|this)\s+year\b")), res(P.fy_label(fy), "relative"))
            .when(year & _has(low, r"\bnext\s+(financial|fiscal)\s+year\b"), res(P.fy_label(fy + 1), "relative"))
            .when(hit.isNotNull(), horizon(hit, fy))
            .when(_has(low, NEAR), res(F.lit("Unknown"), "near_term"))
            .otherwise(res(F.lit("Unknown"), "unknown"))))

    def named(low: Column) -> Column:
        """Matches of a range and of any fiscal year, null where neither can be."""
        some = any_hit(low, ["fy", "financial year", "fiscal year"])
        return F.struct(F.when(some, got(text, FY_RANGE, 2)).alias("range"), F.when(some | F.contains(low, F.lit("20")), got(text, FY_ANY, 0)).alias("any"))

    def explicit(low: Column, x: Column) -> Column:
        hit = x["any"]
        year, q = F.coalesce(got(hit, FY_ANY, 2), got(hit, FY_ANY, 3), got(hit, FY_ANY, 4)), got(hit, FY_ANY, 1)
        return (
            F.when(x["range"].isNotNull(), res(F.concat(F.lit("FY"), x["range"]), "explicit"))
            .when(hit.isNotNull(), P.let(F.struct(q.alias("q"), year.alias("y")), lambda y: res(F.concat(F.coalesce(F.concat(F.lit("Q"), y["q"], F.lit(" ")), F.lit("")), fy2(y["y"])), "explicit")))
            .otherwise(P.let(P.label_fy(source_period), lambda fy: relative(low, fy))))

    return P.let(F.lower(text), lambda low: P.let(named(low), lambda x: explicit(low, x)))


def candidate_sentences(chunks: DataFrame, skip: Sequence[str] = L.NON_MANAGEMENT) -> DataFrame:
    """Sentences of the right documents and speakers, cheap gates applied first."""
    speaker_ok = (F.col("doc_type") != "call_transcript") | is_management(F.col("speaker"), "promise", skip)
    src = chunks.filter(F.col("doc_type").isin(DOCS) & speaker_ok)
    keep = [c for c in src.columns if c != "text"]
    s = src.select(*keep, F.posexplode(sentences_of(clean_text(F.col("text")))).alias("sentence_no", "sentence"))
    return s.filter(is_forward(F.col("sentence")) & is_company_scoped(F.col("sentence")))


def _passes(low: Column, t: Column, m: Column, tp: Column, source_period: Column) -> Column:
    """Unit, scope and period gates of a promise with target ``t`` on metric ``m``."""
    u = t["unit"]
    ratio = _has(low, RATIO_TALK)
    financial = m.isin("Revenue", "EBITDA Margin", "Net Profit")
    flow = u.isin(PERCENT) & F.contains(low, F.lit("flow through"))
    return (
        ~u.isin("rooms", "keys", "hotels", "properties", "sqft", "square feet")
        & ~(u.isin("lakh", "lakhs") & (t["prefix"] == ""))
        & ~((m == "Debt") & u.isin(PERCENT) & ~ratio)
        & ~(u.isin("x", "times") & ((m != "Debt") | ~ratio))
        & ~(financial & (flow | (_has(low, PROJECT) & ~_has(low, COMPANY))))
        & ~((tp["period"] == "Unknown") & (tp["basis"] == "unknown"))
        & F.coalesce(P.period_key(tp["period"]) > P.period_key(source_period), F.lit(True))
    )


def extract_promises(chunks: DataFrame, words=L.PROMISE_METRICS, verifiable: Sequence[str] = L.VERIFIABLE_METRICS) -> DataFrame:
    """Measurable promises, one row per promise id.

    Cheap gates run as filters; the expensive part is one expression per sentence
    with every intermediate bound once, so the optimiser has nothing to duplicate.
    The only shuffle is the final de-duplication on the id.
    """
    s = F.col("sentence")
    d = candidate_sentences(chunks).withColumn("metrics", metrics_of(s, words, verifiable)).filter(F.size("metrics") > 0)

    def assemble(x: Column) -> Column:
        t, m = x["t"], x["metric"]
        return P.let(F.struct(target_period(s, F.col("period")).alias("tp"), F.lower(s).alias("low")), lambda y: F.when(
            _passes(y["low"], t, m, y["tp"], F.col("period")),
            F.struct(
                y["tp"]["period"].alias("target_period"), y["tp"]["basis"].alias("target_period_basis"), m.alias("primary_metric"),
                t["raw"].alias("target"), t["low"].alias("target_low"), t["high"].alias("target_high"), t["unit"].alias("target_unit"), t["comparator"].alias("comparator"),
                F.when(m == "Debt", "down").when(_has(y["low"], HOLD), "maintain").otherwise("up").alias("direction"))))

    d = computed_once(d, {"p": P.let(best_target(s, words, verifiable), lambda x: F.when(x.isNotNull(), assemble(x)))}).filter("p is not null")
    out = d.select(
        promise_id(F.col("company"), F.col("source_file"), F.coalesce("speaker", F.lit("Management")), s, F.col("p.target")).alias("id"),
        "company", F.col("period").alias("source_period"), "doc_type", "speaker", "source_file", s.alias("text"), F.array_join("metrics", ",").alias("metrics"),
        "p.*", "sentence_no")
    return keep_first(out, ["id"], ["company", "source_file", "sentence_no"]).drop("sentence_no")


# ---- verification -------------------------------------------------------------------
# Scores per status, fixed values.
STATUS_WEIGHTS = {"EXCEEDED": 1.2, "KEPT": 1.0, "PARTIAL": 0.5, "BROKEN": -0.5}
STATUSES = ["EXCEEDED", "KEPT", "PARTIAL", "BROKEN", "PENDING"]


def choose_verification(p: DataFrame) -> DataFrame:
    """Fact metric, period type, kind and direction that can prove each promise."""
    m, low, u = F.col("primary_metric"), F.lower("text"), F.col("target_unit")
    pct = u.isin(PERCENT)
    quarter = _has(F.col("target_period"), r"(?i)\bQ[1-4]\s+FY") | (F.col("target_period") == "Unknown")
    de = F.contains(low, F.lit("debt-to-equity")) | F.contains(low, F.lit("debt equity")) | u.isin("x", "times")
    pick = lambda metric, kind, direction: F.struct(F.lit(metric).alias("metric"), F.lit(kind).alias("kind"), F.lit(direction).alias("dir"))
    v = (
        F.when((m == "Revenue") & pct, pick("revenue_growth", "percentage_growth", "up")).when(m == "Revenue", pick("revenue", "currency", "up"))
        .when((m == "EBITDA Margin") & (pct | F.contains(low, F.lit("margin"))), pick("opm", "percentage_level", "up")).when(m == "EBITDA Margin", pick("operating_profit", "currency", "up"))
        .when((m == "Net Profit") & pct, pick("net_profit_growth", "percentage_growth", "up")).when(m == "Net Profit", pick("net_profit", "currency", "up"))
        .when((m == "Debt") & de, pick("debt_to_equity", "ratio", "down")).when((m == "Debt") & _has(low, REPAY), pick("borrowings", "debt_reduction", "up"))
        .when(m == "Debt", pick("borrowings", "currency", "down"))
    )
    p = computed_once(p, {"v": v}).filter("v is not null")
    period_type = F.when((m != "Debt") & quarter, "quarterly").otherwise("annual")
    direction = F.when(F.col("v.kind") == "debt_reduction", "up").when(F.col("v.dir") == "down", "down").otherwise(F.coalesce("direction", F.col("v.dir")))
    return p.withColumns({"v_metric": F.col("v.metric"), "v_kind": F.col("v.kind"), "v_direction": direction, "period_type": period_type}).drop("v")


def classify(actual: Column, low: Column, high: Column, direction: Column, comparator: Column) -> Column:
    """EXCEEDED / KEPT / PARTIAL / BROKEN ladder for ceilings, ranges and floors."""
    cap = F.coalesce(high, low)
    ladder = lambda a, b, c: F.when(a, "EXCEEDED").when(b, "KEPT").when(c, "PARTIAL").otherwise("BROKEN")
    down = ladder(actual <= cap * 0.9, actual <= cap * 1.05, actual <= cap * 1.2)
    ranged = ladder(actual > high * 1.05, (actual >= low) & (actual <= high * 1.05), actual >= low * 0.85)
    ceiling = ladder(actual < low * 0.9, actual <= low * 1.05, actual <= low * 1.2)
    floor = ladder(actual >= low * 1.05, actual >= low * 0.95, actual >= low * 0.8)
    capped = any_hit(F.coalesce(comparator, F.lit("")), ["less than", "below", "under", "up to", "upto"])
    return F.when(direction == "down", down).when(high.isNotNull(), ranged).when(capped, ceiling).otherwise(floor)


def verify_promises(promises: DataFrame, facts: DataFrame) -> DataFrame:
    """Each promise against the reported figure for its period, window or base.

    ``facts`` is long (company, period_type, period, key, metric, value) where null
    values mark reported periods without a figure. One equi join on the series key
    brings the calendar-bounded series; exact, forward-window and backward
    look-ups are slices of it.
    """
    p = choose_verification(promises).withColumns({"target_key": P.period_key(F.col("target_period")), "source_key": P.period_key(F.col("source_period"))})
    pts = series(facts, ["company", "period_type", "metric"], "key", "value", "period").withColumnRenamed("metric", "v_metric")
    j = p.join(pts, ["company", "period_type", "v_metric"])
    def slices(x: Column) -> Column:
        """Best of the forward window, exact point and last prior point of a series."""
        up = F.array_max(F.transform(x["win"], lambda w: F.struct(w["v"].alias("v"), (-w["o"]).alias("o"), w["p"].alias("p"))))
        down = F.array_min(F.transform(x["win"], lambda w: F.struct(w["v"].alias("v"), w["o"].alias("o"), w["p"].alias("p"))))
        best = lambda f: F.when(F.col("v_direction") == "down", down[f]).otherwise(up[f])
        dated = F.col("target_key").isNotNull()
        exact = lambda f: F.get(x["exact"], F.lit(0))[f]
        return F.struct(
            F.when(dated, exact("v")).otherwise(best("v")).alias("ending"),
            F.when(dated, F.coalesce(exact("p"), F.col("target_period"))).otherwise(best("p")).alias("period"),
            F.when(dated, F.size(x["exact"]) == 0).otherwise(F.size(x["win"]) == 0).alias("pending"),
            F.when(F.col("v_kind") == "debt_reduction", F.try_element_at(x["prior"], F.lit(-1))["v"]).alias("base"),
            F.when(~dated, F.array_join(F.transform(x["win"], lambda w: w["p"]), ",")).alias("window"))

    src, tgt = F.col("source_key"), F.col("target_key")
    later = F.slice(F.filter("points", lambda x: (x["o"] > src) & x["v"].isNotNull()), F.lit(1), F.when(F.col("period_type") == "quarterly", 4).otherwise(2))
    parts = F.struct(F.filter("points", lambda x: x["o"] == tgt).alias("exact"), later.alias("win"), F.filter("points", lambda x: x["o"] <= src).alias("prior"))
    goal = F.struct(*[to_base_unit(F.col(f"target_{e}"), F.col("target_unit"), F.col("v_kind")).alias(e) for e in ("low", "high")])

    def judge(y: Column) -> Column:
        e, g = y["e"], y["g"]
        actual = F.when(F.col("v_kind") == "debt_reduction", e["base"] - e["ending"]).otherwise(e["ending"])
        return P.let(actual, lambda a: F.when(e["pending"] | (a.isNotNull() & g["low"].isNotNull()), F.struct(
            e["period"].alias("actual_period"), F.when(~e["pending"], a).alias("actual_value"), e["base"].alias("base_value"),
            g["low"].alias("low"), g["high"].alias("high"), e["pending"].alias("pending"), e["window"].alias("window_periods"),
            F.when(e["pending"], "PENDING").otherwise(classify(a, g["low"], g["high"], F.col("v_direction"), F.col("comparator"))).alias("status"))))

    j = computed_once(j, {"r": P.let(P.let(parts, slices), lambda e: judge(F.struct(e.alias("e"), goal.alias("g"))))}).filter("r is not null")
    money = lambda c: F.format_number(c, 2)
    last = F.try_element_at("points", F.lit(-1))["p"]
    rationale = F.when(F.col("r.pending"), F.concat(F.lit("Actual data only runs through "), last, F.lit("."))).otherwise(
        F.concat("v_metric", F.lit(" in "), "r.actual_period", F.lit(" was "), money(F.col("r.actual_value")), F.lit(" versus target "), money(F.col("r.low")), F.lit("; "), "r.status", F.lit(".")))
    return j.select(
        "id", "company", "primary_metric", "v_metric", "v_kind", "period_type", "source_period", "target_period", "r.actual_period", "r.actual_value", "r.base_value",
        F.col("r.low").alias("target_low"), F.col("r.high").alias("target_high"), "r.status",
        F.when(tgt.isNotNull(), "exact_period").otherwise("forward_window").alias("method"), "r.window_periods", rationale.alias("rationale"))


def status_rollup(verified: DataFrame) -> DataFrame:
    """Status counts, resolved count and fulfilment score per company and overall.

    Per-company counts come first; the overall row rolls those up.
    """
    counts = {s: F.count_if(F.col("status") == s).alias(s.lower()) for s in STATUSES}
    per = verified.groupBy("company").agg(F.count("*").alias("total"), *counts.values())
    both = per.rollup("company").agg(*[F.sum(c).alias(c) for c in ["total", *[s.lower() for s in STATUSES]]])
    resolved = F.col("total") - F.col("pending")
    raw = sum((F.col(s.lower()) * w for s, w in STATUS_WEIGHTS.items()), F.lit(0.0)) / resolved
    return both.select(
        F.coalesce("company", F.lit("ALL")).alias("company"), "total", *[s.lower() for s in STATUSES], resolved.alias("resolved"),
        F.when(resolved > 0, F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw * 100))).otherwise(50.0).alias("fulfilment"))
