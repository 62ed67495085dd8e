"""Number, unit, URL, key and text column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .periods import let

# Fixed unit multipliers to crore.
UNIT_TO_CRORE = {
    "crore": 1.0, "crores": 1.0, "cr": 1.0, "currency": 1.0, "": 1.0,
    "million": 0.1, "mn": 0.1, "billion": 100.0, "bn": 100.0, "lakh": 0.01, "lakhs": 0.01,
}
COUNT_UNITS = ["rooms", "keys", "hotels", "properties", "sqft", "square feet"]
PERCENT_UNITS = ["%", "percent", "percentage", "bps", "basis points"]


def parse_num(cell: Column) -> Column:
    """Statement cell to double: drops ``%`` and ``,``; blank, nan and none are null."""
    t = F.trim(F.regexp_replace(cell, "[%,]", ""))
    return F.when(F.lower(t).isin("", "nan", "none"), F.lit(None)).otherwise(t.try_cast("double"))


def to_base_unit(value: Column, unit: Column, kind: Column) -> Column:
    """Value on the scale of the metric ``kind``; null where the unit cannot apply."""
    u = F.lower(F.coalesce(unit, F.lit("")))
    mult = F.lit(None).cast("double")
    for name, m in UNIT_TO_CRORE.items():
        mult = F.when(u == name, m).otherwise(mult)
    return (
        F.when(u.isin(COUNT_UNITS), F.lit(None).cast("double"))
        .when(u.isin("bps", "basis points"), value / 100.0)
        .when(F.startswith(kind, F.lit("percentage")) | (kind == "ratio"), value)
        .when(kind.isin("currency", "debt_reduction"), value * mult)
    )


def unit_for_metric(metric: Column) -> Column:
    m = F.lower(metric)
    return F.when(F.contains(m, F.lit("%")) | m.isin("opm", "occupancy"), "%").when(m.isin("revpar", "adr"), "rupees").when(m == "icr", "x").otherwise("crore")


def normalize_whitespace(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def normalize_url(url: Column) -> Column:
    """Unwrap redirect links, drop ``utm_*``, fragment and a trailing slash, lower-case."""
    u = F.trim(F.coalesce(url, F.lit("")))
    redirect = F.coalesce(
        F.nullif(F.regexp_extract(u, r"(?i)^https?://(?:[^/?#]*\.)?google\.com/url\?(?:[^#]*&)?url=([^&#]+)", 1), F.lit("")),
        F.nullif(F.regexp_extract(u, r"(?i)^https?://(?:[^/?#]*\.)?google\.com/url\?(?:[^#]*&)?q=([^&#]+)", 1), F.lit("")),
    )
    u = F.coalesce(F.try_url_decode(redirect), u)
    u = F.regexp_replace(u, r"#.*$", "")
    base = F.regexp_extract(u, r"^([^?]*)", 1)
    args = F.filter(F.split(F.regexp_extract(u, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~F.startswith(F.lower(p), F.lit("utm_")))
    q = F.array_join(args, "&")
    out = F.concat(base, F.when(q != "", F.concat(F.lit("?"), q)).otherwise(F.lit("")))
    return F.lower(F.regexp_replace(out, "/$", ""))


def clean_text(c: Column) -> Column:
    """Drop control characters (newlines stay), NBSP to blank, fold runs of blanks."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")
    return F.regexp_replace(F.regexp_replace(F.replace(t, F.lit(" "), F.lit(" ")), " {2,}", " "), r"^\s+|\s+$", "")


def parse_date(c: Column, as_of: str) -> Column:
    """ISO date of a loosely written date; ``as_of`` when nothing matches."""
    t = F.trim(c)
    iso = F.try_to_date(F.substring(t, 1, 10), "yyyy-MM-dd")
    forms = [F.try_to_date(t, f) for f in ("dd MMM yyyy", "MMM dd, yyyy", "dd/MM/yyyy", "yyyy/MM/dd")]
    rss = F.try_to_date(F.regexp_extract(t, r"^\w{3}, (\d{2} \w{3} \d{4})", 1), "dd MMM yyyy")
    return F.date_format(F.coalesce(iso, *forms, rss, F.lit(as_of).cast("date")), "yyyy-MM-dd")


def item_key(url: Column, title: Column) -> Column:
    return F.sha1(F.concat(normalize_url(url), F.lit("|"), F.lower(normalize_whitespace(title))))


def _normalized_start(c: Column, n: int) -> Column:
    """``normalize_whitespace(c)``, or words from its start that are longer than ``n``
    characters: enough for what looks at ``n`` of them, without a pass over a long text."""
    head = normalize_whitespace(F.substring(c, 1, 8 * n))
    words = let(head, lambda h: h.substr(F.lit(1), F.length(h) - F.length(F.substring_index(h, " ", -1))))
    return let(words, lambda w: F.when(F.length(w) > n, w).otherwise(normalize_whitespace(c)))


def content_signature(title: Column, summary: Column, date: Column) -> Column:
    s = F.lower(_normalized_start(summary, 140))
    return F.sha1(F.concat(F.lower(normalize_whitespace(title)), F.lit("|"), F.substring(s, 1, 140), F.lit("|"), date))


def promise_id(company: Column, source: Column, speaker: Column, text: Column, target: Column) -> Column:
    body = F.concat_ws("|", company, source, speaker, F.substring(text, 1, 500), target)
    return F.concat(F.lit("promise_"), F.substring(F.sha1(body), 1, 12))


def short_summary(c: Column, n: int = 280) -> Column:
    return let(_normalized_start(c, n), lambda t: (
        F.when(t == "", "No summary available from source payload.").when(F.length(t) <= n, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, n - 3)), F.lit("...")))))


def first_words_snippet(c: Column, stop: list[str], n: int = 10) -> tuple[Column, Column]:
    """(``n`` words from the first non-stop word, informative words of that span)."""
    words = F.filter(F.split(normalize_whitespace(c), " "), lambda w: w != "")
    stops = F.array(*[F.lit(s) for s in stop])
    info = lambda w: ~F.array_contains(stops, F.lower(w))
    pos = F.array_position(F.transform(words, info), F.lit(True))
    span = F.slice(words, F.greatest(pos, F.lit(1)).cast("int"), F.lit(n))
    return F.array_join(span, " "), F.array_join(F.filter(span, lambda w: info(w) & (F.length(w) > 3)), " ")


def recover_json_array(c: Column) -> Column:
    """Text between the first ``[`` and the last ``]`` once code fences are stripped."""
    t = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"```(?:json)?\s*", ""), r"```\s*", ""))
    return F.nullif(F.regexp_extract(t, r"(?s)(\[.*\])", 1), F.lit(""))
