"""Paged documents, transcripts, web pages, links and extracted items."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import periods as P
from ..functions.values import clean_text, normalize_whitespace, recover_json_array
from ..operators.rows import computed_once
from ..operators.text import is_useful, words_of

DOCUMENT_SCHEMA = (
    "source_file string, company_id string, document_type string, period string, total_pages int, total_paragraphs int, "
    "pages array<struct<page_number:int,paragraphs:array<string>>>"
)
TURN_SCHEMA = "speaker string, text string"
ITEM_FIELDS = [
    "table", "company_id", "source_document", "source_page", "period", "metric", "value", "unit", "yoy_change", "period_type", "period_label",
    "statement_quarter", "target_period", "metric_type", "guidance_value_low", "guidance_value_high", "guidance_value_point", "verbatim_quote",
    "confidence_language", "speaker", "check_type", "source_timestamp", "category", "subcategory", "description", "severity",
    "rating_agency", "rating_scale", "rating_outlook", "instrument", "rating_date", "rating_amount_crores", "previous_rating", "watch_status", "rationale",
    "data_type", "key_name", "value_text", "value_numeric", "context",
]
# Fixed spellings of the target-table tag.
TABLE_ALIASES = {
    "HOTEL_OPS_METRIC": "financials", "hotel_ops_metric": "financials", "FINANCIAL_METRIC": "financials", "financial_metric": "financials",
    "GUIDANCE_CLAIM": "guidance_claims", "guidance_claim": "guidance_claims", "RISK_FLAG": "risk_flags", "risk_flag": "risk_flags",
    "CREDIT_RATING": "credit_ratings", "credit_rating": "credit_ratings", "RAW_DATA": "raw_data",
}


def read_documents_json(spark: SparkSession, path: str) -> DataFrame:
    """Paged-document JSON (one object or an array per file) to citable paragraphs."""
    docs = spark.read.schema(DOCUMENT_SCHEMA).option("multiLine", True).json(path)
    return flatten_documents(docs)


def flatten_documents(docs: DataFrame, min_words: int = 5) -> DataFrame:
    """doc -> pages -> paragraphs, cleaned, useful paragraphs only."""
    keep = [c for c in docs.columns if c != "pages"]
    pages = docs.select(*keep, F.inline("pages"))
    paras = pages.select(*keep, "page_number", F.posexplode("paragraphs").alias("paragraph_no", "raw"))
    return computed_once(paras, {"text": clean_text(F.col("raw"))}).filter(is_useful(F.col("text"), min_words)).drop("raw")


def read_transcripts_json(spark: SparkSession, path: str, min_words: int = 8, extra: str = "", multi_line: bool = True) -> DataFrame:
    """Transcript JSON, an array of turns to a file or (not ``multi_line``) a turn to a
    line: period from the name of the file or of its folder, short turns dropped.

    ``extra`` names further fields of a turn, as a schema string.
    """
    schema = f"{TURN_SCHEMA}, {extra}" if extra else TURN_SCHEMA
    t = spark.read.schema(schema).option("multiLine", multi_line).option("recursiveFileLookup", True).json(path)
    t = t.select("*", F.regexp_extract("_metadata.file_path", r"(\d{4}_[A-Za-z]{3})(?:\.json|/[^/]*)$", 1).alias("file"))
    return transcript_turns(t, min_words)


def transcript_turns(turns: DataFrame, min_words: int = 8) -> DataFrame:
    stem = F.regexp_replace("file", r"\.json$", "")
    month, year = F.substring_index(stem, "_", -1), F.substring_index(stem, "_", 1)
    t = computed_once(turns, {"text": clean_text(F.col("text")), "period": F.concat(month, F.lit(" "), year)})
    t = t.withColumn("reported_quarter", P.call_month_to_quarter(year.try_cast("int"), P.month_number(month)))
    return t.filter(F.size(words_of(F.col("text"))) >= min_words)


# Fixed document-type words looked for in a path.
DOC_TYPES = [("annual", "annual_report"), ("transcript", "call_transcript"), ("call", "call_transcript"), ("quarter", "quarterly_results"), ("rating", "credit_rating"), ("announcement", "announcement")]


def file_meta(files: DataFrame, folder_map: Mapping[str, str], path: str = "path") -> DataFrame:
    """Company from the folder, type and period from the name; unmapped folders stay visible."""
    parts = F.split(F.col(path), "/")
    folder, name = F.element_at(parts, -3), F.element_at(parts, -1)
    low = F.lower(F.col(path))
    kind = F.coalesce(*[F.when(F.contains(low, F.lit(w)), F.lit(k)) for w, k in DOC_TYPES], F.lit("other"))
    mapping = F.create_map(*[F.lit(x) for kv in folder_map.items() for x in kv])
    stem = F.regexp_replace(name, r"\.[A-Za-z]+$", "")
    period = F.coalesce(
        F.nullif(F.regexp_extract(stem, r"(?i)(Q[1-4]\s*_?FY\s*\d{2,4})", 1), F.lit("")),
        F.when(F.rlike(stem, F.lit(r"^\d{4}$")), F.concat(F.lit("FY"), F.substring(stem, 3, 2))),
        F.when(F.rlike(stem, F.lit(r"^\d{4}_[A-Za-z]{3}")), F.concat(F.substring(stem, 6, 3), F.lit(" "), F.substring(stem, 1, 4))),
        F.when(F.rlike(stem, F.lit(r"^[A-Za-z]{3}_\d{4}$")), F.replace(stem, F.lit("_"), F.lit(" "))),
    )
    return files.withColumns({"company_id": F.coalesce(F.try_element_at(mapping, folder), F.lit("UNMAPPED")), "doc_type": kind, "period": period, "file_name": name})


def load_entity_dirs(spark: SparkSession, root: str, folder_map: Mapping[str, str], whole: bool = True) -> DataFrame:
    """Every file below ``root/<folder>/<kind>/`` with its text and derived keys.

    A row is a whole file or, without ``whole``, a line of one, so that many small
    documents can share a file. Folders that a partitioned write named ``key=value``
    count by their value, and stand for the file where they hold part files. Empty files
    give no row.
    """
    raw = spark.read.text(root, wholetext=whole, recursiveFileLookup=True).select("value", F.col("_metadata.file_path").alias("path"))
    parted = F.rlike("path", F.lit(r"=[^/]*/[^/]*$"))
    inside = F.regexp_replace(F.regexp_replace("path", r"/[^/]*$", ""), r"/[^/=]+=", "/")
    return file_meta(raw.withColumn("path", F.when(parted, inside).otherwise(F.col("path"))), folder_map)


def page_title(html: Column) -> Column:
    return normalize_whitespace(unescape(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)))


def unescape(text: Column) -> Column:
    out = text
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return out


def visible_text(html: Column, n: int | None = None) -> Column:
    """Tags, scripts, styles and comments out, entities decoded, blanks folded."""
    t = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"(?s)<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    t = normalize_whitespace(unescape(t))
    return F.substring(t, 1, n) if n else t


def pages_text(df: DataFrame, html: str = "html", n: int | None = None) -> DataFrame:
    return df.withColumns({"title": page_title(F.col(html)), "page_text": visible_text(F.col(html), n)})


def extract_links(df: DataFrame, html: str, url: str, keywords: Sequence[str], max_links: int | None = None, min_len: int = 25) -> DataFrame:
    """Anchors, all or the first ``max_links``, whose text is long enough and names a keyword."""
    anchors = F.regexp_extract_all(F.col(html), F.lit(r"(?is)(<a\s[^>]*href=\"[^\"]*\"[^>]*>.*?</a>)"), F.lit(1))
    anchors = anchors if max_links is None else F.slice(anchors, 1, max_links)
    one = df.select(*[c for c in df.columns if c != html], F.posexplode(anchors).alias("link_no", "a"))
    href = F.trim(F.regexp_extract("a", r"(?is)href=\"([^\"]*)\"", 1))
    text = normalize_whitespace(unescape(F.regexp_replace("a", r"(?s)<[^>]*>", " ")))
    root = F.regexp_extract(F.col(url), r"^(https?://[^/?#]+)", 1)
    one = computed_once(one, {"link_text": text, "href": F.when(F.startswith(href, F.lit("/")), F.concat(root, href)).otherwise(href)}).drop("a")
    gate = F.lit(False) if keywords else F.lit(True)
    for k in keywords:
        gate = gate | F.contains(F.lower("link_text"), F.lit(k))
    return one.filter((F.length("link_text") >= min_len) & gate).withColumn("host", F.regexp_extract(F.col(url), r"^https?://([^/?#]+)", 1))


def parse_items(df: DataFrame, text: str, keep: Sequence[str]) -> DataFrame:
    """Noisy model output to one row per extracted item; bad JSON gives no rows."""
    schema = "array<struct<" + ",".join(f"`{f}`:string" for f in ITEM_FIELDS) + ">>"
    items = F.from_json(recover_json_array(F.col(text)), schema, {"mode": "PERMISSIVE"})
    return df.select(*keep, F.posexplode(items).alias("item_no", "i")).select(*keep, "item_no", "i.*")


ROUTES = {
    # table: (required field, numeric fields, defaults)
    "financials": ("value", ["value", "yoy_change"], {"metric": "unknown", "period_type": "annual"}),
    "guidance_claims": ("verbatim_quote", ["guidance_value_low", "guidance_value_high", "guidance_value_point"], {"metric_type": "other"}),
    "risk_flags": ("description", [], {"category": "operational", "severity": "medium"}),
    "credit_ratings": ("rating_agency", ["rating_amount_crores"], {}),
    "raw_data": ("value_text", ["value_numeric"], {"data_type": "qualitative", "category": "other"}),
}


def judge_items(items: DataFrame) -> DataFrame:
    """Every item with its ``route``, the reason it is refused for (null: accepted), its
    numbers parsed and its defaults filled in, in one projection.

    Each number belongs to one table and stays null in rows of the others.
    """
    alias = F.create_map(*[F.lit(x) for kv in TABLE_ALIASES.items() for x in kv])
    tagged = items.withColumn("route", F.coalesce(F.try_element_at(alias, F.col("table")), F.col("table")))
    route = F.col("route")
    ok = F.lit(False)
    for name, (need, nums, _) in ROUTES.items():
        filled = F.col(need).try_cast("double").isNotNull() if need in nums else F.trim(F.coalesce(F.col(need), F.lit(""))) != ""
        ok = F.when(route == name, filled).otherwise(ok)
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    reason = (
        F.when(route.isNull() | ~route.isin(list(ROUTES)), "unknown_table")
        .when(blank("company_id") | blank("source_document"), "missing_source")
        .when(~ok, "missing_required")
    )
    filled = {}
    for name, (_, nums, defaults) in ROUTES.items():
        for n in nums:
            filled[n] = F.when(route == name, F.col(n).try_cast("double"))
        for d, v in defaults.items():
            filled[d] = F.when((route == name) & F.col(d).isNull(), F.lit(v)).otherwise(filled.get(d, F.col(d)))
    for name, d in (("financials", "period_label"), ("guidance_claims", "statement_quarter")):
        filled[d] = F.when((route == name) & F.col(d).isNull(), F.col("period")).otherwise(F.col(d))
    return tagged.withColumn("reject_reason", reason).withColumns(filled)


def route_items(items: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """(table -> typed rows, rejects with a reason) for items carrying a table tag.

    Each table is a filter on the judged items; to write them all in one pass over the
    items use :func:`write_routed`.
    """
    judged = judge_items(items)
    good = judged.filter("reject_reason is null")
    return {n: good.filter(F.col("route") == n).drop("table", "reject_reason") for n in ROUTES}, judged.filter("reject_reason is not null")


def write_routed(items: DataFrame, path: str) -> None:
    """All tables and the refused items below ``path``, a folder each, in one pass."""
    judged = judge_items(items).withColumnRenamed("table", "tag")
    folder = F.when(F.col("reject_reason").isNull(), F.col("route")).otherwise("rejected")
    judged.withColumn("target", folder).write.mode("overwrite").partitionBy("target").parquet(path)
