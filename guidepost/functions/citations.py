"""Citation strings back to document, page and kind."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .periods import full_year

# Fixed document-name patterns, tried in this order.
KINDS = [
    ("statement_csv", r"(?i)(screener|profit_loss|balance_sheet)"),
    ("annual_report", r"(?i)^\d{4}\.pdf$"),
    ("transcript", r"(?i)^\d{4}_\w+\.json$"),
    ("quarterly_report", r"(?i)^[A-Za-z]{3}_\d{4}\.pdf$"),
    ("filing", r"(?i)^\d{4}_\w+_\d{2}\.pdf$"),
    ("annual_label", r"(?i)AR\s+FY\d{2}"),
    ("call_label", r"(?i)Q[1-4]\s+FY\d{2}\s+Earnings\s+Call"),
    ("quarterly_label", r"(?i)(Quarterly.*?Q[1-4]\s*FY\d{2}|Q[1-4]\s*FY\d{2}.*?Quarterly)"),
    ("bare_file", r"(?i)\.(pdf|json|txt|csv)$"),
]


def parse_citation(ref: Column) -> Column:
    """``struct<document,page,kind,period>`` of a bracketed or label citation."""
    t = F.trim(ref)
    inner = F.coalesce(F.nullif(F.regexp_extract(t, r"^\[(.+?)(?:\s*\|\s*.+)?\]$", 1), F.lit("")), t)
    doc = F.trim(inner)
    page = F.coalesce(
        F.nullif(F.regexp_extract(t, r"(?i)\|\s*p\.(\d+)", 1), F.lit("")),
        F.nullif(F.regexp_extract(t, r"(?i)Page\s+(\d+)", 1), F.lit("")),
    ).cast("int")
    kind = F.coalesce(*[F.when(F.rlike(doc, F.lit(p)), F.lit(k)) for k, p in KINDS], F.lit("unknown"))
    fy = full_year(F.nullif(F.regexp_extract(doc, r"(?i)FY(\d{2})", 1), F.lit("")))
    q = F.upper(F.regexp_extract(doc, r"(?i)(Q[1-4])\s*FY", 1))
    month = F.element_at(F.create_map(*[F.lit(x) for x in ("Q1", "Jun", "Q2", "Sep", "Q3", "Dec", "Q4", "Mar")]), q)
    document = (
        F.when(kind == "statement_csv", F.when(F.rlike(doc, F.lit("(?i)balance_sheet")), "balance_sheet.csv").otherwise("profit_loss.csv"))
        .when(kind == "annual_label", F.concat(fy.cast("string"), F.lit(".pdf")))
        .when(kind == "quarterly_label", F.concat(month, F.lit("_"), (fy - F.when(q == "Q4", 0).otherwise(1)).cast("string"), F.lit(".pdf")))
        .otherwise(doc)
    )
    return F.struct(document.alias("document"), page.alias("page"), kind.alias("kind"))
