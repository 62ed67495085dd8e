"""Fiscal calendar algebra as column expressions (April to March years).

Labels come in four grammars: ``FY25`` / ``FY 2025``, ``Q2 FY24`` / ``Q2FY24``,
``H1 FY25`` and ``Mar 2025`` / ``2025_Mar``. All of them reduce to one sortable
integer, ``year * 12 + month`` of the last month covered, so no operator ever
sorts label text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]


def fiscal_year(date: Column) -> Column:
    return (F.year(date) + F.when(F.month(date) >= 4, 1).otherwise(0)).cast("int")


def fiscal_quarter(date: Column) -> Column:
    return (F.floor(((F.month(date) + 8) % 12) / 3) + 1).cast("int")


def full_year(two_digits: Column) -> Column:
    """``24`` -> 2024 and ``97`` -> 1997: the century is chosen around 2000."""
    return (two_digits.cast("int") + 50) % 100 + 1950


def fy_label(fy: Column) -> Column:
    return F.concat(F.lit("FY"), F.lpad((fy % 100).cast("string"), 2, "0"))


def quarter_label(fy: Column, q: Column) -> Column:
    return F.concat(F.lit("Q"), q.cast("string"), F.lit(" "), fy_label(fy))


def month_number(name: Column) -> Column:
    """Three-letter month name to 1..12, null when unknown."""
    pos = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.substring(name, 1, 3)))
    return F.nullif(pos.cast("int"), F.lit(0))


def month_name(number: Column) -> Column:
    return F.initcap(F.element_at(F.array(*[F.lit(m) for m in MONTHS]), number.cast("int")))


_FY = r"(?i)FY\s*'?(?:19|20)?(\d{2})(?!\d)"
_MONTH = r"(?i)(?:^|[^a-z])(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"
_YEAR = r"((?:19|20)\d{2})"


def _digits(c: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def label_fy(label: Column) -> Column:
    """Fiscal year named by a label in any grammar, else null."""
    return F.ceil((period_key(label) - 3) / 12).cast("int")


def period_key(label: Column) -> Column:
    """Sortable ``year*12 + month`` of the last month a label covers, else null.

    Written so that every pattern is evaluated once per row.
    """
    back = F.coalesce(
        _digits(label, r"(?i)Q([1-4])\s*FY", 1).cast("int") * 3 - 12,
        _digits(label, r"(?i)H([12])\s*FY", 1).cast("int") * 6 - 12,
        F.lit(0),
    )
    fiscal = full_year(_digits(label, _FY, 1)) * 12 + 3 + back
    calendar = _digits(label, _YEAR, 1).cast("int") * 12 + month_number(_digits(label, _MONTH, 1))
    return F.coalesce(fiscal, calendar).cast("int")


def key_to_column_label(key: Column) -> Column:
    """Period key back to a statement column label: ``24291`` -> ``Mar 2024``."""
    month = ((key - 1) % 12) + 1
    year = F.floor((key - month) / 12).cast("int")
    return F.concat(month_name(month), F.lit(" "), year.cast("string"))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once however often it is used."""
    return F.transform(F.array(value), body)[0]


def _column_key(label: Column) -> Column:
    month = month_number(F.substring_index(label, " ", 1))
    return _digits(label, _YEAR, 1).cast("int") * 12 + month


def _fiscal_of_key(k: Column, label: Column, half: bool) -> Column:
    m = (k - 1) % 12 + 1
    fy = F.ceil((k - 3) / 12).cast("int")
    q = F.floor(((m + 8) % 12) / 3).cast("int") + 1
    out = F.when(k.isNull(), label).when(m == 3, fy_label(fy))
    if half:
        out = out.when(m == 9, F.concat(F.lit("H1 "), fy_label(fy)))
    return out.otherwise(quarter_label(fy, q))


def column_label_to_fiscal(label: Column) -> Column:
    """``Mar 2025`` -> ``FY25``, ``Dec 2024`` -> ``Q3 FY25``; other text unchanged."""
    return let(_column_key(label), lambda k: _fiscal_of_key(k, label, False))


def half_year_label(label: Column) -> Column:
    """Interim balance-sheet columns: ``Sep 2024`` -> ``H1 FY25``, ``Mar`` -> year."""
    return let(_column_key(label), lambda k: _fiscal_of_key(k, label, True))


def normalise_period(label: Column, compat: bool = False) -> Column:
    """Join form of a label: upper case, no blanks, two-digit year.

    ``compat=True`` keeps the older text rule that also eats the year of
    ``FY20`` and of ``FY 2020`` (both become ``FY``).
    """
    up = F.upper(F.trim(F.coalesce(label, F.lit(""))))
    if compat:
        return F.replace(F.replace(F.replace(up, F.lit("FY 20"), F.lit("FY")), F.lit("FY20"), F.lit("FY")), F.lit(" "), F.lit(""))
    return F.regexp_replace(F.regexp_replace(up, r"\s+", ""), r"FY'?(?:19|20)?(\d{2})$", "FY$1")


def call_month_to_quarter(year: Column, month: Column) -> Column:
    """Month of an earnings call to the quarter it reports (the one just closed)."""
    q = (F.floor(((month + 8) % 12) / 3) + 1).cast("int")
    fy = year + F.when(month >= 4, 1).otherwise(0)
    prev_q = F.when(q == 1, 4).otherwise(q - 1)
    prev_fy = F.when(q == 1, fy - 1).otherwise(fy)
    return quarter_label(prev_fy, prev_q)
