"""Wide financial statements: scan, trailing block, reshape to long facts and back."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import periods as P
from ..functions.values import parse_num
from ..operators.rows import computed_once

MARKER = "additional metrics"
# A bundle holds many statements: name, field mark, text, record mark.
RECORD, FIELD = "\u001e", "\u001f"
# Fixed row names of the statement export and the fact metric each one feeds.
STATEMENT_METRICS = {
    "Sales +": "revenue",
    "Expenses +": "expenses",
    "Operating Profit": "operating_profit",
    "OPM %": "opm",
    "Interest": "interest",
    "Net Profit +": "net_profit",
    "Borrowings +": "borrowings",
    "Equity Capital": "equity",
    "Total Assets": "total_assets",
}
BALANCE_SHEET_METRICS = ["borrowings", "equity", "total_assets"]


def _tidy(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, "[ ]", " "), "[​﻿]", ""))


def _cells(line: Column) -> Column:
    """CSV line to cells: commas inside double quotes do not split."""
    marked = F.regexp_replace(line, r',(?=(?:[^"]*"[^"]*")*[^"]*$)', "\u0001")
    return F.transform(F.split(marked, "\u0001"), lambda x: _tidy(F.regexp_replace(x, r'^\s*"|"\s*$', "")))


def _lines(spark: SparkSession, path: str, bundled: bool) -> DataFrame:
    """Numbered non-blank lines of every statement, tagged with the marker position.

    A statement is one small text and is split in the row that holds it: a file of its
    own, or one record of a bundle of many (:func:`sinks.write_statements`), which
    Spark's text reader splits over tasks.
    """
    if bundled:
        raw = spark.read.option("lineSep", RECORD).text(path).select(F.substring_index("value", FIELD, 1).alias("file"), F.expr(f"substring(value, instr(value, '{FIELD}') + 1)").alias("value"))
    else:
        raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    rows = raw.select("file", F.filter(F.transform(F.split("value", r"\r?\n"), _cells), lambda r: F.exists(r, lambda c: c != "")).alias("rows"))
    at = F.array_position(F.transform("rows", lambda r: F.lower(r[0]) == MARKER), F.lit(True)).cast("int")
    # the marker and the cells are read often below, the lines are cut once
    return computed_once(rows, {"marker": F.when(at > 0, at).otherwise(F.size("rows") + 1)})


def read_wide_financials(spark: SparkSession, path: str, bundled: bool = False) -> DataFrame:
    """(file, metric, period, cell) above the marker row; the first row names periods.

    ``file`` is the path of a statement's file, or its name in a bundle.
    """
    r = _lines(spark, path, bundled)
    header = F.col("rows")[0]
    body = F.slice("rows", F.lit(2), F.col("marker") - 2)
    one = r.select("file", header.alias("h"), F.explode(body).alias("c"))
    cell = F.posexplode(F.slice("h", F.lit(2), F.greatest(F.size("h") - 1, F.lit(0))))
    return (
        one.filter(F.col("c")[0] != "").select("file", F.col("c")[0].alias("metric"), "c", cell)
        .select("file", "metric", F.col("col").alias("period"), F.get("c", F.col("pos") + 1).alias("cell"))
        .filter("period <> ''")
    )


def read_additional_metrics(spark: SparkSession, path: str, bundled: bool = False) -> DataFrame:
    """Key/value rows below the marker as period ``LTM`` facts with snake-case names."""
    r = _lines(spark, path, bundled)
    tail = F.slice("rows", F.col("marker") + 1, F.greatest(F.size("rows") - F.col("marker"), F.lit(0)))
    kv = r.select("file", F.explode(tail).alias("c")).filter(F.col("c")[0] != "")
    name = F.regexp_replace(F.regexp_replace(F.lower(F.col("c")[0]), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return kv.select("file", name.alias("metric"), F.lit("LTM").alias("period"), parse_num(F.get("c", F.lit(1))).alias("value"))


def melt_statement(
    wide: DataFrame,
    id_cols: Sequence[str],
    metric_col: str,
    metric_map: Mapping[str, str] = STATEMENT_METRICS,
    annual_balance_sheet: bool = True,
) -> DataFrame:
    """Period columns to rows, metric renamed, cells parsed.

    ``TTM`` is skipped, unmapped rows are dropped, and with
    ``annual_balance_sheet`` balance-sheet metrics keep only ``Mar`` columns.
    """
    cols = [c for c in wide.columns if c not in id_cols and c != metric_col and c.upper() != "TTM"]
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("cell")) for c in cols])
    mapping = F.create_map(*[F.lit(x) for kv in metric_map.items() for x in kv])
    long = wide.select(*id_cols, mapping[F.col(metric_col)].alias("metric"), F.inline(cells)).filter("metric is not null")
    if annual_balance_sheet:
        long = long.filter(~F.col("metric").isin(BALANCE_SHEET_METRICS) | F.startswith("column", F.lit("Mar")))
    return long.select(*id_cols, "metric", P.column_label_to_fiscal(F.col("column")).alias("period"), parse_num(F.col("cell")).alias("value")).filter("value is not null")


def pivot_metrics(facts: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """One row per key and period, one column per metric (names given, so no extra pass)."""
    return facts.groupBy(*keys).pivot("metric", list(metrics)).agg(F.first("value"))


def year_columns(facts: DataFrame, period: str = "period", year: str = "fy") -> dict[str, str]:
    """Statement column of every fiscal year that the facts have, in order."""
    years = facts.select(F.col(year).cast("int").alias("y"), F.col(period).alias("p")).distinct().collect()  # one row a year
    return {r.p: f"Mar {r.y}" for r in sorted(years, key=lambda r: r.y)}


def statement_table(facts: DataFrame, columns: Mapping[str, str], names: Mapping[str, str] = STATEMENT_METRICS) -> DataFrame:
    """Long facts to the wide statement form: metric rows, one column per period label.

    ``columns`` maps a fact period to its statement column (``FY97`` -> ``Mar 1997``).
    """
    back = {v: k for k, v in names.items()}
    label = F.create_map(*[F.lit(x) for kv in back.items() for x in kv])[F.col("metric")]
    column = F.create_map(*[F.lit(x) for kv in columns.items() for x in kv])[F.col("period")]
    f = facts.select("company_id", label.alias("row"), column.alias("column"), "value").filter("row is not null and column is not null")
    return f.groupBy("company_id", "row").pivot("column", list(columns.values())).agg(F.first("value"))
