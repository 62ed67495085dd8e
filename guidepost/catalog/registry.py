"""Registry of queries and of the SQL that states the same result.

``VIEWS`` holds named SQL views; ``with_views`` prepends the ones a statement
uses (and whatever those use) as common table expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
VIEWS: dict[str, str] = {}

_WORD = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def view(name: str, sql: str) -> None:
    VIEWS[name] = sql.strip()


def _needed(sql: str, seen: list[str]) -> None:
    for word in dict.fromkeys(_WORD.findall(sql)):
        if word in VIEWS and word not in seen:
            _needed(VIEWS[word], seen)
            if word not in seen:
                seen.append(word)


def with_views(sql: str) -> str:
    names: list[str] = []
    _needed(sql, names)
    body = sql.strip()
    parts = [f"{n} AS MATERIALIZED ({VIEWS[n]})" for n in names]
    if body[:5].upper() == "WITH ":
        return "WITH RECURSIVE " + ", ".join(parts + [body[5:]])
    return ("WITH RECURSIVE " + ", ".join(parts) + " " + body) if parts else body


def query(name: str, sql: str | None = None, rounds: str = "", digits: int = 6):
    """Register ``fn(spark, sf_dir)`` under ``name``; ``sql`` is its twin.

    ``rounds`` names the double columns that both sides round the same way, for
    results whose last bits depend on summation order. A small shift moves the
    rounding boundaries off exact decimal ties, where those last bits would decide.
    """
    cols = rounds.split()
    shift = 2137 * 10.0 ** (-digits - 4)

    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(spark, sf_dir)
            if cols:
                df = df.withColumns({c: F.round(F.col(c) + F.lit(shift), digits) + F.lit(0.0) for c in cols})
            return df

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            text = with_views(sql)
            if cols:
                rep = ", ".join(f"round({c} + {shift!r}::DOUBLE, {digits}) + 0.0::DOUBLE AS {c}" for c in cols)
                text = f"SELECT * REPLACE ({rep}) FROM ({text})"
            ORACLES[name] = text
        return fn

    return wrap
