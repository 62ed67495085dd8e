"""Keyed upsert, partition replace, append-new, JSON export and the document registry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .statements import FIELD, RECORD


def upsert(target: DataFrame, updates: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Target rows with the rows of ``updates`` put in by key.

    With ``order`` the newest row of a key wins, be it an update or the stored one, so
    updates may come late; on a tie an update replaces. Without it an update always
    replaces. Only keys that are updated meet in the joins; new columns of the updates
    become nulls on old rows.
    """
    keys = list(keys)
    fresh = updates
    if order:
        rest = [c for c in updates.columns if c not in keys]
        fresh = updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__r")).select(*keys, "__r.*").select(*updates.columns)
        stored = target.select(*keys, F.struct(*[F.col(c) for c in order]).alias("__stored"))
        late = F.coalesce(F.col("__stored") > F.struct(*order), F.lit(False))
        fresh = fresh.join(stored, keys, "left").where(~late).select(*updates.columns)
    return target.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh, allowMissingColumns=True)


def append_new(target: DataFrame, updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Target plus the update rows whose key it does not hold yet."""
    return target.unionByName(updates.join(target.select(*keys), list(keys), "left_anti"), allowMissingColumns=True)


def replace_partitions(df: DataFrame, path: str, part_col: str | Sequence[str]) -> None:
    """Rewrite exactly the partitions present in ``df``; all others stay as they are."""
    cols = [part_col] if isinstance(part_col, str) else list(part_col)
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*cols).parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object per line, written by the tasks that hold the rows."""
    df.write.mode("overwrite").json(path)


def write_statements(lines: DataFrame, path: str, company: str = "company_id", order: str = "line_no", line: str = "line", bundled: bool = False) -> None:
    """Statement CSV per company, lines in order; a statement is a bounded text.

    Each is a file in a folder of its company, or with ``bundled`` a record of one of a
    few files, under the name that its file would have: thousands of companies need
    neither thousands of files nor a listing of them.
    """
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, line))), lambda x: x[line]), "\n")
    statements = lines.groupBy(company).agg(body.alias("value"))
    if bundled:
        name = F.concat(F.lit(f"{company}="), F.col(company).cast("string"), F.lit("/statement.csv"))
        statements.select(F.concat(name, F.lit(FIELD), "value").alias("value")).write.mode("overwrite").option("lineSep", RECORD).text(path)
    else:
        statements.write.mode("overwrite").partitionBy(company).text(path)


def document_registry(docs: DataFrame, chunks: DataFrame, claims: DataFrame, risks: DataFrame) -> DataFrame:
    """One row per (company, document) with counts of what was found and a status."""
    keys = ["company_id", "document"]
    out = docs
    for name, t in (("n_chunks", chunks), ("n_claims", claims), ("n_risks", risks)):
        out = out.join(t.groupBy(*keys).agg(F.count("*").alias(name)), keys, "left")
    out = out.na.fill(0, ["n_chunks", "n_claims", "n_risks"])
    status = F.when(F.col("n_claims") + F.col("n_risks") > 0, "extracted").when(F.col("n_chunks") > 0, "chunked").otherwise("registered")
    return out.withColumn("status", status)
