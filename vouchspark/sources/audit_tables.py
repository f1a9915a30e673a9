"""Audit exports: the rows of a period and the CSV files they are handed over in."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def between_text(df: DataFrame, column: str, low: str | None, high: str | None) -> DataFrame:
    """Inclusive bounds compared as text: a bare date as upper bound leaves out that day."""
    if low is not None:
        df = df.filter(F.col(column) >= low)
    if high is not None:
        df = df.filter(F.col(column) <= high)
    return df


def audit_slice(
    runs: DataFrame, approvals: DataFrame, low: str | None, high: str | None
) -> tuple[DataFrame, DataFrame]:
    """Runs by start time and approvals by creation time, each ordered by (time, id)."""
    return (
        between_text(runs, "started_at", low, high).orderBy("started_at", "run_id"),
        between_text(approvals, "created_at", low, high).orderBy("created_at", "approval_id"),
    )


def union_columns(tables: list[DataFrame]) -> DataFrame:
    """Rows of all tables over the union of their columns, in first-seen order."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def write_audit(tables: dict[str, DataFrame], path: str) -> None:
    """One CSV folder per table, with header; NULL is written as an empty field."""
    for name, table in tables.items():
        table.write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(
            f"{path}/{name}"
        )
