"""Rules on rows: eligibility, governance, failure signals, preflight checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import present


def eligibility(rows: DataFrame, warnings: Column, errors: Column, text: Column) -> DataFrame:
    """rows with rag_eligible, sft_eligible, review_required, confidence (1 - .02 a warning - .1 an error, 0 at least), reasons."""
    confidence = F.round(F.greatest(F.lit(0.0), F.lit(1.0) - warnings * 0.02 - errors * 0.1), 4)
    blank = F.coalesce(F.trim(text) == "", F.lit(True))
    reasons = present(("has_errors", errors > 0), ("blank_text", blank), ("many_warnings", warnings >= 5))
    return rows.withColumns({"rag_eligible": ~blank, "sft_eligible": ~blank & (errors == 0), "review_required": (errors > 0) | (warnings >= 5), "confidence": confidence, "reasons": F.array_join(reasons, "+")})


def failure_signals(rows: DataFrame, limits: list[tuple[str, Column]]) -> DataFrame:
    """rows with the names of limits they break, joined by +, those without any left out."""
    return rows.withColumn("signals", F.array_join(present(*limits), "+")).where("signals <> ''")


def out_of_range(values: DataFrame, ranges: DataFrame, on: str, value: str) -> DataFrame:
    """values below or above the range (on, low, high) of their key, with `issue`."""
    met = values.join(ranges, on)
    issue = F.when(F.col(value) < F.col("low"), "below").when(F.col(value) > F.col("high"), "above")
    return met.withColumn("issue", issue).where("issue is not null")


def common_value(rows: DataFrame, group: str, fields: list[str]) -> DataFrame:
    """Per group the value of each field that all its rows share, else null."""
    return rows.groupBy(group).agg(F.count("*").alias("n"), *[F.when(F.min(f).eqNullSafe(F.max(f)), F.min(f)).alias(f) for f in fields])
