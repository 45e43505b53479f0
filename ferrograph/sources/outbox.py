"""An outbox as a table: entries by idempotency key, delivery in batches, a failed entry never stops the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.diffs import upsert
from ..operators.lookup import dispositions


def put(old: DataFrame, new: DataFrame) -> DataFrame:
    """Entries (idempotency_key, payload, status, attempts) with new ones put in by key, as pending."""
    fresh = new.select("idempotency_key", "payload", F.lit("pending").alias("status"), F.lit(0).alias("attempts"))
    return upsert(old, fresh, ["idempotency_key"]).drop("written")


def due(entries: DataFrame, cap: int = 3) -> DataFrame:
    return dispositions(entries, "status", "attempts", cap).where("disposition in ('eligible', 'retryable')")


def settle(entries: DataFrame, results: DataFrame) -> DataFrame:
    """Entries after a delivery: results (idempotency_key, ok) set sent or failed and count the attempt."""
    met = entries.join(results, "idempotency_key", "left")
    status = F.when(F.col("ok"), "sent").when(~F.col("ok"), "failed").otherwise(F.col("status"))
    return met.select("idempotency_key", "payload", status.alias("status"), (F.col("attempts") + F.col("ok").isNotNull().cast("int")).alias("attempts"))
