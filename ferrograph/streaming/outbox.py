"""Delivery of an outbox as a stream: a ledger of batches, so that a repeated batch delivers nothing twice; rows fail one by one."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What the ledger has of each attempt.
LEDGER = "idempotency_key string, attempt int, ok boolean, error string"


def ledger(spark: SparkSession, at: str) -> DataFrame:
    """All attempts so far, with their batch: those of batches whose delivery was written down whole."""
    try:
        return spark.read.schema(f"{LEDGER}, batch bigint").parquet(f"{at}/ledger")
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], f"{LEDGER}, batch bigint")


def attempted(entries: DataFrame, send: Callable[[str, str | None], None]) -> DataFrame:
    """entries (idempotency_key, payload, attempt) sent one by one where they lie; an error of one is written down and stops no other."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            errors = []
            for key, payload in zip(pdf["idempotency_key"], pdf["payload"], strict=True):
                try:
                    send(key, payload)
                    errors.append(None)
                except Exception as error:
                    errors.append(f"{type(error).__name__}: {error}")
            yield pd.DataFrame({"idempotency_key": pdf["idempotency_key"], "attempt": pdf["attempt"], "ok": [e is None for e in errors], "error": errors})

    return entries.select("idempotency_key", "payload", "attempt").mapInPandas(run, LEDGER)


def written_down(results: DataFrame, at: str, batch: int) -> None:
    """The batch's results in the ledger; its folder appears only when all are there."""
    results.write.mode("overwrite").parquet(f"{at}/ledger/batch={batch}")


def delivered(batch: DataFrame, number: int, at: str, send: Callable[[str, str | None], None]) -> None:
    """Deliver a micro-batch once: nothing if the ledger has it, else its entries whose key has not been tried before, each key once."""
    spark = batch.sparkSession
    done = ledger(spark, at)
    if not done.where(F.col("batch") == number).isEmpty():
        return
    fresh = batch.where("idempotency_key is not null").groupBy("idempotency_key").agg(F.min("payload").alias("payload"), F.lit(1).alias("attempt"))
    results = attempted(fresh.join(done.select("idempotency_key").distinct(), "idempotency_key", "left_anti"), send)
    written_down(results, at, number)


def deliver(entries: DataFrame, at: str, send: Callable[[str, str | None], None], after_batch: Callable[[int], None] | None = None) -> DataFrame:
    """All entries of a stream (idempotency_key, payload) up to now, delivered once each: the ledger.

    The folder `at` holds the ledger and the stream's checkpoint. A call that was killed after a batch's results were written, but
    before the stream had committed it, meets the batch again and skips it. One killed while sending may send again what it
    had sent in that batch; receivers tell by the idempotency key. after_batch is called once a batch is written down.
    """

    def sink(batch: DataFrame, number: int) -> None:
        delivered(batch, number, at, send)
        if after_batch:
            after_batch(number)

    entries.writeStream.option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()
    return ledger(entries.sparkSession, at)


def retry(entries: DataFrame, at: str, send: Callable[[str, str | None], None], cap: int = 3) -> DataFrame:
    """One more attempt at every entry of a table (idempotency_key, payload) whose last one failed and that has had fewer than `cap`: the ledger.

    Attempts of one pass are a batch of their own, numbered below zero; a pass that was not written down is made again.
    """
    done = ledger(entries.sparkSession, at)
    last = done.groupBy("idempotency_key").agg(F.max(F.struct("attempt", "ok")).alias("last"))
    due = last.where(~F.col("last.ok") & (F.col("last.attempt") < cap)).select("idempotency_key", (F.col("last.attempt") + 1).alias("attempt"))
    number = (done.agg(F.min("batch")).first()[0] or 0) - 1
    written_down(attempted(entries.dropDuplicates(["idempotency_key"]).join(due, "idempotency_key"), send), at, min(number, -1))
    return ledger(entries.sparkSession, at)


def statuses(done: DataFrame, cap: int = 3) -> DataFrame:
    """Per entry its status (sent, failed, blocked once `cap` attempts have failed), attempts and last error."""
    last = done.groupBy("idempotency_key").agg(F.max(F.struct("attempt", "ok", "error")).alias("last"))
    status = F.when(F.col("last.ok"), "sent").when(F.col("last.attempt") >= cap, "blocked").otherwise("failed")
    return last.select("idempotency_key", status.alias("status"), F.col("last.attempt").alias("attempts"), F.when(~F.col("last.ok"), F.col("last.error")).alias("error"))
