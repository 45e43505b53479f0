"""Traces replayed as they arrive: the state of each run's steps, kept by Structured Streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.trace import PRECEDENCE
from ..tables import shared_dir


def step_states(events: DataFrame, run: str, step: str, status: Column) -> DataFrame:
    """Streaming aggregate: per run and step the rank of the status that beats all others, and the number of events."""
    rank = F.coalesce(*[F.when(status == s, F.lit(k)) for s, k in PRECEDENCE.items()])
    return events.groupBy(run, step).agg(F.max(rank).alias("rank"), F.count("*").alias("n_events"))


def replay_files(spark: SparkSession, folder: str, pattern: str, run: str, step: Column, status: Column, at: str | None = None) -> DataFrame:
    """All files of a folder that match, read as a stream until none is left; the final states as a table.

    State and results are in a folder of their own for each call, so a lost executor costs tasks; another call begins anew,
    unless it is given the folder (`at`) of one that stopped, whose state it goes on from.
    """
    schema = spark.read.option("pathGlobFilter", pattern).parquet(folder).schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("recursiveFileLookup", True).parquet(folder).withColumn("step", step)
    at = at or f"{shared_dir(spark)}/replay-{uuid.uuid4().hex}"
    states = step_states(events, run, "step", status)
    write = lambda batch, _: batch.write.mode("overwrite").parquet(f"{at}/states")
    states.writeStream.outputMode("complete").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    name = F.create_map(*[F.lit(x) for s, k in PRECEDENCE.items() for x in (k, s)])
    return spark.read.parquet(f"{at}/states").select(run, "step", name[F.col("rank")].alias("status"), "n_events")
