"""Replay of event traces into the state of runs, in batches and as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Which status of a step beats which.
PRECEDENCE = {"planned": 0, "running": 1, "completed": 2, "failed": 3}


def step_status(events: DataFrame, run: str, step: str, status: Column) -> DataFrame:
    """Per run and step the status that beats all others: failed, completed, running, planned."""
    rank = F.coalesce(*[F.when(status == s, F.lit(k)) for s, k in PRECEDENCE.items()])
    name = F.create_map(*[F.lit(x) for s, k in PRECEDENCE.items() for x in (k, s)])
    return events.groupBy(run, step).agg(F.max(rank).alias("r")).select(run, step, name[F.col("r")].alias("status"))


def replay(events: DataFrame, run: str, step: str, status: Column, at: str, key: str) -> DataFrame:
    """Per run: n_events, n_steps, completed, failed, unknown (no known status), first and last event, run_status."""
    seen = events.withColumn("__s", status)
    steps = step_status(seen.where(F.col("__s").isNotNull()), run, step, F.col("__s")).groupBy(run).agg(F.count("*").alias("n_steps"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"))
    totals = seen.groupBy(run).agg(F.count("*").alias("n_events"), F.count_if(F.col("__s").isNull()).alias("unknown"), F.min_by(key, F.struct(at, key)).alias("first_event"), F.max_by(key, F.struct(at, key)).alias("last_event"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    out = totals.join(steps, run, "left").select(run, "n_events", zero("n_steps"), zero("completed"), zero("failed"), "unknown", "first_event", "last_event")
    return out.withColumn("run_status", F.when(F.col("failed") > 0, "failed").when((F.col("completed") == F.col("n_steps")) & (F.col("n_steps") > 0), "completed").otherwise("running"))


def order_violations(steps: DataFrame, run: str, position: str, done_at: str) -> DataFrame:
    """Steps done although the one before in the plan was not done earlier: run, position, done_at, before_at."""
    w = Window.partitionBy(run).orderBy(position)
    seen = steps.withColumn("before_at", F.lag(done_at).over(w)).withColumn("__n", F.row_number().over(w))
    return seen.where(F.col(done_at).isNotNull() & (F.col("__n") > 1) & (F.col("before_at").isNull() | (F.col("before_at") > F.col(done_at)))).select(run, position, done_at, "before_at")
