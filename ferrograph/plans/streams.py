"""Streams over the supplied tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..streaming import outbox
from ..streaming.replay import replay_files
from ..tables import shared_dir, table
from .ordered import STATUS
from .registry import query


@query(f"""
select user_id, (event_id % 10)::int as step, case max(case {STATUS} when 'running' then 1 when 'completed' then 2 when 'failed' then 3 end) when 1 then 'running' when 2 then 'completed' when 3 then 'failed' end as status, count(*) as n_events
from events group by 1, 2""")
def trace_stream(spark, sf_dir):
    """The trace replayed as a stream of files."""
    return replay_files(spark, sf_dir, "events.parquet", "user_id", (F.col("event_id") % 10).cast("int"), F.expr(STATUS))


def receive(key: str, payload: str | None) -> None:
    """A receiver that takes no order of priority 5, and none that has no price."""
    if payload is None:
        raise ValueError("no payload")
    if payload.startswith("5"):
        raise ConnectionError("busy")


@query("""
select o_orderkey::varchar as idempotency_key, case when o_orderkey % 50 = 0 or o_orderpriority like '5%' then 'blocked' else 'sent' end as status, case when o_orderkey % 50 = 0 or o_orderpriority like '5%' then 3 else 1 end as attempts,
  case when o_orderkey % 50 = 0 then 'ValueError: no payload' when o_orderpriority like '5%' then 'ConnectionError: busy' end as error
from orders""")
def outbox_delivery(spark, sf_dir):
    """Orders delivered from a stream, failed ones tried twice more: what became of each."""
    payload = F.when(F.col("o_orderkey") % 50 != 0, F.concat_ws("|", "o_orderpriority", "o_totalprice"))
    entry = lambda df: df.select(F.col("o_orderkey").cast("string").alias("idempotency_key"), payload.alias("payload"))
    orders, at = table(spark, sf_dir, "orders"), f"{shared_dir(spark)}/outbox-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(orders.schema).option("pathGlobFilter", "orders.parquet").option("recursiveFileLookup", True).parquet(sf_dir)
    outbox.deliver(entry(stream), at, receive)
    outbox.retry(entry(orders), at, receive)
    return outbox.statuses(outbox.retry(entry(orders), at, receive))
