"""Series, traces and as-of lookups over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import series, trace
from ..tables import table
from .registry import query


@query("select * exclude (n) from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as n from orders) where n = 1")
def latest_per_key(spark, sf_dir):
    return series.latest(table(spark, sf_dir, "orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")])


@query("select o_orderkey, o_custkey, o_totalprice, (row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey))::int as place from orders")
def best_and_rank(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return series.ranked(rows, "o_custkey", "o_totalprice", ["o_orderkey"])


@query("""
with t as (select o_custkey, count(*) as n, max(o_totalprice) as best, arg_min(o_totalprice, (o_orderdate, o_orderkey)) as "first", arg_max(o_totalprice, (o_orderdate, o_orderkey)) as "last", min((o_totalprice > 0)::int) as e from orders group by 1 having count(*) >= 2)
select o_custkey, n, best, "first", "last", concat_ws('+', case when "last" > "first" then 'improved' end, case when best > "last" then 'peaked_before_end' end, case when e = 1 then 'all_positive' end, case when n >= 10 then 'long' end) as labels from t""")
def trajectories(spark, sf_dir):
    """How each customer's order values went, with labels."""
    rows = table(spark, sf_dir, "orders").withColumn("at", F.struct("o_orderdate", "o_orderkey"))
    return series.trajectories(rows, "o_custkey", "o_totalprice", "at")


@query("""
with f as (select *, first_value(o_orderstatus) over w as s0, first_value(o_orderpriority) over w as p0 from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey))
select o_orderkey, o_custkey, concat_ws('+', case when o_orderstatus is distinct from s0 then 'o_orderstatus' end, case when o_orderpriority is distinct from p0 then 'o_orderpriority' end) as changed,
  concat_ws('+', case when o_orderstatus is not distinct from s0 then 'o_orderstatus' end, case when o_orderpriority is not distinct from p0 then 'o_orderpriority' end) as controlled from f""")
def baseline_delta(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "o_orderpriority")
    return series.against_baseline(rows, "o_custkey", ["o_orderdate", "o_orderkey"], ["o_orderstatus", "o_orderpriority"]).select("o_orderkey", "o_custkey", "changed", "controlled")


@query("select * from (select conv_id, role || '#' || turn as from_node, lead(role || '#' || turn) over (partition by conv_id order by turn) as to_node from conversations) where to_node is not null")
def order_edges(spark, sf_dir):
    return series.neighbours(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.concat("role", F.lit("#"), F.col("turn").cast("string")))


@query("""
select event_id, user_id, f as found from (
  select event_id, user_id, event_type, last_value(case when event_type = 'view' then event_id end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) as f from events)
where event_type = 'purchase'""")
def asof_producer(spark, sf_dir):
    """Each purchase with the latest earlier view of its user."""
    is_ = lambda t: F.col("event_type") == t
    return series.as_of(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", is_("purchase"), is_("view"), "event_id").select("event_id", "user_id", "found")


STATUS = "case event_type when 'view' then 'running' when 'purchase' then 'completed' when 'error' then 'failed' end"


@query(f"""
with e as (select *, {STATUS} as s, (event_id % 10)::int as step from events),
st as (select user_id, step, max(case s when 'running' then 1 when 'completed' then 2 when 'failed' then 3 end) as r from e where s is not null group by all),
t as (select user_id, count(*) as n_steps, count_if(r = 2) as completed, count_if(r = 3) as failed from st group by 1),
a as (select user_id, count(*) as n_events, count_if(s is null) as unknown, arg_min(event_id, (ts, event_id)) as first_event, arg_max(event_id, (ts, event_id)) as last_event from e group by 1)
select user_id, n_events, coalesce(n_steps, 0) as n_steps, coalesce(completed, 0)::bigint as completed, coalesce(failed, 0)::bigint as failed, unknown::bigint as unknown, first_event, last_event,
  case when coalesce(failed, 0) > 0 then 'failed' when completed = n_steps and n_steps > 0 then 'completed' else 'running' end as run_status
from a left join t using (user_id)""")
def trace_replay(spark, sf_dir):
    """Runs (users) replayed from their events: views start, purchases complete, errors fail one of ten steps."""
    events = table(spark, sf_dir, "events").withColumn("step", (F.col("event_id") % 10).cast("int"))
    return trace.replay(events, "user_id", "step", F.expr(STATUS), "ts", "event_id")


@query("""
with s as (select user_id, (event_id % 10)::int as step, min(case when event_type = 'purchase' then ts end) as done from events group by all),
w as (select *, lag(done) over (partition by user_id order by step) as before_at, row_number() over (partition by user_id order by step) as n from s)
select user_id, step, done, before_at from w where done is not null and n > 1 and (before_at is null or before_at > done)""")
def order_violations(spark, sf_dir):
    steps = table(spark, sf_dir, "events").groupBy("user_id", (F.col("event_id") % 10).cast("int").alias("step")).agg(F.min(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("done"))
    return trace.order_violations(steps, "user_id", "step", "done")


@query("""
select conv_id, turn, coalesce(bool_or(role = 'user') over w, false) as asked, coalesce(bool_or(role = 'user') over b, false) as before_asked,
  coalesce(bool_or(role = 'assistant') over w, false) as answered, coalesce(bool_or(role = 'assistant') over b, false) as before_answered
from conversations window w as (partition by conv_id order by turn rows between unbounded preceding and current row), b as (partition by conv_id order by turn rows between unbounded preceding and 1 preceding)""")
def cumulative_state(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return series.running_flags(rows, "conv_id", "turn", {"asked": F.col("role") == "user", "answered": F.col("role") == "assistant"}).drop("role")


@query("select doc_id, case when n = 1 then b else b || '~' || n end as unique_id from (select doc_id, source || '/' || n_chars % 100 as b, row_number() over (partition by source || '/' || n_chars % 100 order by doc_id) as n from documents)")
def duplicate_suffix(spark, sf_dir):
    base = F.concat("source", F.lit("/"), (F.col("n_chars") % 100).cast("string"))
    return series.suffixed(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), base, "doc_id").select("doc_id", "unique_id")


@query("""
select n_nationkey, round(r * cos(a), 4) as x, round(r * sin(a), 4) as y from (
  select n_nationkey, (row_number() over (partition by n_regionkey order by n_nationkey) - 1) * 6.283185307179586 / count(*) over (partition by n_regionkey) as a, greatest(64, 24 * count(*) over (partition by n_regionkey)) as r from nation)""")
def circle_layout(spark, sf_dir):
    return series.circle_layout(table(spark, sf_dir, "nation"), "n_nationkey", "n_regionkey").select("n_nationkey", "x", "y")


@query("select event_type as name, count(*) as n, round(sum(value), 4) as total, max(value) as greatest from events group by 1")
def metric_summary(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("name")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.max("value").alias("greatest"))


@query("select o_custkey, count(distinct o_orderstatus) as n_values, min(o_orderstatus) as low, max(o_orderstatus) as high from orders group by 1 having count(distinct o_orderstatus) > 1")
def conflicts(spark, sf_dir):
    """Customers whose orders have more than one status."""
    found = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count_distinct("o_orderstatus").alias("n_values"), F.min("o_orderstatus").alias("low"), F.max("o_orderstatus").alias("high"))
    return found.where("n_values > 1")


@query("select user_id, count(*) as n_events, count_if(event_type = 'error')::bigint as errors, count_if(event_type = 'purchase')::bigint as purchases, count(distinct event_type) as kinds from events group by 1")
def index_summary(spark, sf_dir):
    of = lambda t: F.count_if(F.col("event_type") == t)
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n_events"), of("error").alias("errors"), of("purchase").alias("purchases"), F.count_distinct("event_type").alias("kinds"))
