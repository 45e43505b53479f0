"""State machines over the supplied events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.machines import AGENT, CLOSED, CONTROL_REFUSED, STATUS_REFUSED, STEP_REFUSED, audit_statuses, run_actions
from ..streaming.machines import replay_actions
from ..tables import table
from .registry import query

#: Each user's run: two steps that may begin at once (one after confirmation), two that need others, and two controls.
PLAN = [("s0", [], False), ("s1", [], True), ("s2", ["s0"], False), ("s3", ["s1", "c0"], True), ("c0", None, False), ("c1", None, False)]
ACTION = """case event_type when 'view' then 'start_step' when 'click' then 'complete_step' when 'purchase' then (case k % 3 when 0 then 'enter_control' when 1 then 'complete_control' else 'confirm_step' end)
  when 'error' then (case k % 7 when 0 then 'fail_step' when 1 then 'block_control' when 2 then 'abort_control' else 'confirm_step' end) when 'signup' then (case k % 2 when 0 then 'push' else 'restore' end) end"""
TARGET = "case when {a} like '%step' then concat('s', {k} % 4) when {a} like '%control' then concat('c', {k} % 2) when {a} = 'restore' then concat('', {k} % 6) end"


def actions(events: DataFrame) -> DataFrame:
    """Events as a feed of actions, what and on what by their type and their k."""
    rows = events.select("user_id", F.col("event_id").alias("seq"), "event_type", F.get_json_object("props", "$.k").cast("int").alias("k"))
    rows = rows.withColumn("action", F.expr(ACTION)).withColumn("target", F.expr(TARGET.format(a="action", k="(k div 5)")))
    return rows.select("user_id", "seq", "action", "target", F.lit(None).cast("array<string>").alias("needs"), F.lit(None).cast("boolean").alias("confirm"))


def machine_sql() -> str:
    """The rules as one recursive query: all runs go on by one action a round, their statuses in a list s0 to s3, c0, c1."""
    put = lambda what, st="st": f"list_transform(range(1, 7), lambda i: case when i = t then '{what}' else {st}[i] end)"
    ready = lambda st: f"list_transform(range(1, 7), lambda i: case when i = 3 and {st}[3] = 'planned' and {st}[1] = 'completed' then 'ready' when i = 4 and {st}[4] = 'planned' and {st}[2] = 'completed' and {st}[5] = 'completed' then 'waiting_confirmation' else {st}[i] end)"
    over = "case when len(list_filter(st2[1:4], lambda x: x <> 'completed')) = 0 then 'completed' else 'running' end"
    return f"""
with recursive x as (select user_id, event_id as seq, event_type, (props->>'k')::int as k, row_number() over (partition by user_id order by event_id) as n from events),
y as (select user_id, seq, n, {ACTION} as action, k // 5 as k from x),
f as materialized (select user_id, seq, n, action, {TARGET.format(a="action", k="k")} as target, case when action like '%step' then 1 + k % 4 when action like '%control' then 5 + k % 2 when action = 'restore' then k % 6 end as t from y),
r as (
  select user_id, 0::bigint as n, null::bigint as seq, null::varchar as action, null::varchar as target, null::int as t, ['ready', 'waiting_confirmation', 'planned', 'planned', 'planned', 'planned'] as st, 'planned' as status, 0::bigint as trace,
    []::varchar[][] as snaps, -1 as at_, null::boolean as ok, null::varchar as code from (select distinct user_id from events)
  union all
  select user_id, n, seq, action, target, t, case when not ok then st when action in ('complete_step', 'complete_control') then {ready('st2')} else st2 end,
    case when not ok then status when action in ('start_step', 'enter_control') then 'running' when action in ('complete_step', 'complete_control') then {over}
      when action = 'fail_step' then 'failed' when action = 'block_control' then 'paused' when action = 'abort_control' then 'aborted' when action = 'restore' then snaps[t + 1][7] else status end,
    trace + case when action in ('push', 'restore') then 0 when action = 'confirm_step' then case when ok then 2 else 0 end else 1 end,
    case when action = 'push' then list_append(snaps[1:at_ + 1], list_append(st, status)) else snaps end, case when action = 'push' then at_ + 1 when action = 'restore' and ok then t else at_ end, ok,
    case when ok or action = 'confirm_step' then null when action like '%step' then '{STEP_REFUSED}' when action like '%control' then '{CONTROL_REFUSED}' else 'unknown_snapshot' end
  from (select *, case when not ok then st when action = 'start_step' then {put('running')} when action in ('complete_step', 'complete_control') then {put('completed')} when action = 'confirm_step' then {put('ready')} when action = 'fail_step' then {put('failed')}
      when action = 'enter_control' then {put('running')} when action = 'block_control' then {put('blocked')} when action = 'abort_control' then {put('aborted')} when action = 'restore' then snaps[t + 1][1:6] else st end as st2
    from (select r.user_id, f.n, f.seq, f.action, f.target, f.t, r.st, r.status, r.trace, r.snaps, r.at_, case f.action when 'start_step' then r.st[f.t] = 'ready' when 'complete_step' then r.st[f.t] = 'running' when 'confirm_step' then r.st[f.t] = 'waiting_confirmation'
        when 'enter_control' then r.st[f.t] = 'planned' when 'complete_control' then r.st[f.t] = 'running' when 'restore' then f.t < len(r.snaps) else true end as ok
      from r join f on f.user_id = r.user_id and f.n = r.n + 1)))
select user_id, seq, action, target, ok as accepted, code, case when action in ('push', 'restore') then null else st[t] end as target_status, status as run_status, trace as n_trace, len(snaps)::int as n_snapshots from r where n > 0"""


COLUMNS = ["user_id", "seq", "action", "target", "accepted", "code", "target_status", "run_status", "n_trace", "n_snapshots"]


@query(machine_sql())
def lab_runs(spark, sf_dir):
    """Every action of every run with its outcome: refusals with their reason, snapshots pushed and restored."""
    return run_actions(actions(table(spark, sf_dir, "events")), "user_id", PLAN).select(COLUMNS)


@query(machine_sql())
def lab_run_stream(spark, sf_dir):
    """The same, as the events arrive: keyed state of a stream instead of sorted rows."""
    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", True).parquet(sf_dir)
    return replay_actions(spark, actions(events), "user_id", PLAN).select(COLUMNS)


KIND = "case when event_type in ('view', 'click', 'signup') then 'transition' when event_type = 'error' then 'tool_call' else 'patch_proposed' end"
TO = "case when event_type in ('view', 'click', 'signup') then " + "(case k % 23 when 0 then 'completed' when 1 then 'failed' when 2 then 'canceled' else (case k % 6 when 0 then 'created' when 1 then 'running' when 2 then 'blocked' when 3 then 'applying_patch' when 4 then 'validating' else 'waiting_for_approval' end) end)" + " when event_type = 'purchase' then 'waiting_for_approval' end"
PAIRS = ", ".join(f"('{a}', '{b}')" for a, after in AGENT.items() for b in after)
OPEN = ", ".join(f"'{s}'" for s, after in AGENT.items() if after)


@query(f"""
with recursive x as (select user_id, event_id as seq, event_type, (props->>'k')::int as k, row_number() over (partition by user_id order by event_id) as n from events),
f as materialized (select user_id, seq, n, {KIND} as kind, {TO} as goal from x),
r as (
  select user_id, 0::bigint as n, null::bigint as seq, null::varchar as kind, null::varchar as was, null::varchar as goal, 'created' as status, null::boolean as ok, 0::bigint as events from (select distinct user_id from events)
  union all
  select user_id, n, seq, kind, status, goal, case when ok then coalesce(goal, status) else status end, ok, events + ok::int
  from (select r.user_id, f.n, f.seq, f.kind, f.goal, r.status, r.events, case when f.kind = 'transition' then f.goal = r.status or (r.status, f.goal) in ({PAIRS}) else r.status in ({OPEN}) end as ok from r join f on f.user_id = r.user_id and f.n = r.n + 1))
select user_id, seq, case when ok then user_id || ':event:' || events end as event_id, kind, was as from_status, case when ok then status else goal end as to_status, ok as accepted,
  case when ok then null when kind = 'transition' then '{STATUS_REFUSED}' else '{CLOSED}' end as code, events as n_events from r where n > 0""")
def agent_audit(spark, sf_dir):
    """Each user's events as the run of an agent: transitions that the table allows, calls that only an active run takes, and the audit trail."""
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seq"), "event_type", F.get_json_object("props", "$.k").cast("int").alias("k"))
    return audit_statuses(rows.select("user_id", "seq", F.expr(KIND).alias("kind"), F.expr(TO).alias("to")), "user_id")
