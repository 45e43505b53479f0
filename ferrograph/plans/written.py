"""Diffs, patterns and keyed writes over the supplied tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import diffs
from ..tables import table
from .registry import query

CHANGES = """c as (select event_id, event_type as new_type, lag(event_type) over (partition by user_id order by ts, event_id) as old_type, case when value < 50 then '' else 'high' end as family,
  case when value < 100 then 'eval' else 'sft' end as u from events)"""
PATTERNS = f"""{CHANGES},
p as (select coalesce(nullif(family, ''), 'unknown') as family, 'event_type' as field, coalesce(old_type, 'unknown') as old_role, coalesce(new_type, 'unknown') as new_role, count(distinct event_id) as support, string_agg(distinct u, '+' order by u) as training_uses
  from c where old_type is distinct from new_type group by all)"""


def changes(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").withColumn("old_type", F.lag("event_type").over(w))
    return rows.where("not old_type <=> event_type").select("event_id", F.lit("event_type").alias("field"), "old_type", F.col("event_type").alias("new_type"), F.when(F.col("value") < 50, "").otherwise("high").alias("family"), F.when(F.col("value") < 100, "eval").otherwise("sft").alias("u"))


@query(f"""with {PATTERNS}
select 'correction::aggregate::' || md5(concat_ws('|', family, field, old_role, new_role)) as pattern_id, family, field, old_role, new_role, support, training_uses, round(least(0.95, 0.5 + ln(support + 1) / 10), 6) as confidence,
  case when support >= 10 then 'gold' when support >= 3 then 'silver' else 'bronze' end as tier, support >= 10 as promoted from p""")
def correction_patterns(spark, sf_dir):
    """What events follow which, as patterns of changes with support and confidence."""
    return diffs.correction_patterns(changes(spark, sf_dir), "family", "field", "old_type", "new_type", "event_id", "u")


@query(f"""with {PATTERNS} select family, old_role, new_role, support from p
where exists (select 1 from events e where value > 99 and (e.event_type = p.new_role or e.event_type = p.old_role))""")
def pattern_exists_or(spark, sf_dir):
    """Patterns that some event of a high value meets on either side: an EXISTS with OR as semi joins."""
    p = correction_patterns(spark, sf_dir).select("pattern_id", "family", "old_role", "new_role", "support")
    events = table(spark, sf_dir, "events").where("value > 99").select("event_type")
    return diffs.semi_any(p, events, [[("new_role", "event_type")], [("old_role", "event_type")]], "pattern_id").drop("pattern_id")


@query("""
with r as (select *, row_number() over w as n, lag(o_orderstatus) over w as s, lag(o_orderpriority) over w as p, lag(o_totalprice) over w as t from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)),
u as (select o_orderkey, unnest([{'field': 'o_orderstatus', 'old_value': s, 'new_value': o_orderstatus, 'delta': null::double}, {'field': 'o_orderpriority', 'old_value': p, 'new_value': o_orderpriority, 'delta': null}]) as u from r where n > 1)
select o_orderkey, u.field as field, u.old_value as old_value, u.new_value as new_value, u.delta as delta from u where u.old_value is distinct from u.new_value""")
def revision_diff(spark, sf_dir):
    """Successive orders of a customer as revisions: one row a changed field."""
    return diffs.revisions_diff(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderkey", ["o_orderstatus", "o_orderpriority"])


OLD, NEW = "select * from orders where o_orderkey % 3 <> 0", "select * replace (case when o_orderkey % 5 = 0 then 'X' else o_orderstatus end as o_orderstatus) from orders where o_orderkey % 2 = 0"


def old_and_new(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    new = orders.where("o_orderkey % 2 = 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise(F.col("o_orderstatus")))
    return orders.where("o_orderkey % 3 <> 0"), new


@query(f"""
with o as ({OLD}), n as ({NEW})
select coalesce(o.o_orderkey, n.o_orderkey) as o_orderkey, case when o.o_orderkey is null then 'added' when n.o_orderkey is null then 'removed' else 'changed' end as change,
  case when o.o_orderkey is not null and n.o_orderkey is not null then 'o_orderstatus' else '' end as changed_fields
from o full join n on o.o_orderkey = n.o_orderkey where o.o_orderkey is null or n.o_orderkey is null or o.o_orderstatus <> n.o_orderstatus""")
def object_diff(spark, sf_dir):
    """Two sets of keyed objects: added, removed and changed ones."""
    return diffs.rows_diff(*old_and_new(spark, sf_dir), ["o_orderkey"], ["o_orderstatus", "o_totalprice"])


@query(f"""
with o as ({OLD}), n as ({NEW})
select o.o_orderkey, o_orderstatus, o_totalprice, 'kept' as written from o where o_orderkey not in (select o_orderkey from n)
union all select n.o_orderkey, n.o_orderstatus, n.o_totalprice, case when o.o_orderkey is null then 'inserted' else 'updated' end from n left join o using (o_orderkey)""")
def upsert(spark, sf_dir):
    old, new = (x.select("o_orderkey", "o_orderstatus", "o_totalprice") for x in old_and_new(spark, sf_dir))
    return diffs.upsert(old, new, ["o_orderkey"])


@query(f"with o as ({OLD}), n as ({NEW}) select o_orderkey, o_orderstatus from o union all select o_orderkey, o_orderstatus from n where o_orderkey not in (select o_orderkey from o)")
def insert_absent(spark, sf_dir):
    old, new = (x.select("o_orderkey", "o_orderstatus") for x in old_and_new(spark, sf_dir))
    return diffs.insert_absent(old, new, ["o_orderkey"])


@query(f"with o as ({OLD}), n as (select * from ({NEW}) where o_custkey % 7 = 0) select o_orderkey, o_custkey, o_orderstatus from o where o_custkey not in (select o_custkey from n) union all select o_orderkey, o_custkey, o_orderstatus from n")
def replace_set(spark, sf_dir):
    """All orders of a customer whom the new set mentions are replaced."""
    old, new = (x.select("o_orderkey", "o_custkey", "o_orderstatus") for x in old_and_new(spark, sf_dir))
    return diffs.replace_set(old, new.where("o_custkey % 7 = 0"), ["o_custkey"])


@query(f"with o as ({OLD}), n as ({NEW}) select o_orderkey, o_orderstatus, 'derived' as origin from o where o_orderkey not in (select o_orderkey from n) union all select o_orderkey, o_orderstatus, 'explicit' from n")
def explicit_overrides(spark, sf_dir):
    old, new = (x.select("o_orderkey", "o_orderstatus") for x in old_and_new(spark, sf_dir))
    return diffs.override(old, new, ["o_orderkey"])
