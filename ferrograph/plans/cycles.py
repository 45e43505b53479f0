"""Strongly connected states of users' walks, with one cycle each."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.cycles import canonical_cycles, strong_components
from ..operators.series import neighbours
from ..tables import table
from .registry import query


def walks(spark, sf_dir):
    """Edges (walker, a, b) between the states (user, event type, tens of the value) that a user's successive events visit."""
    # what a state's name shows of its user, which is the same for some users of seven digits
    walker = F.lpad(F.col("user_id").cast("string"), 6, "0")
    state = F.concat_ws(":", walker, "event_type", F.floor(F.col("value") / 10).cast("string"))
    events = table(spark, sf_dir, "events").withColumn("at", F.struct("ts", "event_id")).withColumn("state", state)
    return neighbours(events, "user_id", "at", F.col("state")).select(walker.alias("walker"), F.col("from_node").alias("a"), F.col("to_node").alias("b")).where("b is not null").distinct()


WALKS = """
s as (select user_id, ts, event_id, lpad(user_id::varchar, 6, '0') || ':' || event_type || ':' || floor(value / 10)::bigint as state from events),
e as materialized (select distinct a, b from (select state as a, lead(state) over (partition by user_id order by ts, event_id) as b from s) where b is not null),
r(a, b) as (select a, b from e union select r.a, e.b from r join e on e.a = r.b),
m as materialized (select x.a as node, least(x.a, min(y.b)) as component from (select a from e union select b from e) x left join (select p.a, p.b from r p join r q on p.a = q.b and p.b = q.a) y on y.a = x.a group by x.a)"""


@query(f"with recursive {WALKS} select node, component from m")
def strong_states(spark, sf_dir):
    """The strongly connected component of each state."""
    return strong_components(walks(spark, sf_dir), "walker")


@query(f"""
with recursive {WALKS},
i as materialized (select e.a, e.b, x.component as c from e join m x on x.node = e.a join m y on y.node = e.b and y.component = x.component),
d(c, node, d) as (select distinct c, c, 0 from i union select d.c, i.b, d.d + 1 from d join i on i.a = d.node where d.d < 400 and i.b <> d.c and d.d < (select max(n) from (select count(*) as n from m group by component))),
near as materialized (select c, node, min(d) as d from d group by 1, 2),
p(c, node, d, path) as (select distinct c, c, 0, [c] from i union all
  select p.c, i.b, p.d + 1, min(list_append(p.path, i.b)) from p join i on i.a = p.node join near n on n.c = p.c and n.node = i.b and n.d = p.d + 1 group by 1, 2, 3),
z as (select p.c, p.d + 1 as n, path from p join i on i.a = p.node and i.b = p.c),
best as (select c, min({{'n': n, 'p': path}}).p as cycle from z group by c)
select c as component, (select count(*) from m where component = c) as n_nodes, array_to_string(cycle, ' > ') as cycle from best""")
def state_cycles(spark, sf_dir):
    """One canonical cycle of each strongly connected component, whatever its length."""
    return canonical_cycles(walks(spark, sf_dir), "walker").select("component", "n_nodes", F.array_join("cycle", " > ").alias("cycle"))
