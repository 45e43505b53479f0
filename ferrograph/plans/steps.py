"""Steps and members over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import plansteps
from ..tables import table
from .registry import query
from .similarity import HYBRID, hybrid_edges

STEPS = "s as (select user_id, (event_id % 10)::int as step, bool_or(event_type = 'purchase') as done from events group by all)"


@query(f"""
with {STEPS}, d as (select i::int as step, (i - 1)::int as needs from range(1, 10) t(i) union all select i::int, (i - 3)::int from range(3, 10) t(i)),
m as (select s.user_id, s.step, max((d.needs is not null and not coalesce(p.done, false))::int) as b from s left join d using (step) left join s p on p.user_id = s.user_id and p.step = d.needs where not s.done group by all)
select user_id, step, case when b = 1 then 'waiting' else 'ready' end as state from m""")
def ready_steps(spark, sf_dir):
    """Which steps of a run may start: each of ten needs the one before and the one three before."""
    steps = table(spark, sf_dir, "events").groupBy("user_id", (F.col("event_id") % 10).cast("int").alias("step")).agg(F.bool_or(F.col("event_type") == "purchase").alias("done"))
    n = spark.range(0, 10).select(F.col("id").cast("int").alias("step"), F.explode(F.array(F.lit(1), F.lit(3))).alias("k"))
    return plansteps.ready(steps, n.where("step >= k").select("step", (F.col("step") - F.col("k")).alias("needs")), "user_id", "step")


@query(f"with {HYBRID} select g.a, g.b, x.label as cluster from g join embeddings x on x.vec_id = g.a join embeddings y on y.vec_id = g.b and x.label = y.label")
def cluster_edges(spark, sf_dir):
    """The hybrid edges between vectors of one label."""
    members = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node"), F.col("label").alias("cluster"))
    return plansteps.inside(hybrid_edges(spark, sf_dir).select("a", "b"), members).select("a", "b", "cluster")


@query("""
with m as (select p_partkey as node, unnest(['brand ' || p_brand, 'type ' || p_type, 'size ' || p_size]) as cluster from part), c as (select cluster, count(*) as n from m group by 1)
select node, cluster, n from (select *, row_number() over (partition by node order by n desc, cluster) as p from m join c using (cluster)) where p = 1""")
def best_clusters(spark, sf_dir):
    """The largest cluster of each part."""
    names = F.array(F.concat(F.lit("brand "), "p_brand"), F.concat(F.lit("type "), "p_type"), F.concat(F.lit("size "), "p_size"))
    return plansteps.best_cluster(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.explode(names).alias("cluster")))


@query("""
with d as (select o_orderkey, o_orderkey % 7 as declared from orders)
select o_orderkey, declared, coalesce(n, 0) as found from d left join (select l_orderkey, count(*) as n from lineitem group by 1) on l_orderkey = o_orderkey where declared <> coalesce(n, 0)""")
def route_mismatch(spark, sf_dir):
    """Orders whose declared number of lines is not what is there."""
    declared = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 7).alias("declared"))
    return plansteps.miscounted(declared, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


@query("select l_suppkey as node, count(distinct l_partkey) as n_from, min(l_partkey) as first_from, max(l_partkey) as last_from from lineitem group by 1")
def inverse_edges(spark, sf_dir):
    return plansteps.inverse(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")))
