"""Graph operators over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graphs
from ..tables import table
from .registry import query


def transitions(spark, sf_dir):
    """Event types that follow one another within a user, with counts."""
    events = table(spark, sf_dir, "events")
    from ..operators.series import neighbours

    steps = neighbours(events.withColumn("at", F.struct("ts", "event_id")), "user_id", "at", F.col("event_type"))
    return steps.groupBy(F.col("from_node").alias("a"), F.col("to_node").alias("b")).agg(F.count("*").alias("w"))


TRANSITIONS = "t as (select a, b, count(*) as w from (select event_type as a, lead(event_type) over (partition by user_id order by ts, event_id) as b from events) where b is not null group by 1, 2)"


@query(f"with recursive {TRANSITIONS}, p as (select [a] as path, b as next from t where b >= a union all select list_append(path, next), t.b from p join t on t.a = p.next where p.next <> path[1] and t.b >= path[1] and (t.b = path[1] or not list_contains(list_append(path, next), t.b))) select array_to_string(path, '>') as cycle, len(path)::int as n from p where next = path[1]")
def cycles(spark, sf_dir):
    """All simple cycles of event types in the graph of transitions."""
    found = graphs.cycles(transitions(spark, sf_dir))
    return found.select(F.array_join("path", ">").alias("cycle"), F.size("path").alias("n"))


PARENTS = "e as (select o_orderkey as b, o_orderkey // 3 as a from orders where o_orderkey // 3 <> o_orderkey)"


@query(f"with recursive {PARENTS}, r as (select 5::bigint as node, 0 as depth union select e.b, depth + 1 from r join e on e.a = r.node) select node, min(depth)::int as depth from r group by 1")
def affected(spark, sf_dir):
    """All orders below order 5 in a tree in which an order's parent is its number divided by three."""
    edges = table(spark, sf_dir, "orders").select((F.expr("o_orderkey div 3")).alias("a"), F.col("o_orderkey").alias("b")).where("a <> b")
    return graphs.reachable(edges, spark.createDataFrame([(5,)], "node bigint"))


@query()
def components(spark, sf_dir):
    """Orders and parts linked by line items, as connected components; recursion in SQL is too slow, so a test has a model."""
    lines = table(spark, sf_dir, "lineitem")
    return graphs.components(lines.select(F.col("l_orderkey").alias("a"), (F.col("l_partkey") + 1000000000).alias("b")))


@query()
def spanning_forest(spark, sf_dir):
    """The maximum spanning forest of the edges between all vectors, whatever their score."""
    from ..operators.similarity import forest_edges

    return forest_edges(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")


@query("""
with e as (select distinct c_nationkey as a, s_nationkey as b from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey)
select b as nation, count(*) as n_dependents, string_agg(a::varchar, ',' order by a) as dependents from e group by 1""")
def dependents(spark, sf_dir):
    """Reverse adjacency over every line item: the nations whose customers buy from a nation's suppliers."""
    t = lambda n: table(spark, sf_dir, n)
    lines, orders, customers = t("lineitem").select("l_orderkey", "l_suppkey"), t("orders").select("o_orderkey", "o_custkey"), t("customer").select("c_custkey", "c_nationkey")
    met = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    found = met.select(F.col("s_nationkey").alias("nation"), "c_nationkey").distinct().groupBy("nation").agg(F.array_sort(F.collect_set("c_nationkey")).alias("d"))
    return found.select("nation", F.size("d").cast("bigint").alias("n_dependents"), F.array_join(F.transform("d", lambda x: x.cast("string")), ",").alias("dependents"))
