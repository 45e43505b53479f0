"""Clusters over the supplied tables: parts are items, linked where one order has both in equal quantity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clusters
from ..tables import stash, table
from .registry import query

PAIRS = "p as (select a.l_partkey as a, b.l_partkey as b, round(1 - abs(a.l_discount - b.l_discount), 2) as score, a.l_returnflag = b.l_returnflag as same from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_quantity = b.l_quantity and a.l_partkey < b.l_partkey)"
EDGES = f"{PAIRS}, e as (select a, b, max(score) as score, bool_or(same) as same from p group by 1, 2)"
#: Edges of this score or more are strict.
STRICT = 0.99
COMPONENTS = f"""{EDGES}, g as (select * from e where score >= {STRICT}),
w as (select a as u, b as v from g union all select b, a from g union all select a, a from g),
r as (select u as node, u as low from w union select w.v, r.low from r join w on w.u = r.node),
m as (select node, min(low) as cluster from r group by 1), i as (select cluster, g.* from g join m on m.node = g.a),
n as (select cluster, node, count(*) as d, sum(score::decimal(18, 6)) as s from (select cluster, a as node, score from i union all select cluster, b, score from i) group by 1, 2)"""


def pairs(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_partkey", "l_discount", "l_returnflag")
    other = line.select("l_orderkey", "l_quantity", F.col("l_partkey").alias("b"), F.col("l_discount").alias("d"), F.col("l_returnflag").alias("f"))
    met = line.join(other, ["l_orderkey", "l_quantity"]).where("l_partkey < b")
    return met.select(F.col("l_partkey").alias("a"), "b", F.round(1 - F.abs(F.col("l_discount") - F.col("d")), 2).alias("score"), (F.col("l_returnflag") == F.col("f")).alias("same"))


def edges(spark, sf_dir):
    bases = F.when(F.col("same"), F.array(F.lit("flag"), F.lit("quantity"))).otherwise(F.array(F.lit("quantity")))
    return pairs(spark, sf_dir).groupBy("a", "b").agg(F.max("score").alias("score"), F.bool_or("same").alias("same")).select("a", "b", "score", bases.alias("basis"))


def strict(spark, sf_dir):
    """The strict edges with their cluster, written once."""
    return stash(clusters.clustered(stash(edges(spark, sf_dir).where(F.col("score") >= STRICT), "strict")), "clustered")


@query(f"with {PAIRS} select a, b, score, same from (select *, row_number() over (partition by a, b order by score desc, same desc) as n from p) where n = 1")
def best_edges(spark, sf_dir):
    """The best edge of each pair."""
    return clusters.best_edges(pairs(spark, sf_dir), "score", "same")


@query(f"""
with recursive {COMPONENTS},
c as (select cluster, count(*) as n_members, min(d) as least from n group by 1)
select cluster, n_members, count(*) as n_edges, round(sum(score::decimal(18, 6))::double / count(*), 9) as mean_score, min(score) as min_score, max(score) as max_score,
  case when bool_or(same) then 'flag+quantity' else 'quantity' end as basis,
  concat_ws('+', case when n_members = 2 then 'pair_only' end, case when 2 * least < n_members - 1 then 'weak_links' end) as warnings
from i join c using (cluster) group by cluster, n_members, least""")
def strict_clusters(spark, sf_dir):
    """Connected components of the strict edges, with scores, bases and warnings."""
    return clusters.summaries(strict(spark, sf_dir))


@query(f"""
with recursive {COMPONENTS}
select cluster, arg_max(node, (d, s, -node)) as by_degree, arg_max(node, (s, -node)) as by_score, arg_max(node, (d, -node)) as by_plain_degree from n group by 1""")
def cluster_representatives(spark, sf_dir):
    """Each strict cluster's representative by three rules."""
    inside, out = strict(spark, sf_dir), None
    for rule, name in (("degree", "by_degree"), ("score", "by_score"), ("plain degree", "by_plain_degree")):
        one = clusters.representatives(inside, rule).withColumnRenamed("representative", name)
        out = one if out is None else out.join(one, "cluster")
    return out


@query(f"""
with recursive {COMPONENTS}, c as (select cluster, count(*) as n_members from n group by 1 having count(*) >= 3)
select cluster, n_members, substr(sha256('cluster:' || cluster || ':' || n_members), 1, 16) as id from c""")
def sized_clusters(spark, sf_dir):
    """Strict clusters of three members or more, with an id made of their first member and size."""
    found = clusters.summaries(strict(spark, sf_dir), 3)
    return found.select("cluster", "n_members", F.substring(F.sha2(F.concat(F.lit("cluster:"), "cluster", F.lit(":"), "n_members"), 256), 1, 16).alias("id"))


@query(f"""
with recursive {COMPONENTS}, c as (select cluster, count(*) as n_members from n group by 1), k as (select cluster, n_members, count(*) as n_edges from i join c using (cluster) group by 1, 2)
select cluster, n_members, n_edges from k order by n_members desc, n_edges desc, cluster limit 20""")
def largest_clusters(spark, sf_dir):
    """The twenty largest clusters: by members, then edges, then id."""
    return clusters.summaries(strict(spark, sf_dir)).select("cluster", "n_members", "n_edges").orderBy(F.desc("n_members"), F.desc("n_edges"), "cluster").limit(20)


@query(f"with recursive {COMPONENTS} select count(distinct cluster) as n_clusters, count(*) as n_members, (select count(*) from i) as n_edges, max(d) as greatest_degree from n")
def cluster_view(spark, sf_dir):
    """One row of counts over all clusters."""
    inside = strict(spark, sf_dir)
    nodes = inside.select("cluster", F.explode(F.array("a", "b")).alias("node")).groupBy("cluster", "node").agg(F.count("*").alias("d"))
    counts = nodes.agg(F.count_distinct("cluster").alias("n_clusters"), F.count("*").alias("n_members"), F.max("d").alias("greatest_degree"))
    return counts.crossJoin(inside.agg(F.count("*").alias("n_edges"))).select("n_clusters", "n_members", "n_edges", "greatest_degree")


@query(f"with {EDGES}, x as (select a, b, 1.0 as score, ['explicit'] as basis from e where (a + b) % 5 = 0 union all select b, a, score, case when same then ['flag', 'quantity'] else ['quantity'] end from e) select least(a, b) as a, greatest(a, b) as b, max(score)::double as score, array_to_string(list_sort(list_distinct(flatten(list(basis)))), '+') as basis from x group by least(a, b), greatest(a, b)")
def merged_edges(spark, sf_dir):
    """Edges that were given and those by similarity, as one edge a pair."""
    found = stash(edges(spark, sf_dir), "edges")
    given = found.where("(a + b) % 5 = 0").select("a", "b", F.lit(1.0).alias("score"), F.array(F.lit("explicit")).alias("basis"))
    turned = found.select(F.col("b").alias("a"), F.col("a").alias("b"), "score", "basis")
    return clusters.merged_edges(given, turned).withColumn("basis", F.array_join("basis", "+"))


@query(f"with {EDGES} select basis, count(*) as n from (select unnest(case when same then ['flag', 'quantity'] else ['quantity'] end) as basis from e) group by 1")
def basis_histogram(spark, sf_dir):
    """How many edges each basis has."""
    return edges(spark, sf_dir).select(F.explode("basis").alias("basis")).groupBy("basis").agg(F.count("*").alias("n"))


@query(f"with {EDGES} select p_partkey as node, p_brand as cluster from part where p_brand = 'Brand#2' and p_partkey in (select a from e where same union select b from e where same)")
def filtered_nodes(spark, sf_dir):
    """Nodes of one cluster that an edge of one basis touches."""
    nodes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("cluster")).where("cluster = 'Brand#2'")
    return clusters.touching(nodes, edges(spark, sf_dir), "flag")


@query(f"with {EDGES}, k as (select p_partkey as id from part where p_size >= 10) select a, b, score, concat_ws('+', case when x.id is null then 'unknown_a' end, case when y.id is null then 'unknown_b' end) as dropped from e left join k x on x.id = a left join k y on y.id = b")
def mergeable_edges(spark, sf_dir):
    """Edges with the reason why they cannot be merged: an end is not known."""
    known = table(spark, sf_dir, "part").where("p_size >= 10").select(F.col("p_partkey").alias("id"))
    return clusters.mergeable(edges(spark, sf_dir).select("a", "b", "score"), known)


@query("""
with d as (select 'brand::' || p_brand as id, 'derived' as origin, count(*) as n_members, min(p_partkey) as representative, count(*) >= 3 as for_training from part group by 1),
g as (select 'brand::' || p_brand as id, 'given' as origin, count(*) as n_members, max(p_partkey) as representative, false as for_training from part where p_size > 25 and p_type = 'ECONOMY' group by 1 union all select 'brand::none', 'given', 0, null, false)
select * from g union all select * from d where id not in (select id from g)""")
def map_clusters(spark, sf_dir):
    """Clusters derived from a key, with those that were given in place of the derived ones of the same id."""
    part = table(spark, sf_dir, "part").withColumn("id", F.concat(F.lit("brand::"), "p_brand"))
    made = lambda rows, origin, pick, use: rows.groupBy("id").agg(F.count("*").alias("n_members"), pick("p_partkey").alias("representative")).select("id", F.lit(origin).alias("origin"), "n_members", "representative", use.alias("for_training"))
    given = made(part.where("p_size > 25 and p_type = 'ECONOMY'"), "given", F.max, F.lit(False))
    none = spark.createDataFrame([("brand::none", "given", 0, None, False)], given.schema)
    return clusters.overridden(made(part, "derived", F.min, F.col("n_members") >= 3), given.unionByName(none), "id")


@query("""
with h as (select p_brand, p_size, count(distinct p_type) as n from part group by 1, 2), t as (select p_brand, count(distinct p_type) as n_members from part group by 1)
select p_brand, p_size, n_members from h join t using (p_brand) where n = n_members""")
def common_sizes(spark, sf_dir):
    """Sizes that every type of a brand has."""
    return clusters.held_by_all(table(spark, sf_dir, "part"), ["p_brand"], "p_type", "p_size")


@query("""
with c as (select o_custkey, concat('F', count_if(o_orderstatus = 'F'), 'O', count_if(o_orderstatus = 'O'), 'P', count_if(o_orderstatus = 'P')) as sig, string_agg(distinct o_orderstatus, '' order by o_orderstatus) as changed from orders group by 1),
k as (select sig, changed, min(o_custkey) as class_id, count(*) as n from c group by all), m as (select changed, sum(n)::bigint as m from k group by 1)
select o_custkey, class_id, n - 1 as n_same, m - n as n_changed_alike from c join k using (sig, changed) join m using (changed)""")
def center_links(spark, sf_dir):
    """Customers by the signature of their orders' statuses and by the mere set of these."""
    n = lambda s: F.count_if(F.col("o_orderstatus") == s).cast("string")
    sig = F.concat(F.lit("F"), n("F"), F.lit("O"), n("O"), F.lit("P"), n("P"))
    items = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(sig.alias("sig"), F.array_join(F.array_sort(F.collect_set("o_orderstatus")), "").alias("changed"))
    return clusters.center_links(items, "o_custkey", "sig", "changed")


@query("""
with f as (select user_id, event_id, event_type, case when value > 50 then value end as mapping from events)
select user_id, arg_max(mapping, event_id) filter (where mapping is not null) as mapping, arg_min(event_type, event_id) as event_type,
  array_to_string(list_sort(list_distinct(list(json_extract_string(props, '$.k')))), ',') as ks
from f join events using (user_id, event_id, event_type) group by 1""")
def merged_features(spark, sf_dir):
    """A user's features from all events: the last mapping, the first type, the union of the references."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.when(F.col("value") > 50, F.col("value")).alias("mapping"), F.get_json_object("props", "$.k").alias("ks"))
    return clusters.merged_features(rows, "user_id", "event_id", ["mapping"], ["event_type"], ["ks"]).withColumn("ks", F.array_join("ks", ","))
