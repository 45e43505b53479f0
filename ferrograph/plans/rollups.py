"""Rollups over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rollups
from ..tables import table
from .registry import query


@query("select user_id, count(*) as n_all, count_if(event_type = 'error')::bigint as n_error, count_if(event_type = 'click')::bigint as n_click, count_if(event_type not in ('error', 'click'))::bigint as n_other from events group by 1")
def severity_counts(spark, sf_dir):
    """Diagnostics by severity."""
    return rollups.counted_by(table(spark, sf_dir, "events"), ["user_id"], "event_type", ["error", "click"])


@query("with p as (select user_id, event_type, count(*) as n from events group by 1, 2) select event_type, sum(n)::bigint as n, count(*) as n_files from p group by 1")
def code_counts(spark, sf_dir):
    """Counts by code of each file, added up over files."""
    parts = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return rollups.summed_counts(parts, "event_type", "n")


@query("select count(*) as n_all, count_if(event_type = 'error')::bigint as n_errors, count(distinct user_id) as n_documents, count(distinct case when event_type = 'error' and value > 100 then user_id end) as n_failing from events")
def diagnostics_summary(spark, sf_dir):
    """One row over the workspace."""
    error = F.col("event_type") == "error"
    return table(spark, sf_dir, "events").agg(F.count("*").alias("n_all"), F.count_if(error).alias("n_errors"), F.count_distinct("user_id").alias("n_documents"), F.count_distinct(F.when(error & (F.col("value") > 100), F.col("user_id"))).alias("n_failing"))


@query("""
select c_nationkey, count(distinct c_custkey) as n_files, count(o_orderkey) as n_checks, count_if(o_orderstatus = 'F')::bigint as n_ok, count_if(o_orderstatus = 'P')::bigint as n_failing, sum(o_totalprice::decimal(18, 2))::double as total
from customer left join orders on o_custkey = c_custkey group by 1""")
def changed_rollup(spark, sf_dir):
    """Checks of changed files by nation."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderstatus", "o_totalprice")
    met = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(orders, "c_custkey", "left")
    return met.groupBy("c_nationkey").agg(F.count_distinct("c_custkey").alias("n_files"), F.count("o_orderkey").alias("n_checks"), F.sum((F.col("o_orderstatus") == "F").cast("bigint")).alias("n_ok"), F.sum((F.col("o_orderstatus") == "P").cast("bigint")).alias("n_failing"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))


@query("select o_custkey, (sum(o_totalprice::decimal(18, 2)) filter (where o_orderpriority = '1-URGENT' and o_orderstatus = 'P'))::double as equivalents from orders group by 1")
def equivalents(spark, sf_dir):
    """What is urgent and open of each customer, null where nothing is."""
    return rollups.sum_or_null(table(spark, sf_dir, "orders"), ["o_custkey"], "o_totalprice", (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "P"), "equivalents")


@query("select l_orderkey, round(coalesce((sum((case when l_returnflag = 'A' then l_discount end)::decimal(18, 4)))::double / nullif(count(case when l_returnflag = 'A' then l_discount end), 0), 0), 9) as confidence from lineitem group by 1")
def mean_confidence(spark, sf_dir):
    """An order's mean confidence, 0 where no step has one."""
    return rollups.mean_or_zero(table(spark, sf_dir, "lineitem"), ["l_orderkey"], F.when(F.col("l_returnflag") == "A", F.col("l_discount")), "confidence")


@query("""
with r as (select l_orderkey, count_if(l_returnflag = 'R')::bigint as n_reactants, count_if(l_returnflag = 'A')::bigint as n_products, count_if(l_discount = 0)::bigint as n_limiting from lineitem group by 1)
select *, concat_ws('+', case when n_reactants = 0 then 'no_reactant' end, case when n_products = 0 then 'no_product' end, case when n_limiting > 1 then 'several_limiting' end) as broken from r""")
def stoichiometry(spark, sf_dir):
    """Counts of what goes into and comes out of an order, and the rules they break."""
    found = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("n_reactants"), F.count_if(F.col("l_returnflag") == "A").alias("n_products"), F.count_if(F.col("l_discount") == 0).alias("n_limiting"))
    return found.withColumn("broken", rollups.broken_rules({"no_reactant": F.col("n_reactants") == 0, "no_product": F.col("n_products") == 0, "several_limiting": F.col("n_limiting") > 1}))


@query("""
with l as (select l_orderkey as o_orderkey, sum(l_extendedprice::decimal(18, 2))::double as found, count(*) as n from lineitem group by 1)
select o_orderkey, case when found is null then 'none' when n >= 4 then 'measured' else 'estimated' end as basis, concat_ws('+', case when found is null then 'no_lines' end, case when found < o_totalprice then 'less_than_declared' end, case when found > 5 * o_totalprice then 'conflict' end) as warnings
from orders left join l using (o_orderkey)""")
def outcome_quality(spark, sf_dir):
    """How an order's declared total holds against its lines."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("found"), F.count("*").alias("n"))
    met = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").join(lines, "o_orderkey", "left")
    basis = F.when(F.col("found").isNull(), "none").when(F.col("n") >= 4, "measured").otherwise("estimated")
    warnings = rollups.broken_rules({"no_lines": F.col("found").isNull(), "less_than_declared": F.col("found") < F.col("o_totalprice"), "conflict": F.col("found") > 5 * F.col("o_totalprice")})
    return met.select("o_orderkey", basis.alias("basis"), warnings.alias("warnings"))


@query("""
with n as (select c_custkey, c_nationkey * 100 + c_custkey % 97 as route from customer), s as (select route, count(*) as route_size from n group by 1)
select route, c_custkey, route_size, route_size = 1 and c_custkey not in (select o_custkey from orders) as orphan from n join s using (route)""")
def route_sizes(spark, sf_dir):
    """Members by the size of their route, and those that are alone and unlinked."""
    nodes = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_nationkey") * 100 + F.col("c_custkey") % 97).alias("route"))
    return rollups.sized_routes(nodes, "route", table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey").select("route", "c_custkey", "route_size", "orphan")


@query("""
with g as (select o_orderpriority as family, c_mktsegment as procedure, count(distinct o_orderkey) as n_documents, count(distinct o_orderstatus) as n_signatures, count(distinct o_custkey) as n_reactants, count(distinct o_orderdate) as n_products, count(*) as n_runs from orders join customer on c_custkey = o_custkey group by 1, 2)
select *, case when n_reactants > 1 and n_products > 1 then 'scope' when n_reactants > 1 then 'substrate' when n_products > 1 then 'outcome' else 'condition' end as kind from g where n_documents >= 2 and n_signatures >= 2""")
def family_trajectories(spark, sf_dir):
    """Runs of one family and procedure in several documents."""
    runs = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).withColumnsRenamed({"o_orderpriority": "family", "c_mktsegment": "procedure"})
    return rollups.trajectories(runs, ["family", "procedure"], "o_orderkey", "o_orderstatus", "o_custkey", "o_orderdate")


@query("""
select o_custkey, string_agg(distinct o_orderpriority, ', ' order by o_orderpriority) || ' / ' || string_agg(distinct o_orderstatus, ', ' order by o_orderstatus) || ' / best ' || floor(max(o_totalprice))::bigint as rationale from orders group by 1""")
def trajectory_rationale(spark, sf_dir):
    """Why a customer's orders belong together, as a line of text."""
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ", ")
    text = F.concat(joined("o_orderpriority"), F.lit(" / "), joined("o_orderstatus"), F.lit(" / best "), F.floor(F.max("o_totalprice")).cast("bigint").cast("string"))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(text.alias("rationale"))


@query("""
with i as (select l_orderkey, unnest(['p' || l_partkey, 's' || l_suppkey, case when l_discount = 0 then 'n' || l_linenumber end]) as id from lineitem)
select l_orderkey, string_agg(distinct id, ',' order by id) as ids from i where id is not null group by 1""")
def artifact_ids(spark, sf_dir):
    """The distinct ids that an order's lines hold in several places."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", F.concat(F.lit("p"), "l_partkey").alias("x"), F.concat(F.lit("s"), "l_suppkey").alias("y"), F.when(F.col("l_discount") == 0, F.concat(F.lit("n"), "l_linenumber")).alias("z"))
    return rollups.collected_ids(line, "l_orderkey", ["x", "y", "z"])


@query("select p_brand as kind, p_name as name, count(*) as n, min(p_partkey) as first_id, max(p_partkey) as last_id from part group by 1, 2")
def symbol_index(spark, sf_dir):
    """Symbols by kind and name."""
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("kind"), F.col("p_name").alias("name")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_id"), F.max("p_partkey").alias("last_id"))


@query("""
with d as (select l_orderkey, greatest(count_if(l_returnflag = 'R'), 1)::bigint as support, string_agg(distinct l_linestatus, '+' order by l_linestatus) as uses, count(distinct l_returnflag) as n_kinds from lineitem group by 1)
select * from d""")
def pattern_memory(spark, sf_dir):
    """A diff's memory: its support is one at least."""
    uses = F.array_join(F.array_sort(F.collect_set("l_linestatus")), "+")
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.greatest(F.count_if(F.col("l_returnflag") == "R"), F.lit(1)).cast("bigint").alias("support"), uses.alias("uses"), F.count_distinct("l_returnflag").alias("n_kinds"))


@query("""
with r as (select doc_id, unnest(['no_label', 'no_source', 'short', 'long']) as rule, unnest([doc_id not in (select doc_id from labels), source is null, length(text) < 200, length(text) > 20000]) as broken from documents)
select rule, count(*) as n, min(doc_id) as first_doc from r where broken group by 1""")
def missing_logic(spark, sf_dir):
    """How many documents lack what a record needs, rule by rule."""
    known = table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("known")).distinct()
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.length("text").alias("n")).join(known, "doc_id", "left")
    rules = {"no_label": F.col("known").isNull(), "no_source": F.col("source").isNull(), "short": F.col("n") < 200, "long": F.col("n") > 20000}
    broken = F.explode(F.array_compact(F.array(*[F.when(x, F.lit(k)) for k, x in rules.items()])))
    return docs.select("doc_id", broken.alias("rule")).groupBy("rule").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


@query("""
with c as (select o_orderkey as context, o_custkey as run, o_orderstatus as s, o_totalprice as t from orders)
select 'outcome' as kind, count(*) as n, min(context) as first_id from c where s = 'F' union all select 'procedure', count(*), min(context) from c where t > 100000 union all
select 'failure', count(*), min(context) from c join lineitem on l_orderkey = context where l_returnflag = 'R' and l_discount = 0 union all select 'evidence', count(*), min(context) from c join events on event_id = context where event_type = 'view'""")
def causal_links(spark, sf_dir):
    """Links of several kinds from contexts to outcomes, procedures, failures and evidence, counted by kind."""
    c = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("context"), "o_orderstatus", "o_totalprice")
    bad = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_discount = 0").select(F.col("l_orderkey").alias("context"))
    seen = table(spark, sf_dir, "events").where("event_type = 'view'").select(F.col("event_id").alias("context"))
    kinds = {"outcome": c.where("o_orderstatus = 'F'"), "procedure": c.where("o_totalprice > 100000"), "failure": c.join(bad, "context"), "evidence": c.join(seen, "context")}
    links = None
    for name, rows in kinds.items():
        one = rows.select(F.lit(name).alias("kind"), "context")
        links = one if links is None else links.union(one)
    return links.groupBy("kind").agg(F.count("*").alias("n"), F.min("context").alias("first_id"))
