"""Lookups over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lookup
from ..tables import table
from .registry import query


@query("""
with a as (select c_custkey as k, 'a' || c_mktsegment as v from customer where c_custkey % 2 = 0), b as (select c_custkey as k, 'b' || c_mktsegment as v from customer where c_custkey % 3 = 0)
select o_orderkey, coalesce(a.v, b.v) as v, case when a.v is not null then 1 when b.v is not null then 2 end as from_source from orders left join a on a.k = o_custkey left join b on b.k = o_custkey""")
def first_match(spark, sf_dir):
    """A value from the first of two sources that knows the key."""
    c = table(spark, sf_dir, "customer")
    one = lambda n, p: c.where(F.col("c_custkey") % n == 0).select(F.col("c_custkey").alias("k"), F.concat(F.lit(p), "c_mktsegment").alias("v"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("k"))
    return lookup.first_match(rows, [one(2, "a"), one(3, "b")], ["k"], "v").select("o_orderkey", "v", "from_source")


DAY = "epoch({})::bigint // 86400"


@query(f"""
with r as (select o_orderkey as range_id, o_custkey as k, {DAY.format('o_orderdate')} as s, {DAY.format('o_orderdate')} + 10 + o_orderkey % 50 as e from orders where o_orderkey % 2 = 0),
p as (select o_orderkey as id, o_custkey as k, {DAY.format('o_orderdate')} as t from orders where o_orderkey % 2 = 1)
select id, arg_min(range_id, (e - s, range_id)) as range_id from p left join r on r.k = p.k and t >= s and t < e group by id""")
def enclosing_range(spark, sf_dir):
    """For each odd order the shortest span of an even one of its customer that holds its day."""
    day = F.floor(F.unix_timestamp("o_orderdate") / 86400)
    o = table(spark, sf_dir, "orders").withColumn("day", day)
    ranges = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("range_id"), F.col("o_custkey").alias("k"), F.col("day").alias("start"), (F.col("day") + 10 + F.col("o_orderkey") % 50).alias("end"))
    points = o.where("o_orderkey % 2 = 1").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("k"), F.col("day").alias("at"))
    return lookup.enclosing(points, ranges, "k", 30).select("id", "range_id")


@query("""
with r(prefix, kind) as (values ('PROMO', 'promo'), ('STANDARD', 'std'), ('STANDARD.POLISHED', 'std-polished'), ('ECONOMY.ANODIZED', 'eco-anodized')),
p as (select p_partkey, replace(p_type, ' ', '.') as n from part)
select p.p_partkey, arg_max(kind, length(prefix)) as kind from p left join r on n = prefix or starts_with(n, prefix || '.') group by 1""")
def longest_prefix(spark, sf_dir):
    """The kind of the longest rule that a part's dotted type begins with."""
    rules = spark.createDataFrame([("PROMO", "promo"), ("STANDARD", "std"), ("STANDARD.POLISHED", "std-polished"), ("ECONOMY.ANODIZED", "eco-anodized")], "prefix string, kind string")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.replace("p_type", F.lit(" "), F.lit(".")).alias("n"))
    return lookup.longest_prefix(rows, F.col("n"), rules).select("p_partkey", "kind")


@query("""
with d as (select p_name as name, p_partkey as definition from part)
select p_partkey, case when n = 1 then d end as definition, n as n_definitions from part join (select name, count(*) as n, min(definition) as d from d group by 1) on name = p_name""")
def definition_lookup(spark, sf_dir):
    """Names with one definition resolve, ambiguous ones do not."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name"))
    return lookup.unique_definition(part, part.withColumnRenamed("p_partkey", "definition"), "name").select("p_partkey", "definition", "n_definitions")


@query("""
select o_orderkey, case o_orderstatus when 'O' then 'eligible' when 'F' then case when o_orderkey % 5 < 3 then 'retryable' else 'blocked' end else 'skipped' end as disposition from orders""")
def outbox_dispositions(spark, sf_dir):
    """Orders as an outbox: which entries may be sent, tried again, or not."""
    status = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "F", "failed").otherwise("sent")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", status.alias("status"), (F.col("o_orderkey") % 5).alias("attempts"))
    return lookup.dispositions(rows, "status", "attempts").select("o_orderkey", "disposition")


@query("""
with s as (select conv_id, turn, lag(role) over (partition by conv_id order by turn) as from_status, role as to_status from conversations)
select * from s where from_status is not null and from_status <> to_status and not (from_status, to_status) in (('system', 'user'), ('user', 'assistant'))""")
def forbidden_transitions(spark, sf_dir):
    """Turns that follow one another in a way that a table of transitions does not allow."""
    return lookup.transitions_allowed(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", [("system", "user"), ("user", "assistant")])


@query("""
select doc_id, source as document, nullif(lang, '') as object, case when n_chars % 2 = 0 then 'c' || n_chars end as child from documents""")
def scoped_ids(spark, sf_dir):
    """Scoped ids built and read back into their parts."""
    x = F.concat(F.lit("@"), "source", F.lit("#"), "lang", F.when(F.col("n_chars") % 2 == 0, F.concat(F.lit(".c"), "n_chars")).otherwise(""))
    return table(spark, sf_dir, "documents").select("doc_id", x.alias("x")).select("doc_id", *[c.alias(k) for k, c in lookup.scoped_id(F.col("x")).items()])


@query("""
select user_id, user_id % 10 as bucket, count(*) as n, count_if(event_type = 'error')::bigint as failed, min(ts) as first_at, max(ts) as last_at from events where event_type <> 'signup' group by all""")
def queue_status(spark, sf_dir):
    """Counts by status of each user's queue."""
    e = table(spark, sf_dir, "events").where("event_type <> 'signup'")
    return e.groupBy("user_id", (F.col("user_id") % 10).alias("bucket")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("failed"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))
