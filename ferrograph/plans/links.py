"""Joins of records with what refers to them, over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import notation
from ..operators import clusters, diffs, links
from ..tables import table
from .registry import query


@query("select 'pattern::' || c_custkey as memory, c_mktsegment as segment, o.n as n_orders from customer join (select 'pattern::' || o_custkey as id, count(*) as n from orders group by 1) o on o.id = 'pattern::' || c_custkey")
def computed_key_join(spark, sf_dir):
    """A join on a key made of a name and a number."""
    memories = table(spark, sf_dir, "orders").groupBy(F.concat(F.lit("pattern::"), "o_custkey").alias("memory")).agg(F.count("*").alias("n_orders"))
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("pattern::"), "c_custkey").alias("memory"), F.col("c_mktsegment").alias("segment")).join(memories, "memory")


@query("select p_partkey, word from (select p_partkey, list_filter(string_split(p_name, ' '), lambda w: length(w) > 4) as ws from part), unnest(case when len(ws) = 0 then [null] else ws end) u(word)")
def outer_members(spark, sf_dir):
    """The long words of a part's name, null where it has none."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.filter(F.split("p_name", " "), lambda w: F.length(w) > 4).alias("ws"))
    return links.with_members(rows, "ws", "word")


@query("select l_orderkey as reference, list_sort(list(distinct l_partkey)) [1] as first_part, count(distinct l_partkey) as n_parts from lineitem group by 1 having bool_or(l_partkey in (select p_partkey from part where p_size = 7))")
def find_references(spark, sf_dir):
    """Orders whose list of parts holds one that is looked for."""
    orders = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("reference")).agg(F.array_sort(F.collect_set("l_partkey")).alias("parts"))
    found = links.referring(orders, "parts", table(spark, sf_dir, "part").where("p_size = 7"), "p_partkey")
    return found.select("reference", F.col("parts")[0].alias("first_part"), F.size("parts").cast("bigint").alias("n_parts"))


@query("select l_suppkey as from_id, count(*) as n, count(distinct l_partkey) as n_to from lineitem where l_returnflag in ('A', 'R') and l_partkey in (select p_partkey from part where p_type = 'ECONOMY') group by 1")
def linked_entities(spark, sf_dir):
    """Suppliers by their relations of some types to parts of one kind."""
    relations = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("from_id"), F.col("l_returnflag").alias("type"), F.col("l_partkey").alias("to_id"))
    return links.related(relations, ["A", "R"], table(spark, sf_dir, "part").where("p_type = 'ECONOMY'").select(F.col("p_partkey").alias("to_id")))


@query("""
with rel as (select 'e' || event_id as relation, case when event_id % 2 = 0 then 'o' || (event_id % 15000) else 'c' || user_id end as target from events)
select 'o' || o_orderkey as result, count(distinct relation) as n_relations from orders join rel on target = 'o' || o_orderkey or target = 'c' || o_custkey group by 1""")
def result_evidence(spark, sf_dir):
    """How many relations name an order or its customer."""
    e = F.col("event_id")
    relations = table(spark, sf_dir, "events").select(F.concat(F.lit("e"), e).alias("relation"), F.when(e % 2 == 0, F.concat(F.lit("o"), e % 15000)).otherwise(F.concat(F.lit("c"), "user_id")).alias("target"))
    results = table(spark, sf_dir, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("result"), F.concat(F.lit("c"), "o_custkey").alias("owner"))
    return links.evidence(results, relations).groupBy("result").agg(F.count("*").alias("n_relations"))


@query("""
with out as (select l_orderkey as o_orderkey, max(l_extendedprice) as best from lineitem where l_returnflag = 'A' group by 1), bad as (select l_orderkey as o_orderkey, count(*) as n_failures, string_agg(distinct l_linestatus, '+' order by l_linestatus) as modes from lineitem where l_returnflag = 'R' group by 1),
i as (select l_orderkey as o_orderkey, string_agg(distinct case when l_tax > 0.04 then 'scale' else 'screen' end, '+' order by case when l_tax > 0.04 then 'scale' else 'screen' end) as intents from lineitem group by 1)
select o_orderkey, o_custkey, best, n_failures, modes, intents, best is not null as has_outcome, n_failures is not null as has_failures, intents is not null as has_intents
from orders left join out using (o_orderkey) left join bad using (o_orderkey) left join i using (o_orderkey)""")
def campaign_runs(spark, sf_dir):
    """Orders as runs, with their outcome, failures and intents where there are some."""
    line = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), "+")
    outcome = line.where("l_returnflag = 'A'").groupBy("o_orderkey").agg(F.max("l_extendedprice").alias("best"))
    failures = line.where("l_returnflag = 'R'").groupBy("o_orderkey").agg(F.count("*").alias("n_failures"), joined("l_linestatus").alias("modes"))
    intents = line.groupBy("o_orderkey").agg(joined(F.when(F.col("l_tax") > 0.04, "scale").otherwise("screen")).alias("intents"))
    return links.with_facts(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", outcome=outcome, failures=failures, intents=intents)


@query("""
with p as (select o_orderkey as candidate, o_orderkey - 1 as baseline from orders where o_orderkey % 3 <> 0), v as (select o_orderkey as id, round(o_totalprice, 2) as value from orders where o_orderstatus <> 'P'),
d as (select baseline, candidate, x.value as baseline_value, y.value as candidate_value, round(y.value - x.value, 4) as delta from p left join v x on x.id = baseline left join v y on y.id = candidate)
select *, case when delta > 0 then 'better' when delta < 0 then 'worse' when delta = 0 then 'same' else 'unknown' end as verdict from d""")
def comparisons(spark, sf_dir):
    """Each order beside the one before as its baseline."""
    orders = table(spark, sf_dir, "orders")
    pairs = orders.where("o_orderkey % 3 <> 0").select((F.col("o_orderkey") - 1).alias("baseline"), F.col("o_orderkey").alias("candidate"))
    return links.compared(pairs, orders.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("id"), F.round("o_totalprice", 2).alias("value")))


@query("""
with t as (select user_id, arg_max(event_type, event_id) as taxonomy from events where event_id % 2 = 0 group by 1), c as (select user_id, arg_max(value, event_id) as context from events where event_type = 'click' group by 1),
q as (select user_id, count(*) as n_failures from events where event_type = 'error' and value > 20 group by 1)
select user_id, taxonomy, context, coalesce(n_failures, 0) as n_failures, case when coalesce(n_failures, 0) > 8 then 'expert' when context > 40 then 'analyst' else 'automatic' end as route
from t left join c using (user_id) left join q using (user_id)""")
def expert_routing(spark, sf_dir):
    """Who looks at a user: by the last kind, the last context and the failures."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    t = clusters.last_wins(e.where("event_id % 2 = 0").select("user_id", "event_id", F.col("event_type").alias("taxonomy")), ["user_id"], "event_id").select("user_id", "taxonomy")
    c = clusters.last_wins(e.where("event_type = 'click'").select("user_id", "event_id", F.col("value").alias("context")), ["user_id"], "event_id").select("user_id", "context")
    q = e.where("event_type = 'error' and value > 20").groupBy("user_id").agg(F.count("*").alias("n_failures"))
    n = F.coalesce("n_failures", F.lit(0))
    route = F.when(n > 8, "expert").when(F.col("context") > 40, "analyst").otherwise("automatic")
    return t.join(c, "user_id", "left").join(q, "user_id", "left").select("user_id", "taxonomy", "context", n.alias("n_failures"), route.alias("route"))


@query("""
with f as (select p_partkey, unnest([{'k': 'name', 'v': p_name}, {'k': 'fields.brand', 'v': p_brand}, {'k': 'fields.type', 'v': p_type}, {'k': 'fields.size', 'v': p_size::varchar}], recursive := true) from part),
a as (select * from f), b as (select p_partkey - 1 as p_partkey, k, v from f)
select coalesce(a.p_partkey, b.p_partkey) as p_partkey, coalesce(a.k, b.k) as field, a.v as old, b.v as new from a full join b on a.p_partkey = b.p_partkey and a.k = b.k
where a.v is distinct from b.v and coalesce(a.p_partkey, b.p_partkey) in (select p_partkey from part) and coalesce(a.p_partkey, b.p_partkey) + 1 in (select p_partkey from part)""")
def field_changes(spark, sf_dir):
    """What changed from a part to the next, field by field, with nested fields under their prefix."""
    part = table(spark, sf_dir, "part")
    nested = F.struct(F.col("p_name").alias("name"), F.struct(F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), F.col("p_size").cast("string").alias("size")).alias("fields"))
    flat = part.select("p_partkey", diffs.flattened(nested, part.select(nested.alias("r")).schema["r"].dataType).alias("m"))
    both = flat.withColumnRenamed("m", "old").join(flat.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("m").alias("new")), "p_partkey")
    return both.select("p_partkey", F.explode(diffs.map_changes(F.col("old"), F.col("new"))).alias("d")).select("p_partkey", F.col("d.field").alias("field"), F.col("d.before").alias("old"), F.col("d.after").alias("new"))


@query("""
with s as (select user_id, event_type as value from events where value > 60), r as (select user_id as plan, 'rule-family' as rule from s where value = 'error' union select user_id, 'rule-hazard' from s where value in ('click', 'view') union select c_custkey, 'rule-segment' from customer where c_mktsegment = 'MACHINERY' and c_custkey in (select user_id from s))
select plan, rule from r""")
def safety_rules(spark, sf_dir):
    """Rules that a run triggers by its family, its hazards or its segment."""
    e = table(spark, sf_dir, "events").where("value > 60")
    runs = e.groupBy("user_id").agg(F.collect_set("event_type").alias("hazards")).withColumn("family", F.col("hazards"))
    seg = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment"))
    plans = runs.join(seg, "user_id", "left").select(F.col("user_id").alias("plan"), "family", "hazards", "segment")
    rules = lambda *pairs: spark.createDataFrame(list(pairs), "value string, rule string")
    return links.triggered(plans, {"family": rules(("error", "rule-family")), "hazards": rules(("click", "rule-hazard"), ("view", "rule-hazard")), "segment": rules(("MACHINERY", "rule-segment"))})


@query("""
with w as (select p_partkey, unnest(string_split(p_name, ' ')) as word from part), d as (select word, min(p_partkey) as declared_by from w group by 1)
select p_partkey as a, declared_by as b, word, case when declared_by < p_partkey then 'uses' else 'declares' end as kind from w join d using (word)""")
def module_edges(spark, sf_dir):
    """Words that a part uses, each linked to the part that is first to have it."""
    words = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("a"), F.explode(F.split("p_name", " ")).alias("word"))
    declared = words.groupBy("word").agg(F.min("a").alias("b"))
    return words.join(declared, "word").select("a", "b", "word", F.when(F.col("b") < F.col("a"), "uses").otherwise("declares").alias("kind"))


@query("""
select o_orderkey as entity, coalesce(x.r, y.r, z.r) as range, case when x.r is not null then 'override' when y.r is not null then 'field' when z.r is not null then 'owner' end as origin
from orders left join (select l_orderkey as id, min(l_quantity)::bigint as r from lineitem where l_returnflag = 'A' and l_discount = 0 group by 1) x on x.id = o_orderkey
left join (select l_orderkey as id, max(l_quantity)::bigint as r from lineitem where l_returnflag = 'R' group by 1) y on y.id = o_orderkey left join (select c_custkey as id, c_nationkey::bigint as r from customer where c_acctbal > 0) z on z.id = o_custkey""")
def source_ranges(spark, sf_dir):
    """An order's range by its own override, else its field, else its owner."""
    line = table(spark, sf_dir, "lineitem")
    own = line.where("l_returnflag = 'A' and l_discount = 0").groupBy(F.col("l_orderkey").alias("id")).agg(F.min("l_quantity").cast("bigint").alias("range"))
    field = line.where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("id")).agg(F.max("l_quantity").cast("bigint").alias("range"))
    owner = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("bigint").alias("range"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("entity"), "o_custkey")
    return links.resolved(rows, "id", [("override", own, "entity"), ("field", field, "entity"), ("owner", owner, "o_custkey")]).drop("o_custkey")


@query("""
with t as (select l_suppkey as target, l_orderkey % 500 as document, l_returnflag as part, l_partkey % 40 as id from lineitem),
e as (select event_id as event, case when event_id % 3 < 2 then event_id % 500 end as document, case when event_id % 3 = 0 then 'A' end as part, user_id % 40 as id from events),
a as (select document, part, id, min(target) as target from t group by 1, 2, 3 having count(distinct target) = 1), b as (select document, id, min(target) as target from t group by 1, 2 having count(distinct target) = 1), c as (select id, min(target) as target from t group by 1 having count(distinct target) = 1)
select event, (event % 3)::int as level, case event % 3 when 0 then a.target when 1 then b.target else c.target end as target
from e left join a on event % 3 = 0 and a.document = e.document and a.part = e.part and a.id = e.id left join b on event % 3 = 1 and b.document = e.document and b.id = e.id left join c on event % 3 = 2 and c.id = e.id""")
def trace_targets(spark, sf_dir):
    """Events resolved to a target by as much of its key as they carry; keys of several targets stay open."""
    k = F.col("event_id") % 3
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("event"), F.when(k < 2, F.col("event_id") % 500).alias("document"), F.when(k == 0, F.lit("A")).alias("part"), (F.col("user_id") % 40).alias("id"))
    targets = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("target"), (F.col("l_orderkey") % 500).alias("document"), F.col("l_returnflag").alias("part"), (F.col("l_partkey") % 40).alias("id"))
    return links.targeted(events, targets)


@query("select l_orderkey as candidate, l_returnflag as role, arg_max(l_partkey, (l_discount, l_partkey)) as fact, max(l_discount) as confidence from lineitem group by 1, 2")
def best_facts(spark, sf_dir):
    """The most certain fact of each role of a candidate."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("candidate"), F.col("l_returnflag").alias("role"), F.col("l_discount").alias("confidence"), F.col("l_partkey").alias("fact"))
    return links.picked(rows, ["candidate", "role"], [F.col("confidence"), F.col("fact")], ["fact", "confidence"])


@query("""
with k as (select l_orderkey as id, max(l_linenumber)::bigint as revision from lineitem where l_returnflag <> 'N' group by 1), r as (select o_orderkey as id, case when o_orderkey % 11 <> 0 then o_orderkey % 8 end as revision from orders)
select id, r.revision, case when r.revision is null then 'skipped' when k.revision = r.revision then 'unchanged' when k.revision is not null then 'changed' else 'new' end as disposition from r left join k using (id)""")
def ingest_dispositions(spark, sf_dir):
    """Whether an order's revision is skipped, unchanged, changed or new."""
    known = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'N'").groupBy(F.col("l_orderkey").alias("id")).agg(F.max("l_linenumber").cast("bigint").alias("revision"))
    k = F.col("o_orderkey")
    return links.unchanged(table(spark, sf_dir, "orders").select(k.alias("id"), F.when(k % 11 != 0, k % 8).alias("revision")), known, "id", "revision")


@query("""
with v as (select vec_id as doc_id, 'm' || label % 2 as model from embeddings where len(embedding) = 64)
select count(*) as selected, count_if(v.doc_id is null)::bigint as embedded, count_if(v.doc_id is not null)::bigint as skipped from documents d left join v on v.doc_id = d.doc_id and v.model = 'm1'""")
def backfill_counts(spark, sf_dir):
    """What a backfill of one model's vectors would do: selected, embedded and skipped documents."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.concat(F.lit("m"), F.col("label") % 2).alias("model"), F.col("embedding").alias("vector"))
    chunks = table(spark, sf_dir, "documents").select("doc_id", F.lit("m1").alias("model"))
    found = links.missing_vectors(chunks, vectors, ["doc_id", "model"], 64)
    return found.agg(F.count("*").alias("selected"), F.count_if(F.col("action") == "embed").alias("embedded"), F.count_if(F.col("action") == "kept").alias("skipped"))


@query("select p_name, min(p_partkey) as p_partkey from part where p_brand = 'Brand#2' or p_name like 'small%' group by 1")
def symbol_filter(spark, sf_dir):
    """Symbols by kind or prefix of their label, one for each label, the first of them."""
    found = table(spark, sf_dir, "part").where((F.col("p_brand") == "Brand#2") | F.col("p_name").startswith("small"))
    return found.groupBy("p_name").agg(F.min("p_partkey").alias("p_partkey"))


@query("select p_partkey, place::int as place from (select p_partkey, row_number() over (order by (p_brand = 'Brand#2') desc, (p_size > 25), p_type = 'ECONOMY' desc, p_name, p_partkey) as place from part) where place <= 50")
def completions(spark, sf_dir):
    """The first fifty completions: preferred kind, fresh, same document, name, id."""
    order = [F.desc(F.col("p_brand") == "Brand#2"), F.asc(F.col("p_size") > 25), F.desc(F.col("p_type") == "ECONOMY"), F.asc("p_name"), F.asc("p_partkey")]
    top = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", "p_type", "p_name").orderBy(*order).limit(50)
    return clusters.numbered(top.withColumn("all", F.lit(0)), ["all"], order).select("p_partkey", F.col("seq").alias("place"))


@query("select o_orderkey, o_orderdate from orders where o_orderstatus = 'P' order by o_orderdate, o_orderkey limit 25")
def pending_proposals(spark, sf_dir):
    """The oldest open orders."""
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select("o_orderkey", "o_orderdate").orderBy("o_orderdate", "o_orderkey").limit(25)


@query("select o_orderkey, o_orderdate, o_custkey from orders order by o_orderdate desc, o_orderkey limit 25")
def latest_snapshots(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(25)


@query("""
select o_custkey, string_agg(o_orderstatus, '>' order by o_orderkey) as signature from orders group by 1""")
def procedure_signatures(spark, sf_dir):
    """The statuses of a customer's orders in order, as one signature."""
    return clusters.ordered_names(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderkey", "o_orderstatus")


@query("""
with s as (select l_orderkey, string_agg(distinct l_linestatus, '+' order by l_linestatus) filter (where l_returnflag = 'R') as l, string_agg(distinct l_linestatus, '+' order by l_linestatus) filter (where l_returnflag = 'A') as r from lineitem group by 1)
select l_orderkey, coalesce(l, 'none') || '=>' || coalesce(r, 'none') as signature from s""")
def participant_signatures(spark, sf_dir):
    """What goes into an order and what comes out, none where there is nothing."""
    side = lambda f: F.array_sort(F.collect_set(F.when(F.col("l_returnflag") == f, F.col("l_linestatus"))))
    sides = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(side("R").alias("l"), side("A").alias("r"))
    return sides.select("l_orderkey", notation.participants(F.col("l"), F.col("r")).alias("signature"))


@query("select user_id, event_id, seq::int as seq, epoch_ms(1000 * seq) as at from (select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) as seq from events)")
def trace_numbers(spark, sf_dir):
    """Events numbered within their user, with a time made of the number."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    return clusters.numbered(rows, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "seq", F.timestamp_seconds("seq").cast("timestamp_ntz").alias("at"))


@query("select user_id, arg_min(event_id, event_id) filter (where event_type in ('view', 'click')) as current_step from events group by 1")
def current_steps(spark, sf_dir):
    """The first step of a run that is running or ready."""
    ready = F.when(F.col("event_type").isin("view", "click"), F.col("event_id"))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.min(ready).alias("current_step"))


@query("""
with v as (select user_id, event_id % 7 as slot, event_id as version, value from events), k as (select user_id, max(version) filter (where slot = 3) as cursor from v group by 1)
select user_id, slot, arg_max(value, version) as value, max(version) as version from v join k using (user_id) where version <= cursor group by 1, 2""")
def restored_states(spark, sf_dir):
    """Each user's state as it stood at a snapshot: the last version of every slot that is not after it."""
    rows = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 7).alias("slot"), F.col("event_id").alias("version"), "value")
    cursor = rows.where("slot = 3").groupBy("user_id").agg(F.max("version").alias("cursor"))
    return clusters.last_wins(rows.join(cursor, "user_id").where("version <= cursor").drop("cursor"), ["user_id", "slot"], "version")


@query("""
with d as (select o_orderkey as id, o_orderstatus as decision, o_custkey % 3 = 0 as cited, o_totalprice > 50000 as hash_ok, o_orderpriority as priority from orders)
select id, concat_ws('+', case when decision = 'P' then 'not_decided' end, case when priority like '5%' then 'rejected' end, case when not hash_ok then 'stale_base' end, case when not cited then 'no_evidence' end) as blocked_by from d""")
def patch_gate(spark, sf_dir):
    """What keeps a proposal from being applied; nothing, if it may be."""
    c = F.col
    why = F.concat_ws("+", F.when(c("o_orderstatus") == "P", F.lit("not_decided")), F.when(c("o_orderpriority").startswith("5"), F.lit("rejected")), F.when(~(c("o_totalprice") > 50000), F.lit("stale_base")), F.when(c("o_custkey") % 3 != 0, F.lit("no_evidence")))
    return table(spark, sf_dir, "orders").select(c("o_orderkey").alias("id"), why.alias("blocked_by"))
