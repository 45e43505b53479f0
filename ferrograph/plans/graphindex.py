"""Graphs and jobs over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graphindex, similarity
from ..tables import stash, table
from .registry import query
from .similarity import COS


def named(kind: str, key):
    return F.concat(F.lit(f"{kind}::"), F.col(key).cast("string"))


NODES = "select 'customer::' || c_custkey as node, 'customer' as kind, c_name as label from customer union all select 'supplier::' || s_suppkey, 'supplier', s_name from supplier union all select 'part::' || p_partkey, 'part', p_name from part union all select 'order::' || o_orderkey, 'order', o_orderstatus from orders"


@query(NODES)
def graph_nodes(spark, sf_dir):
    """Nodes of the knowledge graph: customers, suppliers, parts and orders."""
    t = lambda n: table(spark, sf_dir, n)
    return graphindex.nodes({"customer": (t("customer"), F.col("c_custkey"), F.col("c_name")), "supplier": (t("supplier"), F.col("s_suppkey"), F.col("s_name")), "part": (t("part"), F.col("p_partkey"), F.col("p_name")), "order": (t("orders"), F.col("o_orderkey"), F.col("o_orderstatus"))})


EDGES = """g as (
  select 'placed' as kind, 'customer::' || o_custkey as a, 'order::' || o_orderkey as b, 1.0::double as w from orders union all
  select 'holds', 'order::' || l_orderkey, 'part::' || l_partkey, l_quantity / 50 from lineitem union all select 'supplied', 'supplier::' || l_suppkey, 'part::' || l_partkey, 1 - l_discount from lineitem),
e as (select kind, a, b, max(w) as weight from g group by 1, 2, 3)"""


def graph(spark, sf_dir):
    line, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return graphindex.edges({"placed": (orders, named("customer", "o_custkey"), named("order", "o_orderkey"), None), "holds": (line, named("order", "l_orderkey"), named("part", "l_partkey"), F.col("l_quantity") / 50), "supplied": (line, named("supplier", "l_suppkey"), named("part", "l_partkey"), 1 - F.col("l_discount"))})


@query(f"with {EDGES} select kind, a, b, round(weight, 6) as weight, case when weight >= 0.85 then 'high' when weight >= 0.65 then 'medium' else 'low' end as confidence from e")
def graph_edges(spark, sf_dir):
    """Its edges, one for each kind and pair, with a band of confidence."""
    return graph(spark, sf_dir).withColumn("weight", F.round("weight", 6))


@query(f"with {EDGES} select node, sum(i)::bigint as n_in, sum(o)::bigint as n_out from (select a as node, 0 as i, 1 as o from e union all select b, 1, 0 from e) group by 1")
def graph_degrees(spark, sf_dir):
    """How many edges go into and out of each node."""
    return graphindex.degrees(graph(spark, sf_dir))


@query(f"""
with {EDGES}, r as (select 'order::' || (event_id % 15000) as b, count(*) as n, arg_max(event_type, event_id) as s from events group by 1)
select kind, e.a, e.b, coalesce(n, 0) as n_runs, s as last_status from e left join r using (b) where kind = 'placed'""")
def workspace_graph(spark, sf_dir):
    """Edges to orders with what ran on them."""
    runs = table(spark, sf_dir, "events").select(F.concat(F.lit("order::"), F.col("event_id") % 15000).alias("target"), F.col("event_id").alias("at"), F.col("event_type").alias("status"))
    return graphindex.overlaid(graph(spark, sf_dir).where("kind = 'placed'").select("kind", "a", "b"), runs, "b")


@query("""
with r as (select l_orderkey || '/' || l_linenumber as relation, {'ord': l_partkey * 1000000 + l_suppkey, 'type': l_returnflag, 'x': l_partkey, 'y': l_suppkey, 'c': 1 - 5 * l_discount} as r from lineitem), l as (select relation, max(r) as m from r group by 1)
select 'flow::' || relation as flow, case m.type when 'A' then 'input' when 'R' then 'output' end as edge, case when m.type = 'R' then m.y else m.x end as a, case when m.type = 'R' then m.x else m.y end as b, round(m.c, 6) as confidence, m.c < 0.6 as review from l where m.type in ('A', 'R')""")
def material_flows(spark, sf_dir):
    """What flows in and out, outputs turned round, the last relation of an id alone, doubtful ones for review."""
    line = table(spark, sf_dir, "lineitem")
    relations = line.select(F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("relation"), (F.col("l_partkey") * 1000000 + F.col("l_suppkey")).alias("ord"), F.col("l_returnflag").alias("type"), F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), (1 - 5 * F.col("l_discount")).alias("confidence"))
    return graphindex.flows(relations, {"A": ("input", False), "R": ("output", True)}).withColumn("confidence", F.round("confidence", 6))


@query("""
select 'holds' as kind, coalesce(case when l_discount > 0 then 'line::' || l_suppkey end, 'order::' || l_orderkey) as a, 'block::' || l_orderkey || '/' || l_linenumber as b from lineitem""")
def containment(spark, sf_dir):
    """What holds a block: its owner, else its document."""
    blocks = table(spark, sf_dir, "lineitem").withColumn("block", F.concat(F.lit("block::"), "l_orderkey", F.lit("/"), "l_linenumber"))
    return graphindex.contained(blocks, F.when(F.col("l_discount") > 0, named("line", "l_suppkey")), named("order", "l_orderkey"), "holds")


@query("""
with w as (select doc_id, md5(text) as source_hash, md5(coalesce(lang, '') || '|v2') as options_hash from documents), c as (select doc_id, case when doc_id % 3 = 0 then md5(text || 'x') else md5(text) end as source_hash, md5(coalesce(lang, '') || case when doc_id % 5 = 0 then '|v1' else '|v2' end) as options_hash from documents where doc_id % 7 <> 0)
select w.* from w where not exists (select 1 from c where c.doc_id = w.doc_id and c.source_hash = w.source_hash and c.options_hash = w.options_hash)""")
def cache_misses(spark, sf_dir):
    """Documents that an incremental run must work on again: new, of another text, or with other options."""
    docs, k, lang = table(spark, sf_dir, "documents"), F.col("doc_id"), F.coalesce("lang", F.lit(""))
    work = docs.select("doc_id", F.md5("text").alias("source_hash"), F.md5(F.concat(lang, F.lit("|v2"))).alias("options_hash"))
    cache = docs.where("doc_id % 7 <> 0").select("doc_id", F.when(k % 3 == 0, F.md5(F.concat("text", F.lit("x")))).otherwise(F.md5("text")).alias("source_hash"), F.md5(F.concat(lang, F.when(k % 5 == 0, "|v1").otherwise("|v2"))).alias("options_hash"))
    return graphindex.misses(work, cache, ["doc_id", "source_hash", "options_hash"])


@query("""
with r as (select event_id, user_id, event_id // 100 as version from events), s as (select user_id, max(event_id) // 100 as version from events where event_type <> 'error' group by 1)
select event_id, r.user_id, r.version, not coalesce(s.version = r.version, false) as stale from r left join s using (user_id)""")
def stale_results(spark, sf_dir):
    """Results made for a version that has gone by."""
    e = table(spark, sf_dir, "events")
    states = e.where("event_type <> 'error'").groupBy("user_id").agg(F.expr("max(event_id) div 100").alias("version"))
    return graphindex.current(e.select("event_id", "user_id", F.expr("event_id div 100").alias("version")), states, "user_id", "version").select("event_id", "user_id", "version", "stale")


@query("""
with n as (select p_partkey, nullif(trim(case when p_size % 4 = 0 then '  ' when p_size % 4 = 1 then null else p_name || '>>' || p_type end), '') as notation from part)
select p_partkey, notation, sha256(p_partkey || '|' || coalesce(notation, '')) as source_hash, case when notation is null then 'missing_notation' end as skipped from n""")
def job_inputs(spark, sf_dir):
    """Parts as the input of a job, with those that are skipped."""
    size = F.col("p_size")
    notation = F.when(size % 4 == 0, "  ").when(size % 4 == 1, None).otherwise(F.concat("p_name", F.lit(">>"), "p_type"))
    return graphindex.jobs(table(spark, sf_dir, "part"), "p_partkey", notation)


@query("""
with a as (select o_orderkey as artifact, o_orderdate as made, count(distinct l_partkey) filter (where l_partkey in (select p_partkey from part where p_size < 10)) as n_known from orders join lineitem on l_orderkey = o_orderkey group by 1, 2)
select * from a where n_known > 0 order by made desc, artifact limit 1""")
def newest_artifact(spark, sf_dir):
    """The newest order that holds a part that is known."""
    parts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("artifact")).agg(F.collect_set("l_partkey").alias("ids"))
    artifacts = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("artifact"), F.col("o_orderdate").alias("made")).join(parts, "artifact")
    return graphindex.newest_overlapping(artifacts, "ids", table(spark, sf_dir, "part").where("p_size < 10").select(F.col("p_partkey").alias("id")), ["made"])


@query("select 'doc' || user_id || '.md' as path, arg_max(event_type, event_id) as state, max(event_id) as event_id from events group by 1")
def change_feed(spark, sf_dir):
    """The last state of each path of a feed of changes."""
    feed = table(spark, sf_dir, "events").select(F.concat(F.lit("doc"), "user_id", F.lit(".md")).alias("path"), "event_id", F.col("event_type").alias("state"))
    return graphindex.changed_paths(feed, "path", "event_id")


@query("""
with x as (select 1 as origin, l_partkey as name, l_orderkey % 100 as place, l_suppkey as who from lineitem where l_returnflag = 'A' union all select 2, l_partkey, l_orderkey % 100, l_suppkey from lineitem where l_returnflag = 'R')
select name, place, min({'origin': origin, 'who': who}).origin::int as origin, min({'origin': origin, 'who': who}).who as who from x group by 1, 2""")
def merged_mentions(spark, sf_dir):
    """Mentions of two lists by name and place, those of the first list first."""
    part = lambda f: table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == f).select(F.col("l_partkey").alias("name"), (F.col("l_orderkey") % 100).alias("place"), F.col("l_suppkey").alias("who"))
    return graphindex.first_wins([part("A"), part("R")], ["name", "place"])


TASKS = """
select 'classification' as task, 'classification::' || d.doc_id as id, md5(text) as input_md5, quality::varchar as target from documents d join labels l using (doc_id) where trim(text) <> '' and quality is not null union all
select 'summary', 'summary::' || doc_id, md5(text), lang from documents where trim(text) <> '' and lang is not null union all
select 'reply', 'reply::' || a.conv_id || '/' || a.turn, md5(a.text), md5(b.text) from conversations a join conversations b on b.conv_id = a.conv_id and b.turn = a.turn + 1 where a.role = 'user' and b.role = 'assistant' and trim(a.text) <> '' union all
select 'benchmark', 'benchmark::' || item_id, md5(text), length(text)::varchar from benchmark where trim(text) <> ''"""


@query(TASKS)
def task_projections(spark, sf_dir):
    """Training examples of several tasks from one corpus."""
    t = lambda n: table(spark, sf_dir, n)
    labelled = t("documents").join(t("labels"), "doc_id")
    talk = t("conversations")
    nxt = talk.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("role").alias("next_role"), F.col("text").alias("next"))
    replies = talk.join(nxt, ["conv_id", "turn"]).where("role = 'user' and next_role = 'assistant'")
    found = graphindex.tasks({
        "classification": (labelled, F.col("doc_id"), F.col("text"), F.col("quality")), "summary": (t("documents"), F.col("doc_id"), F.col("text"), F.col("lang")),
        "reply": (replies, F.concat_ws("/", "conv_id", "turn"), F.col("text"), F.md5("next")), "benchmark": (t("benchmark"), F.col("item_id"), F.col("text"), F.length("text")),
    })
    return found.select("task", "id", F.md5("input").alias("input_md5"), "target")


@query(f"with t as ({TASKS}) select task, count(*) as n, count(distinct target) as n_targets from t group by 1")
def campaign_tasks(spark, sf_dir):
    """How many examples and targets each task has."""
    return task_projections(spark, sf_dir).groupBy("task").agg(F.count("*").alias("n"), F.count_distinct("target").alias("n_targets"))


@query("""
select o_orderkey, o_orderstatus as status, case when o_totalprice > 100000 then o_totalprice end as total, c_mktsegment as segment, case when c_acctbal > 0 then c_acctbal end as balance, 2 + (case when o_totalprice > 100000 then 1 else 0 end + case when c_acctbal > 0 then 1 else 0 end)::int as n_known
from orders join customer on c_custkey = o_custkey""")
def prediction_features(spark, sf_dir):
    """An order's features by kind, as maps of what is known."""
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    found = graphindex.features(rows, "o_orderkey", {"status": F.col("o_orderstatus")}, {"total": F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice")), "balance": F.when(F.col("c_acctbal") > 0, F.col("c_acctbal"))}, {"segment": F.col("c_mktsegment")})
    return found.select("o_orderkey", F.col("categorical")["status"].alias("status"), F.col("numeric")["total"].alias("total"), F.col("text")["segment"].alias("segment"), F.col("numeric")["balance"].alias("balance"), "n_known")


@query("""
with a as (select user_id as k, count(*) as n from events where event_type = 'click' group by 1), o as (select o_custkey as k, count(*) as n from orders group by 1),
b as (select coalesce(a.k, o.k) as k, coalesce(a.n, 0) as n_attempts, coalesce(o.n, 0) as n_outcomes from a full join o on a.k = o.k)
select *, case when n_outcomes = 0 then 'no_outcome' when n_attempts = 0 then 'no_attempt' else 'too_many_outcomes' end as problem from b where n_outcomes = 0 or n_attempts = 0 or n_outcomes > n_attempts""")
def outcome_consistency(spark, sf_dir):
    """Attempts and outcomes that do not fit each other."""
    attempts = table(spark, sf_dir, "events").where("event_type = 'click'").select(F.col("user_id").alias("k"))
    return graphindex.inconsistent(attempts, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), "k")


@query("""
select o_orderkey, o_custkey % 2000 as part, o_custkey % 2000 in (select l_partkey from lineitem where l_orderkey = o_orderkey) as belongs from orders""")
def result_members(spark, sf_dir):
    """Whether a result's product is one of its order's parts."""
    results = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 2000).alias("part"))
    members = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("part"))
    return graphindex.foreign_results(results, members, "o_orderkey", "part")


@query("select page_id as id, page_id % 3 > 0 and (trim(url) <> '' or length(html) > 100) as citable from pages")
def citable_evidence(spark, sf_dir):
    """Evidence that can be cited: an id, a label and a place."""
    rows = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.when(F.col("page_id") % 3 > 0, "page").alias("label"), "url", F.when(F.length("html") > 100, "html").alias("part"))
    return graphindex.citable(rows, ["url", "part"]).select("id", "citable")


@query("select 'run::' || user_id as run, event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as at, case event_type when 'view' then 'step_started' when 'purchase' then 'step_completed' when 'error' then 'step_failed' else 'note' end as kind, json_extract_string(props, '$.k') as k from events")
def trace_events(spark, sf_dir):
    """Runtime events as trace events, with times in one form."""
    kind = F.when(F.col("event_type") == "view", "step_started").when(F.col("event_type") == "purchase", "step_completed").when(F.col("event_type") == "error", "step_failed").otherwise("note")
    return table(spark, sf_dir, "events").select(named("run", "user_id").alias("run"), "event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at"), kind.alias("kind"), F.get_json_object("props", "$.k").alias("k"))


@query("""
select 'plan::' || o_orderkey as plan, count(*) as n_steps, count(distinct l_suppkey) as n_devices, max(l_quantity) as greatest, min(l_shipdate) as earliest, bool_or(l_discount > 0.08) as needs_review from orders join lineitem on l_orderkey = o_orderkey where o_orderstatus <> 'P' group by 1""")
def run_plans(spark, sf_dir):
    """Plans of runs: an order's lines as steps, its suppliers as devices."""
    steps = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return steps.groupBy(named("plan", "o_orderkey").alias("plan")).agg(F.count("*").alias("n_steps"), F.count_distinct("l_suppkey").alias("n_devices"), F.max("l_quantity").alias("greatest"), F.min("l_shipdate").alias("earliest"), F.bool_or(F.col("l_discount") > 0.08).alias("needs_review"))


@query("""
with o as (select p_partkey, u.level as level, u.symbol as symbol from (select p_partkey, unnest([{'level': 'kind', 'symbol': p_type}, {'level': 'kind.brand', 'symbol': p_brand}, {'level': 'kind.brand.name', 'symbol': p_name}]) as u from part))
select level, symbol, count(*) as n, min(p_partkey) as first_id from o group by 1, 2""")
def outline_symbols(spark, sf_dir):
    """A nested outline as flat rows of level and symbol."""
    nested = F.array(*[F.struct(F.lit(level).alias("level"), F.col(c).alias("symbol")) for level, c in (("kind", "p_type"), ("kind.brand", "p_brand"), ("kind.brand.name", "p_name"))])
    return table(spark, sf_dir, "part").select("p_partkey", F.inline(nested)).groupBy("level", "symbol").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_id"))


@query("select p_partkey, array_to_string(list_filter(list_transform(range(1, len(ws) + 1), lambda i: case when list_position(ws, ws[i]) = i then ws[i] end), lambda x: x is not null), ' ') as words from (select p_partkey, string_split(p_name || ' ' || p_type || ' ' || p_name, ' ') as ws from part)")
def deduped_words(spark, sf_dir):
    """Words in the order of their first place, each once."""
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_distinct(F.split(F.concat_ws(" ", "p_name", "p_type", "p_name"), " ")), " ").alias("words"))


@query(f"""
with t as (select item_id, (abs(item_id) * 7 + 3) % (select count(*) from embeddings) as vec from benchmark), p as (select t.item_id, e.vec_id as other, round({COS.format(a='q.embedding', b='e.embedding')}, 9) as c from t join embeddings q on q.vec_id = t.vec join embeddings e on e.vec_id <> q.vec_id)
select item_id, other, round(c, 6) as cosine, place from (select *, row_number() over (partition by item_id order by c desc, other)::int as place from p) where place <= 3""")
def text_searches(spark, sf_dir):
    """Texts turned to vectors (each benchmark item by a vector that its id names), and their nearest rows."""
    rows = table(spark, sf_dir, "embeddings")
    n = rows.count()
    items = table(spark, sf_dir, "benchmark").select("item_id", ((F.abs("item_id") * 7 + 3) % n).alias("vec_id"))
    asked = stash(items.select("vec_id").distinct().join(rows, "vec_id").select("vec_id", "embedding"), "asked")
    found = similarity.top_neighbours(rows, asked, 3)
    return items.join(found, "vec_id").select("item_id", "other", F.round("cosine", 6).alias("cosine"), "place")
