"""Text, quantities, references, rules and chunks over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import chunks, expressions, quality, text
from ..tables import table
from .registry import query

TERMS = ["scum", "clown", "moron", "idiot", "mail"]


@query(rf"""
with t as (select doc_id, lower(text) as l, unnest({TERMS}) as term from documents),
m as (select doc_id, term, len(regexp_extract_all(' ' || regexp_replace(l, '([^a-z0-9_])', '\1 ', 'g') || ' ', '[^a-z0-9_]' || term || '[^a-z0-9_]')) as n from t)
select doc_id, term, n::int as n from m where n > 0""")
def mentions(spark, sf_dir):
    """Whole-word mentions of a small lexicon."""
    return text.mentions(table(spark, sf_dir, "documents"), "doc_id", "text", TERMS).select("doc_id", "term", "n")


@query("""
with r as (select page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) as t from pages), u as (select page_id, unnest(range(len(t))) as position, t from r)
select page_id, position::int as position, t[position + 1] as target, case when regexp_matches(t[position + 1], '^[a-z]+://') then 'absolute' when starts_with(t[position + 1], '/') then 'root' when starts_with(t[position + 1], '#') then 'fragment' else 'relative' end as scheme from u""")
def references(spark, sf_dir):
    """Links of pages in page order."""
    return text.links(table(spark, sf_dir, "pages"), "page_id", "html")


PATH = r"regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]*', '')"
LAST = rf"list_last(string_split(regexp_replace({PATH}, '/+$', ''), '/'))"


@query(rf"""
with a as (select page_id, list_filter(list_distinct([{PATH}, {LAST}, regexp_replace({LAST}, '\.[A-Za-z0-9]+$', '')]), lambda x: x <> '') as a, regexp_extract(url, '://([^/]*)', 1) as host from pages),
t as (select page_id, unnest(a) as name, host from a),
r as (select p_partkey as ref, '' || (35000 + p_partkey) as name, 'm.thering.example.org' as host from part),
m as (select ref, count(t.page_id) as n, count_if(t.page_id is not null and t.host = r.host) as s, min(t.page_id) as any_, min(case when t.host = r.host then t.page_id end) as own from r left join t on r.name = t.name group by 1)
select ref, case when k = 0 then 'unresolved' when k = 1 then 'resolved' else 'ambiguous' end as status, k::bigint as n_matches, case when k = 1 then coalesce(own, any_) end as target
from (select *, case when s > 0 then s else n end as k from m)""")
def resolve_references(spark, sf_dir):
    """Names looked up among the aliases of page urls, those of the same host first."""
    pages = table(spark, sf_dir, "pages")
    targets = pages.select(F.col("page_id").alias("target"), F.explode(text.aliases(F.col("url"))).alias("name"), F.regexp_extract("url", "://([^/]*)", 1).alias("host"))
    refs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ref"), (F.col("p_partkey") + 35000).cast("string").alias("name"), F.lit("m.thering.example.org").alias("host"))
    return text.resolve(refs, targets, "host")


@query(r"""
with s as (select l_orderkey, l_linenumber, case l_linenumber % 5 when 0 then '~' || l_quantity::int || ' mg' when 1 then l_quantity::int || '-' || (l_quantity::int + 2) || ' mL' when 2 then 'rt' when 3 then l_quantity::int || ' +/- 2 mmol' else 'about ' || l_quantity::int end as q from lineitem)
select l_orderkey, l_linenumber, q, nullif(regexp_extract(q, '^(~)', 1), '') as comparator, case when q = 'rt' then 25 else try_cast(regexp_extract(q, '^~?([0-9]+)', 1) as double) end as low,
  try_cast(regexp_extract(q, '^[0-9]+-([0-9]+)', 1) as double) as high, try_cast(regexp_extract(q, ' \+/- ([0-9]+)', 1) as double) as uncertainty,
  case when q = 'rt' then 'C' when q like 'about%' then null else regexp_extract(q, '([A-Za-z]+)$', 1) end as unit from s""")
def quantity_parse(spark, sf_dir):
    """Quantities written in five ways, read back into their parts."""
    n = F.col("l_quantity").cast("int")
    kind = F.col("l_linenumber") % 5
    q = F.when(kind == 0, F.concat(F.lit("~"), n, F.lit(" mg"))).when(kind == 1, F.concat(n, F.lit("-"), n + 2, F.lit(" mL"))).when(kind == 2, "rt").when(kind == 3, F.concat(n, F.lit(" +/- 2 mmol"))).otherwise(F.concat(F.lit("about "), n))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", q.alias("q"))
    return rows.withColumns(text.quantity(F.col("q")))


@query("""
with u(u, f, k) as (values ('mg', 0.001::double, 'mass'), ('g', 1, 'mass'), ('kg', 1000, 'mass'), ('mmol', 0.001, 'amount'), ('mL', 0.001, 'volume')),
s as (select l_orderkey, l_linenumber, l_quantity as v, case l_linenumber % 4 when 0 then 'mg' when 1 then 'kg' when 2 then 'mmol' else 'mL' end as unit from lineitem)
select l_orderkey, l_linenumber, unit, case when k = 'mass' then round(v * f / 1.0, 6) end as grams from s join u on u.u = s.unit""")
def unit_convert(spark, sf_dir):
    kind = F.col("l_linenumber") % 4
    unit = F.when(kind == 0, "mg").when(kind == 1, "kg").when(kind == 2, "mmol").otherwise("mL")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", unit.alias("unit"), F.round(expressions.to_unit(F.col("l_quantity"), unit, "g"), 6).alias("grams"))


RULES = [("metal", ["steel", "brass", "copper", "nickel", "tin"]), ("finish", ["polished", "brushed", "anodized", "burnished", "plated"]), ("size", ["small", "medium", "large", "economy"])]


@query("select p_partkey, case " + " ".join(f"when {' or '.join(f"contains(lower(p_type), '{w}')" for w in words)} then '{name}'" for name, words in RULES) + " else 'other' end as family from part")
def taxonomy(spark, sf_dir):
    """Ordered keyword rules, the first that holds."""
    return table(spark, sf_dir, "part").select("p_partkey", text.first_rule(F.col("p_type"), RULES, "other").alias("family"))


@query("""
with x as (select o_orderkey as id, o_custkey, epoch(o_orderdate)::bigint // 86400 as s, epoch(o_orderdate)::bigint // 86400 + 30 as e from orders)
select a.id as left_id, b.id as right_id from x a join x b on a.o_custkey = b.o_custkey and a.id % 2 = 0 and b.id % 2 = 1 and a.s < b.e and b.s < a.e""")
def span_overlap(spark, sf_dir):
    """Orders as spans of 30 days: which of a customer's even ones overlap which odd ones."""
    day = F.floor(F.unix_timestamp("o_orderdate") / 86400)
    spans = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", day.alias("start"), (day + 30).alias("end"))
    return text.overlaps(spans.where("id % 2 = 0"), spans.where("id % 2 = 1"), "o_custkey", 30)


@query("""
select doc_id, trim(coalesce(text, '')) <> '' as rag_eligible, trim(coalesce(text, '')) <> '' and e = 0 as sft_eligible, e > 0 or w >= 5 as review_required, round(greatest(0, 1 - 0.02 * w - 0.1 * e), 4)::double as confidence,
  concat_ws('+', case when e > 0 then 'has_errors' end, case when trim(coalesce(text, '')) = '' then 'blank_text' end, case when w >= 5 then 'many_warnings' end) as reasons
from (select d.doc_id, text, coalesce(l.toxic, 0) + (1 - coalesce(l.quality, 1)) as e, d.n_chars // 2000 as w from documents d left join labels l using (doc_id))""")
def quality_flags(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    errors = F.coalesce("toxic", F.lit(0)) + (1 - F.coalesce("quality", F.lit(1)))
    out = quality.eligibility(rows, F.expr("n_chars div 2000"), errors, F.col("text"))
    return out.select("doc_id", "rag_eligible", "sft_eligible", "review_required", "confidence", "reasons")


@query("""
select * from (select l_orderkey, l_linenumber, concat_ws('+', case when l_discount > 0.08 then 'deep_discount' end, case when l_quantity < 3 then 'low_quantity' end, case when l_tax = 0 then 'no_tax' end, case when l_returnflag = 'R' then 'returned' end) as signals from lineitem) where signals <> ''""")
def failure_signals(spark, sf_dir):
    limits = [("deep_discount", F.col("l_discount") > 0.08), ("low_quantity", F.col("l_quantity") < 3), ("no_tax", F.col("l_tax") == 0), ("returned", F.col("l_returnflag") == "R")]
    return quality.failure_signals(table(spark, sf_dir, "lineitem"), limits).select("l_orderkey", "l_linenumber", "signals")


@query("""
with r as (select p_partkey, p_size - 20 as low, p_size as high from part)
select l_orderkey, l_linenumber, l_quantity, case when l_quantity < low then 'below' else 'above' end as issue from lineitem join r on p_partkey = l_partkey where l_quantity < low or l_quantity > high""")
def range_preflight(spark, sf_dir):
    """Line items whose quantity is outside the range of their part."""
    ranges = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), (F.col("p_size") - 20).alias("low"), F.col("p_size").alias("high"))
    found = quality.out_of_range(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity"), ranges, "l_partkey", "l_quantity")
    return found.select("l_orderkey", "l_linenumber", "l_quantity", "issue")


@query("""
select p_partkey, coalesce(n, 0)::bigint as n_lines, case when n is null then 'unavailable' when last_ < timestamp '1998-06-01' then 'expired' else 'available' end as stock
from part left join (select l_partkey, count(*) as n, max(l_shipdate) as last_ from lineitem group by 1) on l_partkey = p_partkey""")
def inventory(spark, sf_dir):
    used = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"), F.max("l_shipdate").alias("last"))
    stock = F.when(F.col("n").isNull(), "unavailable").when(F.col("last") < F.lit("1998-06-01").cast("timestamp"), "expired").otherwise("available")
    return table(spark, sf_dir, "part").select("p_partkey").join(used, "p_partkey", "left").select("p_partkey", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_lines"), stock.alias("stock"))


@query("""
select 'documents::' || doc_id as chunk_id, 'documents' as kind, length(text) as n_chars, md5(text) as text_md5 from documents where trim(text) <> ''
union all select 'benchmark::' || item_id, 'benchmark', length(text), md5(text) from benchmark where trim(text) <> ''
union all select 'conversations::' || conv_id || '/' || turn, 'conversations', length(text), md5(text) from conversations where trim(text) <> ''
union all select 'pages::' || page_id, 'pages', length(t), md5(t) from (select page_id, trim(regexp_replace(html, '(?s)<(?:script|style)[^>]*>.*?</(?:script|style)>|<[^>]*>|[ \n\t]+', ' ', 'g')) as t from pages) where t <> ''""")
def retrieval_chunks(spark, sf_dir):
    """Texts of several tables as chunks; a page's text is its html without scripts, styles and marks."""
    t = lambda n: table(spark, sf_dir, n)
    col = F.col
    found = chunks.chunks([
        ("documents", t("documents"), col("doc_id"), col("text")), ("benchmark", t("benchmark"), col("item_id"), col("text")),
        ("conversations", t("conversations"), F.concat_ws("/", "conv_id", "turn"), col("text")), ("pages", t("pages"), col("page_id"), F.trim(F.regexp_replace("html", r"(?s)<(?:script|style)[^>]*>.*?</(?:script|style)>|<[^>]*>|[ \n\t]+", " "))),
    ])
    return found.select("chunk_id", "kind", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("text_md5"))


@query("""
select 'customer::' || c_custkey as subject, u.field as field, u.value as value from (
  select c_custkey, unnest([{'field': 'c_name', 'value': c_name}, {'field': 'c_mktsegment', 'value': c_mktsegment}, {'field': 'c_nationkey', 'value': c_nationkey::varchar}]) as u from customer) where u.value is not null""")
def field_evidence(spark, sf_dir):
    return chunks.field_evidence(table(spark, sf_dir, "customer"), F.concat(F.lit("customer::"), "c_custkey"), ["c_name", "c_mktsegment", "c_nationkey"])


@query("""
with m as (select conv_id, count(*) as n_messages, string_agg(role, ',' order by turn) as roles, bool_or(again) as again from (select *, role is not distinct from lag(role) over (partition by conv_id order by turn) as again from conversations) group by 1)
select conv_id, n_messages::int as n_messages, not again as alternates from m""")
def task_dataset(spark, sf_dir):
    """Conversations as training examples."""
    return chunks.conversations(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text").select("conv_id", "n_messages", "alternates")


@query("select event_id, user_id, (props->>'k')::int as k from events where (props->>'k')::int > 50 or (event_type = 'error' and not user_id in (1, 2, 3))")
def json_filter(spark, sf_dir):
    """A condition given as data, over a JSON field."""
    rows = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    wanted = expressions.condition({"or": [{"field": "k", "op": ">", "value": 50}, {"and": [{"field": "event_type", "op": "==", "value": "error"}, {"not": {"field": "user_id", "in": [1, 2, 3]}}]}]})
    return rows.where(wanted).select("event_id", "user_id", "k")


@query("""
with f as (select doc_id, source, n_chars from documents where lang = 'fr' and contains(lower(text), 'eau'))
select doc_id, source, n_chars, (select count(*) from f) as total_count from f order by doc_id limit 50 offset 10""")
def listing_page(spark, sf_dir):
    """A page of a filtered listing with the total count."""
    rows = table(spark, sf_dir, "documents").where(expressions.all_of(lang="fr", source=None) & F.contains(F.lower("text"), F.lit("eau"))).select("doc_id", "source", "n_chars")
    total = rows.agg(F.count("*").alias("total_count"))
    return rows.orderBy("doc_id").offset(10).limit(50).crossJoin(F.broadcast(total))


@query("""
with c as (select p_partkey, p_name, list_transform(string_split(p_name, ''), lambda x: ascii(x)::ubigint) as c from part)
select p_partkey, lpad(lower(hex(list_reduce(list_prepend(2166136261::ubigint, c), lambda h, x: ((xor(h, x) * 16777619) & 4294967295)::ubigint))), 8, '0') as fnv, sha256(p_name) as sha, md5(p_name) as md5 from c""")
def fnv_ids(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", scalars.fnv1a(F.col("p_name")).alias("fnv"), F.sha2("p_name", 256).alias("sha"), F.md5("p_name").alias("md5"))


@query("""
with s as (select l_orderkey, sum(l_quantity) as q, sum(l_extendedprice::decimal(18, 4))::double as e, sum((l_extendedprice * l_discount)::decimal(18, 4))::double as d from lineitem group by 1)
select l_orderkey, round(d * 100 / e, 4) as discount_percent, round(d / e, 6) as discount_ratio, case when q >= 150 then 'high' when q >= 60 then 'medium' else 'low' end as band from s""")
def derived_fields(spark, sf_dir):
    """Percent, ratio and band of sums, added up as decimals so that their order does not matter."""
    money = lambda c: F.sum(c.cast("decimal(18,4)")).cast("double")
    s = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q"), money(F.col("l_extendedprice")).alias("e"), money(F.col("l_extendedprice") * F.col("l_discount")).alias("d"))
    return s.select("l_orderkey", F.round(expressions.percent(F.col("d"), F.col("e")), 4).alias("discount_percent"), F.round(expressions.ratio(F.col("d"), F.col("e")), 6).alias("discount_ratio"), scalars.band(F.col("q"), 150, 60).alias("band"))


@query("select p_partkey, concat_ws('|', 'brand=' || p_brand, 'type=' || nullif(p_type, ''), 'size=' || p_size) as condition_signature from part")
def condition_signatures(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", scalars.signature([("brand", F.col("p_brand")), ("type", F.col("p_type")), ("size", F.col("p_size"))]).alias("condition_signature"))
