"""Vector search, similarity and clusters over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunks, similarity
from ..operators.quality import common_value
from ..tables import stash, table
from .registry import query

COS = "(list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1]::double * p[2]::double)) / sqrt(list_sum(list_transform({a}, lambda x: x::double * x::double))) / sqrt(list_sum(list_transform({b}, lambda x: x::double * x::double))))"
DISTANCE = {
    "cosine": f"1 - {COS.format(a='e.embedding', b='q.v')}",
    "l2": "sqrt(list_sum(list_transform(list_zip(e.embedding, q.v), lambda p: (p[1]::double - p[2]::double) * (p[1]::double - p[2]::double))))",
    "inner_product": "-list_sum(list_transform(list_zip(e.embedding, q.v), lambda p: p[1]::double * p[2]::double))",
}


@query(f"""
with p as (select a.vec_id, b.vec_id as other, round({COS.format(a='a.embedding', b='b.embedding')}, 9) as c
  from embeddings a join embeddings b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0)
select vec_id, other, round(c, 6) as cosine, place from (select *, row_number() over (partition by vec_id order by c desc, other)::int as place from p) where place <= 5""")
def cosine_neighbours(spark, sf_dir):
    """Searches: every row whose id is divisible by 20, against all rows."""
    rows = table(spark, sf_dir, "embeddings")
    found = similarity.top_neighbours(rows, rows.where("vec_id % 20 = 0"), 5)
    return found.withColumn("cosine", F.round("cosine", 6))


@query("""
select d.doc_id, e.vec_id is not null as has_embedding, length(d.text) as n_chars
from documents d left join embeddings e on d.doc_id = e.vec_id""")
def embedding_backfill(spark, sf_dir):
    """Documents with a flag whether their vector exists."""
    known = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(True).alias("known"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("bigint").alias("n_chars"))
    return docs.join(known, "doc_id", "left").select("doc_id", F.col("known").isNotNull().alias("has_embedding"), "n_chars")


def searches(spark: SparkSession, sf_dir: str, metric: str, k: int, where=()) -> DataFrame:
    """The k nearest of every row whose id is divisible by 20, itself left out."""
    rows = table(spark, sf_dir, "embeddings")
    found = similarity.top_neighbours(rows, rows.where("vec_id % 20 = 0"), k, metric=metric, where=where)
    return found.withColumn("distance", F.round("distance", 6) + 0.0)


def searches_sql(metric: str, k: int, where: str = "true") -> str:
    return f"select vec_id, other, round(d, 6) + 0.0 as distance, place from (select *, row_number() over (partition by vec_id order by d, other)::int as place from (select q.vec_id, e.vec_id as other, round({DISTANCE[metric]}, 9) as d from embeddings e, (select vec_id, embedding as v from embeddings where vec_id % 20 = 0) q where e.vec_id <> q.vec_id and {where})) where place <= {k}"


@query(searches_sql("cosine", 8))
def knn_cosine(spark, sf_dir):
    return searches(spark, sf_dir, "cosine", 8)


@query(searches_sql("l2", 8))
def knn_l2(spark, sf_dir):
    return searches(spark, sf_dir, "l2", 8)


@query(searches_sql("inner_product", 8))
def knn_inner_product(spark, sf_dir):
    return searches(spark, sf_dir, "inner_product", 8)


@query(searches_sql("cosine", 8, "label in (1, 2, 3)"))
def knn_filtered(spark, sf_dir):
    return searches(spark, sf_dir, "cosine", 8, [F.col("label").isin(1, 2, 3)])


@query(f"""
with h as ({searches_sql('cosine', 50)})
select h.vec_id, other, distance, place, lang, url,
  concat_ws('+', case when lang is null or trim(lang) = '' then 'lang' end, case when url is null or trim(url) = '' then 'url' end) as missing,
  not (lang is null or trim(lang) = '' or url is null or trim(url) = '') as citable
from h left join documents on doc_id = other left join pages on page_id = other""")
def retrieval_with_citations(spark, sf_dir):
    """The fifty nearest of every row whose id is divisible by 20, with their documents and pages; hits that lack a field are not citable."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("other"), "lang")
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("other"), "url")
    return chunks.citations(searches(spark, sf_dir, "cosine", 50).join(docs, "other", "left").join(pages, "other", "left"), ["lang", "url"])


@query("""
with k as (select p_partkey, unnest([{'basis': 'brand', 'value': p_brand}, {'basis': 'type', 'value': p_type}, {'basis': 'size', 'value': p_size::varchar}]) as k from part)
select k.basis as basis, k.value as value, count(distinct p_partkey) as n_members, min(p_partkey) as first_member, max(p_partkey) as last_member
from k group by all having count(distinct p_partkey) >= 2""")
def feature_clusters(spark, sf_dir):
    """Clusters by key: members that share a brand, a type or a size."""
    k = F.array(*[F.struct(F.lit(b).alias("basis"), F.col(c).cast("string").alias("value")) for b, c in (("brand", "p_brand"), ("type", "p_type"), ("size", "p_size"))])
    keys = table(spark, sf_dir, "part").select("p_partkey", F.explode(k).alias("k"))
    found = keys.groupBy("k.basis", "k.value").agg(F.count_distinct("p_partkey").alias("n_members"), F.min("p_partkey").alias("first_member"), F.max("p_partkey").alias("last_member"))
    return found.where("n_members >= 2")


@query("""
with p as (select p_brand, p_size, count(*) as n, count(distinct p_type) as t, min(p_type) as t0, count(distinct p_retailprice) as r, min(p_retailprice) as r0 from part group by all)
select p_brand as brand, n, case when t = 1 then t0 end as p_type, case when r = 1 then r0 end as p_retailprice, p_size from p""")
def cluster_profiles(spark, sf_dir):
    """What all members of a cluster have in common."""
    rows = table(spark, sf_dir, "part").withColumn("c", F.struct("p_brand", "p_size"))
    return common_value(rows, "c", ["p_type", "p_retailprice"]).select(F.col("c.p_brand").alias("brand"), "n", "p_type", "p_retailprice", F.col("c.p_size").alias("p_size"))


@query("""
with c as (select s_nationkey as nation, floor(s_acctbal / 2000)::bigint as band, min(s_suppkey) as id, count(*) as n from supplier group by 1, 2)
select x.id as a, y.id as b, x.n as n_a, y.n as n_b, concat_ws('+', case when x.band = y.band then 'band' end, case when x.nation = y.nation then 'nation' end) as basis,
  case when x.band = y.band then 0.75 else 0.55 end::double as score, case when x.band = y.band then 'medium' else 'low' end as confidence
from c x join c y on (x.nation = y.nation or x.band = y.band) and (x.id < y.id or x.id = y.id and x.n > 1)""")
def semantic_pairs(spark, sf_dir):
    """Pairs of supplier classes that share a nation or a balance band; classes stand for all their members."""
    rows = table(spark, sf_dir, "supplier")
    return similarity.class_pairs(rows, "s_suppkey", {"nation": F.col("s_nationkey"), "band": F.floor(F.col("s_acctbal") / 2000)}, {"nation": 0.55, "band": 0.75})


@query("""
with s as (select user_id, list_sort(list(distinct strftime(ts, '%j') || event_type)) as s from events group by 1),
c as (select s, min(user_id) as c, count(*) as n from s group by 1),
l as (select x.c, sum(y.n) as m from c x join c y on x.c <> y.c and 100 * len(list_intersect(x.s, y.s)) >= 40 * len(list_distinct(list_concat(x.s, y.s))) group by 1)
select user_id, c.c as class_id, (coalesce(m, 0) + n - 1)::bigint as n_links from s join c using (s) left join l using (c)""")
def tanimoto_links(spark, sf_dir):
    """Users by the set of their (day, event type) bits: class of equal sets, and number of users of Tanimoto 0.4 or more."""
    bits = F.collect_set(F.concat(F.date_format("ts", "DDD"), "event_type"))
    sets = table(spark, sf_dir, "events").groupBy("user_id").agg(bits.alias("bits"))
    return similarity.tanimoto_links(sets, "user_id", "bits", 40)


#: The least score of an edge; those below are no candidates.
LEAST = similarity.CANDIDATE
HYBRID = f"""
k as (select embedding as v, label as l, min(vec_id) as c from embeddings group by 1, 2),
n as (select x.c as a, y.c as b, x.l as la, y.l as lb, x.v as va, y.v as vb from k x join k y on x.c < y.c union all select c, vec_id, l, l, v, v from k join embeddings on embedding = v and label = l and vec_id <> c),
s as (select a, b, la = lb as same, round({COS.format(a='va', b='vb')}, 9) as emb, list_filter(range(64), lambda i: va[i + 1] > 0) as x, list_filter(range(64), lambda i: vb[i + 1] > 0) as y from n),
f as (select a, b, same, emb, case when len(list_distinct(list_concat(x, y))) = 0 then 0 else round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 9) end as fp from s),
h as (select a, b, round(case when same then 0.2 * 0.95 else 0 end + 0.3 * fp + 0.25 * emb + (1 - (case when same then 0.2 else 0 end + 0.3 + 0.25)) * fp, 6) as score,
  concat_ws('+', case when same then 'semantic' end, 'fingerprint', 'embedding') as basis from f),
g as (select * from h where score >= {LEAST})"""


@query(f"with {HYBRID} select a, b, score, basis, true as computed, false as conflict, case when score >= 0.75 then 'strict' else 'candidate' end as class from g")
def hybrid_edges(spark, sf_dir):
    """Candidate edges between all vectors, whatever their ids, scored by cosine, sign bits and equal labels; copies are linked to the first of their class."""
    return similarity.similar_edges(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label", LEAST)


@query(f"""
with recursive {HYBRID},
w as (select a as u, b as v from g union select b, a from g union select a, a from g union select b, b from g),
r as (select u as node, u as low from w union select w.v, r.low from r join w on w.u = r.node),
m as (select node, min(low) as c from r group by 1),
d as (select c, node, count(*) as d, sum(score::decimal(18, 6)) as s from (select a as node, score from g union all select b, score from g) join m using (node) group by 1, 2),
rep as (select c, count(*) as n_members, arg_max(node, (d, s, -node)) as representative from d group by 1)
select rep.c as cluster, n_members, count(*) as n_edges, round(sum(score::decimal(18, 6))::double / count(*), 9) as mean_score, min(score) as min_score, representative
from rep join m using (c) join g on g.a = m.node group by all having n_members >= 2""")
def semantic_groups(spark, sf_dir):
    """Connected components of the hybrid edges, with a representative each."""
    return similarity.clusters(stash(hybrid_edges(spark, sf_dir).select("a", "b", "score"), "edges"))
