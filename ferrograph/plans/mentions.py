"""Mentions of a lexicon in documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.mentions import lexicon_mentions
from ..tables import table
from .registry import query

CONTEXT = ["there", "inan", "über", "eau", "que"]
WORDS = r"[^\s.,;:!?]+"


def lexicon(spark, sf_dir):
    """The benchmark's items as entries: named by their first three words, with shorter and later phrases as aliases."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.regexp_extract_all("text", F.lit(WORDS), F.lit(0)).alias("w")).where("size(w) >= 12")
    phrase = lambda at, n: F.array_join(F.slice("w", at, n), " ")
    aliases = F.array_distinct(F.array(phrase(1, 3), phrase(1, 2), phrase(3, 2), phrase(5, 3), phrase(8, 1), phrase(9, 2), phrase(11, 1)))
    entries = items.select(F.concat(F.lit("item."), "item_id").alias("entry"), phrase(1, 3).alias("name"), F.explode(aliases).alias("alias"), F.concat(F.lit("kind"), F.col("item_id") % 5).alias("category"))
    return entries.where("length(alias) > 3")


def mentions_sql(chosen: bool) -> str:
    """Tokens of each text beside the tokens of each alias; then one greedy pass over a text's spans."""
    near = " or ".join(f"contains(around, '{w}')" for w in CONTEXT)
    select = "select doc_id, start, end_, mention, name, entry, category, source, score, chosen from marked"
    return rf"""
with i as (select item_id, regexp_extract_all(text, '[^\s.,;:!?]+') as w from benchmark),
e as (select distinct 'item.' || item_id as entry, array_to_string(w[1:3], ' ') as name, 'kind' || item_id % 5 as category,
    unnest([array_to_string(w[1:3], ' '), array_to_string(w[1:2], ' '), array_to_string(w[3:4], ' '), array_to_string(w[5:7], ' '), w[8], array_to_string(w[9:10], ' '), w[11]]) as alias from i where len(w) >= 12),
x as materialized (select *, list_transform(regexp_extract_all(alias, '[A-Za-z0-9]+|\s+|[^A-Za-z0-9\s]'), lambda t: case when trim(t) = '' then ' ' else lower(t) end) as t, row_number() over (order by -length(alias), entry, name, alias, category) as place from e where length(alias) > 3),
d as (select doc_id, unnest(k) as tok, generate_subscripts(k, 1) as pos from (select doc_id, regexp_extract_all(text, '[A-Za-z0-9]+|\s+|[^A-Za-z0-9\s]') as k from documents)),
p as materialized (select doc_id, pos, tok, case when regexp_full_match(tok, '\s+') then ' ' else lower(tok) end as l, (sum(length(tok)) over (partition by doc_id order by pos))::bigint as upto from d),
firsts as (select p.doc_id, p.pos, p.upto - length(p.tok) as start, x.* from p join x on x.t[1] = p.l),
longer as (select f.doc_id, f.pos, f.place, count(*) as n from firsts f join p on p.doc_id = f.doc_id and p.pos between f.pos and f.pos + len(f.t) - 1 and p.l = f.t[p.pos - f.pos + 1] group by all),
whole as (select f.*, z.upto as end_, a.tok as before, b.tok as after from firsts f join longer g using (doc_id, pos, place) join p z on z.doc_id = f.doc_id and z.pos = f.pos + len(f.t) - 1
  left join p a on a.doc_id = f.doc_id and a.pos = f.pos - 1 left join p b on b.doc_id = f.doc_id and b.pos = f.pos + len(f.t) where g.n = len(f.t)),
m as (select w.doc_id, start, end_, substring(text, start + 1, end_ - start) as mention, name, entry, category, case when alias = name then 'canonical' else 'alias' end as source, place,
    lower(regexp_replace(substring(text, greatest(start - 32, 0) + 1, end_ + 32 - greatest(start - 32, 0)), '\s+', ' ', 'g')) as around
  from whole w join documents using (doc_id) where not coalesce(regexp_matches(before, '^[A-Za-z0-9]'), false) and not coalesce(regexp_matches(after, '^[A-Za-z0-9]'), false)),
s as (select *, least(0.99, round(case source when 'canonical' then 0.96 else 0.9 end + case when {near} then 0.04 else 0 end, 3))::double as score from m),
g as (select doc_id, list_reduce(list([{{'s': start, 'e': end_, 'p': place}}] order by start - end_, -score, start, place), lambda acc, z: case when len(list_filter(acc, lambda y: y.s < z[1].e and z[1].s < y.e)) > 0 then acc else list_concat(acc, z) end) as took from s group by doc_id),
marked as (select s.*, len(list_filter(took, lambda y: y.s = start and y.e = end_ and y.p = place)) > 0 as chosen from s join g using (doc_id))
{select}{' where chosen' if chosen else ''}"""


@query(mentions_sql(True))
def lexicon_spans(spark, sf_dir):
    """Every document's mentions of a lexicon of hundreds of aliases: the longest ones that do not overlap, with scores by context."""
    found = lexicon_mentions(table(spark, sf_dir, "documents"), "doc_id", "text", lexicon(spark, sf_dir), CONTEXT)
    return found.withColumnRenamed("end", "end_")


@query(mentions_sql(False))
def lexicon_candidates(spark, sf_dir):
    """All mentions, overlapping ones too, with the choice marked."""
    found = lexicon_mentions(table(spark, sf_dir, "documents"), "doc_id", "text", lexicon(spark, sf_dir), CONTEXT, overlapping=True)
    return found.withColumnRenamed("end", "end_")
