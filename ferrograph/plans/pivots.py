"""Exact similarity joins and searches over the supplied vectors by the pivot index."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pivots
from ..tables import table
from .registry import query
from .similarity import COS

PAIRS = f"p as (select a.vec_id as a, b.vec_id as b, round({COS.format(a='a.embedding', b='b.embedding')}, 9) as c from embeddings a join embeddings b on a.vec_id < b.vec_id)"


@query(f"with {PAIRS} select a, b, round(c, 6) as cosine from p where c >= 0.3")
def cosine_pairs(spark, sf_dir):
    """All pairs of vectors whose cosine is 0.3 or more."""
    found = pivots.cosine_pairs(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 0.3)
    return found.rows.withColumn("cosine", F.round("cosine", 6))


@query(f"with {PAIRS} select a, b, round(c, 6) as cosine, row_number() over (order by c desc, a, b)::int as place from p where c > 0 qualify place <= 200")
def cosine_pairs_top(spark, sf_dir):
    """The 200 pairs of greatest cosine among all vectors."""
    found = pivots.top_pairs(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 200)
    return found.rows.withColumn("cosine", F.round("cosine", 6))


@query(f"""
with p as (select a.vec_id, b.vec_id as other, round({COS.format(a='a.embedding', b='b.embedding')}, 9) as c
  from embeddings a join embeddings b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0)
select vec_id, other, round(c, 6) as cosine, place from (select *, row_number() over (partition by vec_id order by c desc, other)::int as place from p) where place <= 12""")
def knn_pivots(spark, sf_dir):
    """The twelve nearest of every row whose id is divisible by 20, by the index."""
    rows = table(spark, sf_dir, "embeddings")
    return pivots.neighbours(rows, rows.where("vec_id % 20 = 0"), 12).rows.withColumn("cosine", F.round("cosine", 6))
