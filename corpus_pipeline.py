"""A corpus pipeline: documents in, the mixed training set out, in five stages.

Each stage is a function of (spark, docs, sf_dir), works on all its predecessor kept, and is written before the next
reads it. All stages but the last return the columns of documents. Any column may be null and rows may repeat: quality
and benchmark judge each row by its own text, whatever its id; lines and near go by ids, so rows of one id are one
document there, and rows without an id are compared with none and stay.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrograph.llm.decontaminate import decontaminate
from ferrograph.llm.lines import dedup_lines
from ferrograph.llm.minhash import near_duplicates
from ferrograph.llm.mixing import WEIGHTS, mix, source_domain
from ferrograph.llm.quality import quality_rules
from ferrograph.llm.shared import free_name, shared_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and their host's verdict keep.

    A verdict is joined back by id, source and a hash of the text, nulls equal; a merge join at every size, as verdicts
    grow with the documents. An empty table stays empty.
    """
    mark = F.struct("doc_id", "source", F.xxhash64("text").alias("hash"))
    marked = docs.select(F.struct(*docs.columns).alias("row"), mark.alias("mark"), "text", "source")
    kept = quality_rules(marked, key="mark").where("kept").select("mark").distinct()
    return marked.join(kept.hint("merge"), "mark", "left_semi").select("row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated runs of lines, n_chars brought up to date; those with nothing left go, null and empty texts stay."""
    removed = free_name(docs.columns, "n_lines_removed")
    found = dedup_lines(docs)
    changed = F.col(removed) > 0
    found = found.withColumn("n_chars", F.when(changed, F.length("text").cast("bigint")).otherwise(F.col("n_chars")))
    return found.where(~changed | F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one of the smallest doc_id; texts without words and rows without an id stay."""
    gone = near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item; rows travel with their verdict, so nothing is joined back."""
    row, mark = free_name(docs.columns, "row"), free_name(docs.columns, "mark")
    rows = docs.select(F.struct(*docs.columns).alias(row), F.col("doc_id").alias(mark), "text")
    found = decontaminate(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key=mark, keep=(row,))
    return found.where("not contaminated").select(f"{row}.*")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn to the target weights, with their epoch and their leaf's quota."""
    return mix(docs, WEIGHTS, source_domain())


STAGES = [("quality", quality), ("lines", lines), ("near", near), ("benchmark", benchmark), ("mixture", mixture)]

#: Near duplicates come from MinHash and components, which SQL does not express; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed documents; each stage's rows are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/stage-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
