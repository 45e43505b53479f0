"""Retrieval chunks, field evidence, training examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chunks(parts: list[tuple[str, DataFrame, Column, Column]]) -> DataFrame:
    """Chunks of several kinds in one frame: chunk_id (kind::key), kind, text; blank texts are left out."""
    out = None
    for kind, rows, key, text in parts:
        one = rows.select(F.concat(F.lit(f"{kind}::"), key.cast("string")).alias("chunk_id"), F.lit(kind).alias("kind"), text.alias("text")).where(F.coalesce(F.trim("text") != "", F.lit(False)))
        out = one if out is None else out.unionByName(one)
    return out


def field_evidence(rows: DataFrame, subject: Column, fields: list[str]) -> DataFrame:
    """Rows turned to (subject, field, value), one a field that is not null."""
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    return rows.select(subject.alias("subject"), F.explode(cells).alias("c")).select("subject", "c.*").where("value is not null")


def citations(hits: DataFrame, required: list[str]) -> DataFrame:
    """hits with `missing`: the required fields that are null or blank, joined by +; and `citable`."""
    missing = F.concat_ws("+", *[F.when(F.coalesce(F.trim(F.col(f).cast("string")) == "", F.lit(True)), F.lit(f)) for f in required])
    return hits.withColumn("missing", missing).withColumn("citable", F.col("missing") == "")


def conversations(turns: DataFrame, key: str, order: str, role: str, text: str) -> DataFrame:
    """One training example a conversation: its messages in order, their number, and whether roles alternate."""
    m = turns.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")))).alias("m"))
    again = F.exists(F.sequence(F.lit(1), F.size("m")), lambda i: (i > 1) & (F.get("m", i - 1)["role"] == F.get("m", i - 2)["role"]))
    return m.select(key, F.to_json("m").alias("messages"), F.size("m").alias("n_messages"), (~again).alias("alternates"))
