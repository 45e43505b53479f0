"""Compiled records, one nested row each, taken apart into storage tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def decompose(records: DataFrame, key: str, arrays: dict[str, str]) -> dict[str, DataFrame]:
    """One table for each array column: key, position, and the fields of its structs; `arrays` maps column to table name."""
    return {name: records.select(key, F.posexplode(column).alias("position", "item")).select(key, "position", "item.*") for column, name in arrays.items()}


def entities(records: DataFrame, key: str, arrays: dict[str, str]) -> DataFrame:
    """All entities in one table: key, entity_id (type::key::id), type, payload (JSON)."""
    out = None
    for column, kind in arrays.items():
        one = records.select(key, F.explode(column).alias("e")).select(key, F.concat_ws("::", F.lit(kind), F.col(key).cast("string"), F.col("e.id").cast("string")).alias("entity_id"), F.lit(kind).alias("type"), F.to_json("e").alias("payload"))
        out = one if out is None else out.unionByName(one)
    return out


def orphans(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Children whose key is null or has no parent: what a write must refuse."""
    return children.join(parents.select(F.col(parent_key).alias(child_key)).distinct(), child_key, "left_anti")
