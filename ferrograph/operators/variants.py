"""Records without a schema, as Spark's VARIANT: one form and one hash for equal records, guarded access, fields and leaves as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import drop, stash


def record(text: Column) -> Column:
    """JSON text as a variant; null where it is not JSON (or has a key twice)."""
    return F.try_parse_json(text)


def canonical(variant: Column) -> Column:
    """The record as JSON with the keys of every object in order, at any depth, and without blanks; null for null.

    A variant keeps an object's fields in the order of their names, so writing it is all that is needed. Arrays keep their order.
    """
    return F.to_json(variant)


def record_hash(variant: Column) -> Column:
    """SHA-256 of the canonical form: one for equal records, however their keys were ordered."""
    return F.sha2(canonical(variant), 256)


def guarded(variant: Column, path: str, kind: str) -> Column:
    """The value at a path if it is of this kind or can be read as it; null where it is missing or something else."""
    return F.try_variant_get(variant, path, kind)


def kind_of(variant: Column) -> Column:
    """object, array, void (a JSON null) or the scalar's type; null for no variant at all."""
    schema = F.schema_of_variant(variant)
    return F.when(schema.startswith("OBJECT"), "object").when(schema.startswith("ARRAY"), "array").otherwise(F.lower(F.regexp_replace(schema, r"\(.*", "")))


def exploded(rows: DataFrame, variant: str, keep: list[str]) -> DataFrame:
    """One row a field of an object or element of an array: the columns `keep`, pos, name (null for elements), value (a variant). Scalars and nulls give none."""
    found = rows.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col(variant).outer()))
    return found.select(*keep, "pos", F.col("key").alias("name"), "value")


def leaves(rows: DataFrame, key: str, variant: str) -> DataFrame:
    """All scalars of the records: key, path ($.a.b[0]), kind, value (as text; null for a JSON null). One round a level of nesting; empty objects and arrays have none."""
    open_ = stash(rows.where(F.col(variant).isNotNull()).select(key, F.lit("$").alias("path"), F.col(variant).alias("v")), "variants")
    done = None
    while True:
        kinds = open_.withColumn("kind", kind_of(F.col("v")))
        flat = kinds.where("kind not in ('object', 'array')").select(key, "path", "kind", F.try_variant_get("v", "$", "string").alias("value"))
        flat = stash(flat, "leaves")
        done = flat if done is None else done.union(flat)
        inner = exploded(kinds.where("kind in ('object', 'array')"), "v", [key, "path"])
        step = F.when(F.col("name").isNull(), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("."), "name"))
        last, open_ = open_, stash(inner.select(key, F.concat("path", step).alias("path"), F.col("value").alias("v")), "variants")
        drop(last)
        if open_.isEmpty():
            drop(open_)
            return done
