"""Differences between revisions, keyed writes, and patterns in corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType


def rows_diff(before: DataFrame, after: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """keys, change (added, removed, changed) and changed_fields (joined by +) of keyed rows that differ; nulls equal nulls."""
    b = before.select(*keys, F.struct(*fields).alias("old"))
    a = after.select(*keys, F.struct(*fields).alias("new"))
    both = b.join(a, keys, "full_outer")
    names = F.concat_ws("+", *[F.when(~F.col(f"old.{f}").eqNullSafe(F.col(f"new.{f}")), F.lit(f)) for f in fields])
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(names != "", "changed")
    return both.select(*keys, change.alias("change"), F.when(change == "changed", names).otherwise("").alias("changed_fields")).where("change is not null")


def revisions_diff(rows: DataFrame, parent: list[str], order: list[str], key: str, fields: list[str]) -> DataFrame:
    """One row a changed field between successive rows of a parent: key, field, old_value, new_value, delta (numbers)."""
    w = Window.partitionBy(*parent).orderBy(*order)
    seen = rows.withColumn("__n", F.row_number().over(w))
    parts = F.array(*[F.struct(F.lit(f).alias("field"), F.lag(f).over(w).cast("string").alias("old_value"), F.col(f).cast("string").alias("new_value")) for f in fields])
    out = seen.select(key, "__n", parts.alias("p")).where("__n > 1").select(key, F.explode("p").alias("p")).select(key, "p.*").where("not old_value <=> new_value")
    number = F.expr("try_cast(new_value as double)") - F.expr("try_cast(old_value as double)")
    return out.withColumn("delta", F.round(number, 4))


def flattened(record: Column, kind: DataType, prefix: str = "") -> Column:
    """A map of a nested record's fields as text, inner ones under their record's name and a dot; absent ones are left out."""
    leaves: list[Column] = []

    def walk(column: Column, kind: DataType, name: str) -> None:
        if isinstance(kind, StructType):
            for f in kind.fields:
                walk(column.getField(f.name), f.dataType, f"{name}.{f.name}" if name else f.name)
        else:
            leaves.append(F.when(column.isNotNull(), F.struct(F.lit(name).alias("key"), column.cast("string").alias("value"))))

    walk(record, kind, prefix)
    return F.map_from_entries(F.array_compact(F.array(*leaves)))


def map_changes(a: Column, b: Column) -> Column:
    """(field, before, after) for the keys of two maps whose values differ, in order; an absent key is null."""
    keys = F.array_sort(F.array_union(F.map_keys(a), F.map_keys(b)))
    every = F.transform(keys, lambda k: F.struct(k.alias("field"), F.element_at(a, k).alias("before"), F.element_at(b, k).alias("after")))
    return F.filter(every, lambda x: ~x["before"].eqNullSafe(x["after"]))


def map_diff(a: Column, b: Column) -> Column:
    """Keys of two maps whose values differ, sorted and joined by +."""
    return F.array_join(F.transform(map_changes(a, b), lambda x: x["field"]), "+")


def correction_patterns(changes: DataFrame, family: str, field: str, old: str, new: str, event: str, use: str) -> DataFrame:
    """Patterns of changes: pattern_id, their four keys, support (distinct events), training_uses, confidence, tier, promoted."""
    named = changes.select(*[F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("unknown")).alias(n) for c, n in ((family, "family"), (field, "field"), (old, "old_role"), (new, "new_role"))], F.col(event).alias("e"), F.col(use).alias("u"))
    keys = ["family", "field", "old_role", "new_role"]
    found = named.groupBy(*keys).agg(F.count_distinct("e").alias("support"), F.array_join(F.array_sort(F.collect_set("u")), "+").alias("training_uses"))
    confidence = F.round(F.least(F.lit(0.95), F.lit(0.5) + F.log(F.col("support") + 1.0) / 10), 6)
    tier = F.when(F.col("support") >= 10, "gold").when(F.col("support") >= 3, "silver").otherwise("bronze")
    return found.select(F.concat(F.lit("correction::aggregate::"), F.md5(F.concat_ws("|", *keys))).alias("pattern_id"), *keys, "support", "training_uses", confidence.alias("confidence"), tier.alias("tier"), (F.col("support") >= 10).alias("promoted"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of old whose key is not in new, and all rows of new; `written` says inserted, updated or kept."""
    known = old.select(*keys).distinct().withColumn("__old", F.lit(True))
    fresh = new.join(known, keys, "left").withColumn("written", F.when(F.col("__old"), "updated").otherwise("inserted")).drop("__old")
    kept = old.join(new.select(*keys).distinct(), keys, "left_anti").withColumn("written", F.lit("kept"))
    return kept.unionByName(fresh)


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.join(old.select(*keys).distinct(), keys, "left_anti"))


def replace_set(old: DataFrame, new: DataFrame, parent: list[str]) -> DataFrame:
    """All rows of a parent that new mentions are replaced by new's rows."""
    return old.join(new.select(*parent).distinct(), parent, "left_anti").unionByName(new)


def override(derived: DataFrame, explicit: DataFrame, keys: list[str]) -> DataFrame:
    """Explicit rows hide derived ones of equal key; `origin` tells them apart."""
    return derived.join(explicit.select(*keys).distinct(), keys, "left_anti").withColumn("origin", F.lit("derived")).unionByName(explicit.withColumn("origin", F.lit("explicit")))


def semi_any(rows: DataFrame, others: DataFrame, ways: list[list[tuple[str, str]]], key: str) -> DataFrame:
    """Rows for which some other row agrees in all pairs of columns of at least one way: a semi join a way, no nested loop."""
    found = None
    for way in ways:
        names = [o for _, o in way]
        one = rows.join(others.select(*[F.col(o).alias(f"__{o}") for o in names]).distinct(), [rows[r].eqNullSafe(F.col(f"__{o}")) for r, o in way], "left_semi")
        found = one if found is None else found.union(one)
    return found.dropDuplicates([key])
