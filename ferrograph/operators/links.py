"""Joins of records with what refers to them: targets, relations, evidence, outcomes, rules, ranges. Equi-joins throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_members(rows: DataFrame, array: str, name: str) -> DataFrame:
    """rows with one line for each member of an array, and one with null where there is none (a left join with unnest)."""
    return rows.withColumn(name, F.explode_outer(array)).drop(array)


def referring(references: DataFrame, targets: str, definitions: DataFrame, key: str) -> DataFrame:
    """References whose array of target ids holds a definition's key: exploded once, each reference kept once."""
    held = references.select("reference", F.explode(targets).alias(key)).join(definitions.select(key), key, "left_semi").select("reference").distinct()
    return references.join(held, "reference", "left_semi")


def related(relations: DataFrame, types: list[str], to: DataFrame) -> DataFrame:
    """(from_id, n, n_to): relations (from_id, type, to_id) of some types to the ids of `to` (to_id)."""
    met = relations.where(F.col("type").isin(types)).join(to.select("to_id").distinct(), "to_id", "left_semi")
    return met.groupBy("from_id").agg(F.count("*").alias("n"), F.count_distinct("to_id").alias("n_to"))


def evidence(results: DataFrame, relations: DataFrame) -> DataFrame:
    """(result, relation) for relations (relation, target) that name a result (result, owner) or its owner: two equi-joins, not an OR."""
    by_self = results.select("result", F.col("result").alias("target")).join(relations, "target").select("result", "relation")
    by_owner = results.where("owner is not null").select("result", F.col("owner").alias("target")).join(relations, "target").select("result", "relation")
    return by_self.union(by_owner).distinct()


def with_facts(records: DataFrame, key: str, **facts: DataFrame) -> DataFrame:
    """records with `has_<name>` and the columns of each table of facts (one row a key) that is there."""
    for name, fact in facts.items():
        records = records.join(fact.withColumn(f"has_{name}", F.lit(True)), key, "left").withColumn(f"has_{name}", F.coalesce(f"has_{name}", F.lit(False)))
    return records


def compared(pairs: DataFrame, outcomes: DataFrame, digits: int = 4) -> DataFrame:
    """pairs (baseline, candidate) of the outcomes (id, value) with delta and verdict; nulls where an outcome is missing."""
    one = pairs.join(outcomes.select(F.col("id").alias("baseline"), F.col("value").alias("baseline_value")), "baseline", "left")
    both = one.join(outcomes.select(F.col("id").alias("candidate"), F.col("value").alias("candidate_value")), "candidate", "left")
    delta = F.round(F.col("candidate_value") - F.col("baseline_value"), digits)
    verdict = F.when(delta > 0, "better").when(delta < 0, "worse").when(delta == 0, "same").otherwise("unknown")
    return both.select("baseline", "candidate", "baseline_value", "candidate_value", delta.alias("delta"), verdict.alias("verdict"))


def triggered(plans: DataFrame, rules: dict[str, DataFrame]) -> DataFrame:
    """(plan, rule, basis): rules (value, rule) by the column of the plan they look at (an array counts by its members): a union of equi-joins."""
    found = None
    for column, table in rules.items():
        value = F.explode(column) if dict(plans.dtypes)[column].startswith("array") else F.col(column)
        one = plans.select("plan", value.alias("value")).join(table, "value").select("plan", "rule")
        found = one if found is None else found.union(one)
    return found.distinct()


def resolved(rows: DataFrame, key: str, sources: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """rows with `range` and `origin` of the first source that has one: sources are (name, (key, range), row's column it goes by)."""
    for name, source, by in sources:
        rows = rows.join(source.select(F.col(key).alias(by), F.col("range").alias(f"range_{name}")), by, "left")
    names = [name for name, _, _ in sources]
    origin = F.coalesce(*[F.when(F.col(f"range_{n}").isNotNull(), F.lit(n)) for n in names])
    return rows.select("*", F.coalesce(*[F.col(f"range_{n}") for n in names]).alias("range"), origin.alias("origin")).drop(*[f"range_{n}" for n in names])


def targeted(events: DataFrame, targets: DataFrame) -> DataFrame:
    """events (event, document, part, id) with the target of their own level: document, part and id, or document and id, or id alone.

    A key of several targets (target, document, part, id) resolves to none, and no level falls back on another.
    """
    levels = [["document", "part", "id"], ["document", "id"], ["id"]]
    level = F.when(F.col("document").isNotNull() & F.col("part").isNotNull(), 0).when(F.col("document").isNotNull() & F.col("part").isNull(), 1).when(F.col("document").isNull() & F.col("part").isNull(), 2)
    events, out = events.withColumn("level", level), None
    for k, keys in enumerate(levels):
        single = targets.groupBy(*keys).agg(F.count_distinct("target").alias("n"), F.min("target").alias("target")).where("n = 1").drop("n")
        one = events.where(F.col("level") == k).join(single, keys, "left").select("event", "level", "target")
        out = one if out is None else out.union(one)
    return out.union(events.where("level is null").select("event", "level", F.lit(None).cast(dict(targets.dtypes)["target"]).alias("target")))


def picked(rows: DataFrame, key: list[str], best: list[Column], take: list[str]) -> DataFrame:
    """For each key the columns of the row of greatest `best` (a partial maximum)."""
    return rows.groupBy(*key).agg(F.max(F.struct(*[b.alias(f"b{i}") for i, b in enumerate(best)], *take)).alias("r")).select(*key, *[F.col(f"r.{t}") for t in take])


def unchanged(rows: DataFrame, known: DataFrame, key: str, revision: str) -> DataFrame:
    """rows with `disposition`: skipped (no revision), unchanged (its revision is known), changed or new."""
    seen = known.select(key, F.col(revision).alias("known"))
    kind = F.when(F.col(revision).isNull(), "skipped").when(F.col("known") == F.col(revision), "unchanged").when(F.col("known").isNotNull(), "changed").otherwise("new")
    return rows.join(seen, key, "left").withColumn("disposition", kind).drop("known")


def missing_vectors(chunks: DataFrame, vectors: DataFrame, keys: list[str], size: int, overwrite: bool = False) -> DataFrame:
    """chunks (keys, ...) with `action` of a backfill: kept (a vector of `size` finite numbers is there, unless overwritten) or embed."""
    sound = vectors.where((F.size("vector") == size) & F.forall("vector", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))).select(*keys, F.lit(True).alias("has"))
    has = F.coalesce("has", F.lit(False))
    return chunks.join(sound.distinct(), keys, "left").withColumn("action", F.when(has & F.lit(not overwrite), "kept").otherwise("embed")).drop("has")
