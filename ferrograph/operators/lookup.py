"""Lookups that choose one of several matches: by priority, by containment, by longest prefix, by what a row carries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_match(rows: DataFrame, sources: list[DataFrame], key: list[str], value: str) -> DataFrame:
    """rows with `value` from the first source, in order, that has their key (ties: least value), and `from_source` (from 1)."""
    every = None
    for i, s in enumerate(sources):
        one = s.select(*key, F.struct(F.lit(i + 1).alias("o"), F.col(value).alias("v")).alias("m"))
        every = one if every is None else every.union(one)
    best = every.groupBy(*key).agg(F.min("m").alias("m"))
    return rows.join(best, key, "left").withColumn(value, F.col("m.v")).withColumn("from_source", F.col("m.o")).drop("m")


def enclosing(points: DataFrame, ranges: DataFrame, scope: str, width: int) -> DataFrame:
    """points (id, scope, at) with the smallest range (range_id, scope, start, end) that holds them, ties by range_id; null where none.

    Ranges are cut into bins of `width`, so a point meets only the ranges of its bin.
    """
    binned = ranges.withColumn("__bin", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))))
    met = points.withColumn("__bin", F.floor(F.col("at") / width)).join(binned, [scope, "__bin"]).where("at >= start and at < end")
    best = met.groupBy("id").agg(F.min(F.struct((F.col("end") - F.col("start")).alias("size"), "range_id")).alias("m")).select("id", F.col("m.range_id").alias("range_id"))
    return points.join(best, "id", "left")


def longest_prefix(rows: DataFrame, name: Column, rules: DataFrame, sep: str = ".") -> DataFrame:
    """rows with `kind` of the rule (prefix, kind) whose prefix, cut at separators, is the longest of their name's."""
    parts = F.split(name, f"[{sep}]")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), sep))
    # names are judged once each: a name's prefixes meet the rules by equality, and the longest that has one stays
    tried = rows.select(name.alias("name"), F.explode(prefixes).alias("prefix")).distinct().join(rules, "prefix")
    best = tried.groupBy("name").agg(F.max(F.struct(F.length("prefix").alias("n"), "kind")).alias("m")).select("name", F.col("m.kind").alias("kind"))
    return rows.withColumn("name", name).join(best, "name", "left").drop("name")


def unique_definition(names: DataFrame, definitions: DataFrame, name: str) -> DataFrame:
    """names with `definition` if exactly one has their name, and n_definitions."""
    counts = definitions.groupBy(name).agg(F.count("*").alias("n"), F.min("definition").alias("d"))
    return names.join(counts, name, "left").select(*names.columns, F.when(F.col("n") == 1, F.col("d")).alias("definition"), F.coalesce("n", F.lit(0)).alias("n_definitions"))


def spans_apart(spans: Column) -> Column:
    """Of spans (score, start, end), a choice without overlaps: longest first, then the greater score, then the earlier start."""
    order = F.array_sort(spans, lambda a, b: F.when(a["end"] - a["start"] != b["end"] - b["start"], (b["end"] - b["start"]) - (a["end"] - a["start"])).when(a["score"] != b["score"], F.when(a["score"] > b["score"], -1).otherwise(1)).otherwise(a["start"] - b["start"]).cast("int"))
    taken = F.aggregate(order, F.slice(spans, 1, 0), lambda acc, s: F.when(F.exists(acc, lambda t: (t["start"] < s["end"]) & (s["start"] < t["end"])), acc).otherwise(F.concat(acc, F.array(s))))
    return F.array_sort(taken, lambda a, b: (a["start"] - b["start"]).cast("int"))


def dispositions(rows: DataFrame, status: str, attempts: str, cap: int = 3) -> DataFrame:
    """rows with `disposition`: eligible (pending), retryable (failed, under the cap), blocked (failed at the cap), skipped."""
    d = F.when(F.col(status) == "pending", "eligible").when((F.col(status) == "failed") & (F.col(attempts) < cap), "retryable").when(F.col(status) == "failed", "blocked").otherwise("skipped")
    return rows.withColumn("disposition", d)


def transitions_allowed(steps: DataFrame, group: str, order: str, status: str, allowed: list[tuple[str, str]]) -> DataFrame:
    """Steps whose change of status is not among the allowed ones: group, order, from_status, to_status."""
    w = Window.partitionBy(group).orderBy(order)
    seen = steps.select(group, order, F.lag(status).over(w).alias("from_status"), F.col(status).alias("to_status")).where("from_status is not null and from_status <> to_status")
    ok = F.array(*[F.struct(F.lit(a).alias("from_status"), F.lit(b).alias("to_status")) for a, b in allowed])
    return seen.where(~F.array_contains(ok, F.struct("from_status", "to_status")))


def scoped_id(x: Column) -> dict[str, Column]:
    """Parts of @document#object.child: document, object, child; null where a part is missing."""
    part = lambda i: F.nullif(F.regexp_extract(x, r"^@([^#]+)(?:#([^.]+))?(?:\.(.+))?$", i), F.lit(""))
    return {"document": part(1), "object": part(2), "child": part(3)}
