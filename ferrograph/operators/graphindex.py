"""Graphs of records: nodes and edges from tables, flows of material, overlays of what ran, jobs and caches keyed by hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import band
from .clusters import last_wins


def nodes(parts: dict[str, tuple[DataFrame, Column, Column]]) -> DataFrame:
    """(node, kind, label) of several tables: kind to rows, key and label; node is kind::key, each once."""
    out = None
    for kind, (rows, key, label) in parts.items():
        one = rows.select(F.concat(F.lit(f"{kind}::"), key.cast("string")).alias("node"), F.lit(kind).alias("kind"), label.cast("string").alias("label"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("node", "kind").agg(F.min("label").alias("label"))


def edges(parts: dict[str, tuple[DataFrame, Column, Column, Column | None]]) -> DataFrame:
    """(kind, a, b, weight, confidence) of several tables, one for each kind and pair: the greatest weight, with its band."""
    out = None
    for kind, (rows, a, b, weight) in parts.items():
        one = rows.select(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"), (F.lit(1.0) if weight is None else weight.cast("double")).alias("weight"))
        out = one if out is None else out.unionByName(one)
    best = out.where("a is not null and b is not null").groupBy("kind", "a", "b").agg(F.max("weight").alias("weight"))
    return best.withColumn("confidence", band(F.col("weight"), 0.85, 0.65))


def degrees(found: DataFrame) -> DataFrame:
    """Per node of edges (a, b): n_in and n_out."""
    ends = found.select(F.col("a").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).union(found.select("b", F.lit(1), F.lit(0)))
    return ends.groupBy("node").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))


def flows(relations: DataFrame, kinds: dict[str, tuple[str, bool]], review: float = 0.6) -> DataFrame:
    """Flow edges of relations (relation, type, a, b, confidence, ord) by a table from type to edge type and whether it is turned round.

    The last relation of an id wins; edges under `review` are marked for it. Relations of other types make none.
    """
    name = F.coalesce(*[F.when(F.col("type") == t, e) for t, (e, _) in kinds.items()])
    turned = F.coalesce(*[F.when(F.col("type") == t, F.lit(r)) for t, (_, r) in kinds.items()])
    last = last_wins(relations, ["relation"], "ord")
    made = last.select(F.concat(F.lit("flow::"), "relation").alias("flow"), name.alias("edge"), F.when(turned, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("b"), "confidence")
    return made.where("edge is not null").withColumn("review", F.col("confidence") < review)


def overlaid(graph: DataFrame, runs: DataFrame, target: str) -> DataFrame:
    """Edges (kind, a, b) with the number of runs of their target and its last status: runs (target, at, status)."""
    state = runs.groupBy(F.col("target").alias(target)).agg(F.count("*").alias("n_runs"), F.max_by("status", "at").alias("last_status"))
    return graph.join(state, target, "left").select(*graph.columns, F.coalesce("n_runs", F.lit(0)).alias("n_runs"), "last_status")


def contained(blocks: DataFrame, owner: Column, fallback: Column, kind: str) -> DataFrame:
    """Edges from what holds a block to the block: its owner, else a fallback such as its document."""
    return blocks.select(F.lit(kind).alias("kind"), F.coalesce(owner, fallback).alias("a"), F.col("block").alias("b"))


def misses(work: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of work whose keys (ids and hashes of what they are made of) the cache does not hold: what must be done again."""
    return work.join(cache.select(*keys).distinct(), keys, "left_anti")


def current(results: DataFrame, states: DataFrame, key: str, version: str) -> DataFrame:
    """results with `stale`: made for a version that is no longer the state's, or for something that is gone."""
    now = states.select(key, F.col(version).alias("now"))
    return results.join(now, key, "left").withColumn("stale", ~F.coalesce(F.col("now") == F.col(version), F.lit(False))).drop("now")


def jobs(rows: DataFrame, key: str, notation: Column) -> DataFrame:
    """Input of a job: key, notation, source_hash, and why a row is skipped (no notation), null if it is not."""
    text = F.nullif(F.trim(notation), F.lit(""))
    return rows.select(key, text.alias("notation"), F.sha2(F.concat_ws("|", F.col(key).cast("string"), F.coalesce(text, F.lit(""))), 256).alias("source_hash"), F.when(text.isNull(), "missing_notation").alias("skipped"))


def newest_overlapping(artifacts: DataFrame, ids: str, known: DataFrame, order: list[str]) -> DataFrame:
    """The newest artifact (greatest order) whose array of ids holds a known one (id)."""
    met = artifacts.select("artifact", *order, F.explode(ids).alias("id")).join(known.select("id").distinct(), "id", "left_semi")
    return met.groupBy("artifact", *order).agg(F.count("*").alias("n_known")).orderBy(*[F.desc(c) for c in order], "artifact").limit(1)


def changed_paths(feed: DataFrame, path: str, order: str) -> DataFrame:
    """One row for each path of a change feed, its last state."""
    return last_wins(feed, [path], order)


def first_wins(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """The union of several frames with one row for each key: of the first frame that has it, its least row; `origin` counts frames from 1."""
    out = None
    for i, p in enumerate(parts):
        one = p.withColumn("origin", F.lit(i + 1))
        out = one if out is None else out.unionByName(one)
    rest = [c for c in out.columns if c not in (*keys, "origin")]
    return out.groupBy(*keys).agg(F.min(F.struct("origin", *rest)).alias("r")).select(*keys, "r.*")


def tasks(parts: dict[str, tuple[DataFrame, Column, Column, Column]]) -> DataFrame:
    """Training examples (task, id, input, target) of several kinds; those without input or target are left out."""
    out = None
    for task, (rows, key, given, wanted) in parts.items():
        one = rows.select(F.lit(task).alias("task"), F.concat(F.lit(f"{task}::"), key.cast("string")).alias("id"), given.cast("string").alias("input"), wanted.cast("string").alias("target"))
        out = one if out is None else out.unionByName(one)
    return out.where((F.coalesce(F.trim("input"), F.lit("")) != "") & F.col("target").isNotNull())


def features(rows: DataFrame, key: str, categorical: dict[str, Column], numeric: dict[str, Column], text: dict[str, Column]) -> DataFrame:
    """One row a key with maps of what is known by kind of feature, and how many are."""
    pairs = lambda cols, kind: F.map_from_entries(F.array_compact(F.array(*[F.when(c.isNotNull(), F.struct(F.lit(n).alias("key"), c.cast(kind).alias("value"))) for n, c in cols.items()])))
    made = rows.select(key, pairs(categorical, "string").alias("categorical"), pairs(numeric, "double").alias("numeric"), pairs(text, "string").alias("text"))
    return made.withColumn("n_known", F.size("categorical") + F.size("numeric") + F.size("text"))


def inconsistent(attempts: DataFrame, outcomes: DataFrame, key: str) -> DataFrame:
    """Attempts and outcomes by key that do not fit: an attempt without outcome, an outcome without attempt, or several outcomes."""
    a, o = attempts.groupBy(key).agg(F.count("*").alias("n_attempts")), outcomes.groupBy(key).agg(F.count("*").alias("n_outcomes"))
    both = a.join(o, key, "full_outer").select(key, F.coalesce("n_attempts", F.lit(0)).alias("n_attempts"), F.coalesce("n_outcomes", F.lit(0)).alias("n_outcomes"))
    problem = F.when(F.col("n_outcomes") == 0, "no_outcome").when(F.col("n_attempts") == 0, "no_attempt").when(F.col("n_outcomes") > F.col("n_attempts"), "too_many_outcomes")
    return both.withColumn("problem", problem).where("problem is not null")


def foreign_results(results: DataFrame, members: DataFrame, key: str, member: str) -> DataFrame:
    """results with `belongs`: whether their member is one of those of their key."""
    held = members.select(key, member, F.lit(True).alias("belongs")).distinct()
    return results.join(held, [key, member], "left").withColumn("belongs", F.coalesce("belongs", F.lit(False)))


def citable(evidence: DataFrame, locators: list[str]) -> DataFrame:
    """evidence (id, label, locators) with `citable`: an id, a label, and a locator that is not blank."""
    filled = lambda c: F.coalesce(F.trim(F.col(c).cast("string")) != "", F.lit(False))
    return evidence.withColumn("citable", filled("id") & filled("label") & F.exists(F.array(*[filled(c) for c in locators]), lambda x: x))
