"""Clusters of similar items: summaries and representatives of components, merges of edges, features and clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graphs import components

# How a representative is chosen, by what is greatest (then the smallest id).
REPRESENTATIVE = {"degree": ("d", "s"), "score": ("s",), "plain degree": ("d",)}


def clustered(edges: DataFrame) -> DataFrame:
    """edges (a, b, score, ...) with the `cluster` they lie in, the smallest node of their component."""
    return edges.join(components(edges.select("a", "b")).select(F.col("node").alias("a"), F.col("component").alias("cluster")), "a")


def summaries(inside: DataFrame, least: int = 2) -> DataFrame:
    """Per cluster of edges (cluster, a, b, score, basis: array): n_members, n_edges, mean, min and max score, basis (union), warnings.

    Sums are decimals, so that their order does not matter. A cluster of two members gets the warning pair_only, one
    with a member linked to fewer than half of the others weak_links.
    """
    nodes = inside.select("cluster", F.explode(F.array("a", "b")).alias("node"), "score").groupBy("cluster", "node").agg(F.count("*").alias("d"))
    members = nodes.groupBy("cluster").agg(F.count("*").alias("n_members"), F.min("d").alias("least_degree"))
    mean = F.round(F.sum(F.col("score").cast("decimal(18,6)")).cast("double") / F.count("*"), 9)
    bases = inside.select("cluster", F.explode("basis").alias("x")).distinct().groupBy("cluster").agg(F.array_join(F.array_sort(F.collect_set("x")), "+").alias("basis"))
    stats = inside.groupBy("cluster").agg(F.count("*").alias("n_edges"), mean.alias("mean_score"), F.min("score").alias("min_score"), F.max("score").alias("max_score"))
    warnings = F.concat_ws("+", F.when(F.col("n_members") == 2, F.lit("pair_only")), F.when(2 * F.col("least_degree") < F.col("n_members") - 1, F.lit("weak_links")))
    out = members.where(F.col("n_members") >= least).join(stats, "cluster").join(bases, "cluster")
    return out.select("cluster", "n_members", "n_edges", "mean_score", "min_score", "max_score", "basis", warnings.alias("warnings"))


def representatives(inside: DataFrame, by: str) -> DataFrame:
    """(cluster, representative) of edges (cluster, a, b, score): a partial maximum, no cluster is gathered."""
    ends = inside.select("cluster", F.explode(F.array("a", "b")).alias("node"), F.col("score").cast("decimal(18,6)").alias("score"))
    nodes = ends.groupBy("cluster", "node").agg(F.count("*").alias("d"), F.sum("score").alias("s"))
    best = F.max(F.struct(*REPRESENTATIVE[by], (-F.col("node")).alias("m")))
    return nodes.groupBy("cluster").agg((-best["m"]).alias("representative"))


def best_edges(edges: DataFrame, *order: str) -> DataFrame:
    """One edge for each pair (a, b), the greatest by `order`."""
    rest = [c for c in edges.columns if c not in ("a", "b", *order)]
    return edges.groupBy("a", "b").agg(F.max(F.struct(*order, *rest)).alias("e")).select("a", "b", "e.*")


def merged_edges(*parts: DataFrame) -> DataFrame:
    """Edges (a, b, score, basis: array) of several sources, one for each unordered pair: greatest score, union of bases."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    ends = every.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "score", F.explode_outer("basis").alias("basis"))
    return ends.groupBy("a", "b").agg(F.max("score").alias("score"), F.array_sort(F.collect_set("basis")).alias("basis"))


def merged_features(features: DataFrame, key: str, order: str, last: list[str], first: list[str], union: list[str]) -> DataFrame:
    """Features of several providers, one row a key: the last non-null of some columns, the first of others, unions of the rest."""
    kept = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in last]
    kept += [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in first]
    return features.groupBy(key).agg(*kept, *[F.array_sort(F.collect_set(c)).alias(c) for c in union])


def overridden(derived: DataFrame, given: DataFrame, key: str) -> DataFrame:
    """Rows of derived, those of given in place of rows with the same key, and the rest of given."""
    return given.unionByName(derived.join(given.select(key), key, "left_anti"))


def held_by_all(rows: DataFrame, cluster: list[str], member: str, value: str) -> DataFrame:
    """(cluster, value) for the values that every member of a cluster has."""
    n = rows.groupBy(*cluster).agg(F.count_distinct(member).alias("n_members"))
    held = rows.groupBy(*cluster, value).agg(F.count_distinct(member).alias("n"))
    return held.join(n, cluster).where("n = n_members").select(*cluster, value, "n_members")


def center_links(items: DataFrame, key: str, signature: str, changed: str) -> DataFrame:
    """Per item: class_id (smallest key of its signature), and how many others have its signature (score 1.0) or only its set of changes (0.72)."""
    by = items.where(F.col(signature).isNotNull())
    same = by.groupBy(signature, changed).agg(F.min(key).alias("class_id"), F.count("*").alias("n"))
    sets = same.groupBy(changed).agg(F.sum("n").alias("m"))
    classes = same.join(sets, changed).select(signature, changed, "class_id", (F.col("n") - 1).alias("n_same"), (F.col("m") - F.col("n")).alias("n_changed_alike"))
    return by.join(classes, [signature, changed]).select(key, "class_id", "n_same", "n_changed_alike")


def mergeable(edges: DataFrame, known: DataFrame) -> DataFrame:
    """edges (a, b, score) with `dropped`: why an edge cannot be merged (unknown ends, no finite score), '' if it can."""
    ids = known.select(F.col("id").alias("a"), F.lit(True).alias("has_a")).distinct()
    found = edges.join(ids, "a", "left").join(ids.withColumnsRenamed({"a": "b", "has_a": "has_b"}), "b", "left")
    finite = F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") != float("inf"))
    why = F.concat_ws("+", F.when(F.col("has_a").isNull(), F.lit("unknown_a")), F.when(F.col("has_b").isNull(), F.lit("unknown_b")), F.when(~finite, F.lit("score")))
    return found.select("a", "b", "score", why.alias("dropped"))


def touching(nodes: DataFrame, edges: DataFrame, basis: str) -> DataFrame:
    """Nodes (node, ...) that an edge (a, b, basis: array) of the basis touches."""
    ends = edges.where(F.array_contains("basis", basis)).select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return nodes.join(ends, "node", "left_semi")


def last_wins(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """One row for each key, the one of the greatest order; a partial maximum, so no key's rows are gathered."""
    rest = [c for c in rows.columns if c not in (*key, order)]
    return rows.groupBy(*key).agg(F.max(F.struct(order, *rest)).alias("r")).select(*key, "r.*")


def ordered_names(rows: DataFrame, key: list[str], place: str, value: str, by: str = ">") -> DataFrame:
    """Per key the values in order of place, joined: a signature. For keys of few rows, such as the steps of a procedure."""
    steps = F.array_sort(F.collect_list(F.struct(place, value)))
    return rows.groupBy(*key).agg(F.array_join(F.transform(steps, lambda s: s[value]), by).alias("signature"))


def numbered(rows: DataFrame, key: list[str], order: list[str], start: int = 1) -> DataFrame:
    """rows with `seq` within their key, from start."""
    return rows.withColumn("seq", F.row_number().over(Window.partitionBy(*key).orderBy(*order)) + F.lit(start - 1))
