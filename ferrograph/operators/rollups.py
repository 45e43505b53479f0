"""Counts and rules over groups: severities, codes, outcomes, stoichiometry, trajectories. Partial aggregates throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counted_by(rows: DataFrame, keys: list[str], of: str, values: list[str], prefix: str = "n_") -> DataFrame:
    """Per keys how many rows have each of some values, all, and other ones."""
    named = [F.count_if(F.col(of) == v).alias(prefix + v) for v in values]
    other = F.count_if(~F.coalesce(F.col(of).isin(values), F.lit(False))).alias(prefix + "other")
    return rows.groupBy(*keys).agg(F.count("*").alias(prefix + "all"), *named, other)


def summed_counts(counts: DataFrame, key: str, n: str) -> DataFrame:
    """Partial counts of several files, added up by code."""
    return counts.groupBy(key).agg(F.sum(n).cast("bigint").alias(n), F.count("*").alias("n_files"))


def sum_or_null(rows: DataFrame, keys: list[str], value: str, where: Column, name: str) -> DataFrame:
    """Per keys the decimal sum of the values that count, null where none does."""
    return rows.groupBy(*keys).agg(F.sum(F.when(where, F.col(value).cast("decimal(18,2)"))).cast("double").alias(name))


def mean_or_zero(rows: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """Per keys the mean of the values there are, 0 where there is none."""
    total, n = F.sum(value.cast("decimal(18,4)")).cast("double"), F.count(value)
    return rows.groupBy(*keys).agg(F.round(F.coalesce(total / F.nullif(n, F.lit(0)), F.lit(0.0)), 9).alias(name))


def broken_rules(rules: dict[str, Column]) -> Column:
    """Names of the rules that hold, joined by +."""
    return F.concat_ws("+", *[F.when(holds, F.lit(name)) for name, holds in rules.items()])


def sized_routes(nodes: DataFrame, route: str, linked: DataFrame, key: str) -> DataFrame:
    """nodes with the size of their route and `orphan`: alone on it, and linked to nothing."""
    sizes = nodes.groupBy(route).agg(F.count("*").alias("route_size"))
    found = nodes.join(sizes, route).join(linked.select(key, F.lit(True).alias("linked")).distinct(), key, "left")
    return found.withColumn("orphan", (F.col("route_size") == 1) & F.col("linked").isNull()).drop("linked")


def trajectories(runs: DataFrame, keys: list[str], document: str, signature: str, reactant: str, product: str) -> DataFrame:
    """Groups of at least two documents and two signatures, with their kind by what differs."""
    found = runs.groupBy(*keys).agg(*[F.count_distinct(c).alias(n) for c, n in ((document, "n_documents"), (signature, "n_signatures"), (reactant, "n_reactants"), (product, "n_products"))], F.count("*").alias("n_runs"))
    kind = F.when((F.col("n_reactants") > 1) & (F.col("n_products") > 1), "scope").when(F.col("n_reactants") > 1, "substrate").when(F.col("n_products") > 1, "outcome").otherwise("condition")
    return found.where("n_documents >= 2 and n_signatures >= 2").withColumn("kind", kind)


def collected_ids(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Per key the distinct ids of several columns, sorted and joined; for keys of few rows, such as the events of a step."""
    ids = F.explode(F.array_compact(F.array(*[F.col(c).cast("string") for c in columns])))
    return rows.select(key, ids.alias("id")).distinct().groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("id")), ",").alias("ids"))
