"""Ordered analytics: latest rows, ranks, baselines, neighbours in order, as-of lookups, running state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The row of each key that is greatest in `order`: a partial maximum, so a key of many rows is reduced before it is shuffled."""
    best = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.struct(*rows.columns).alias("row"))
    return rows.groupBy(*keys).agg(F.max(best).alias("best")).select("best.row.*")


def ranked(rows: DataFrame, series: str, value: str, order: list[str]) -> DataFrame:
    """rows with `place`: 1 for the series' greatest value, ties by `order`; null values have none."""
    place = F.row_number().over(Window.partitionBy(series).orderBy(F.desc_nulls_last(value), *order))
    return rows.withColumn("place", F.when(F.col(value).isNotNull(), place))


def against_baseline(rows: DataFrame, series: str, order: list[str], fields: list[str]) -> DataFrame:
    """rows with `changed` and `controlled`: the fields (joined by +) that differ from, or equal, the series' first row."""
    first = Window.partitionBy(series).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    same = {f: F.col(f).eqNullSafe(F.first(f).over(first)) for f in fields}
    return rows.withColumn("changed", F.concat_ws("+", *[F.when(~s, F.lit(f)) for f, s in same.items()])).withColumn("controlled", F.concat_ws("+", *[F.when(s, F.lit(f)) for f, s in same.items()]))


def trajectories(rows: DataFrame, series: str, value: str, at: str, least: int = 2) -> DataFrame:
    """Per series with at least `least` rows: n, best, first and last value by `at`, and labels of how it went."""
    found = rows.groupBy(series).agg(
        F.count("*").alias("n"), F.max(value).alias("best"), F.min_by(value, at).alias("first"), F.max_by(value, at).alias("last"),
        F.max((F.col(value) > 0).cast("int")).alias("some"), F.min((F.col(value) > 0).cast("int")).alias("every"),
    ).where(F.col("n") >= least)
    label = F.concat_ws("+", F.when(F.col("last") > F.col("first"), "improved"), F.when(F.col("best") > F.col("last"), "peaked_before_end"), F.when(F.col("every") == 1, "all_positive"), F.when(F.col("n") >= 10, "long"))
    return found.withColumn("labels", label).drop("some", "every")


def neighbours(rows: DataFrame, group: str, order: str, node: Column) -> DataFrame:
    """Edges (group, from_node, to_node) from each row to the next of its group."""
    w = Window.partitionBy(group).orderBy(order)
    return rows.select(group, node.alias("from_node"), F.lead(node).over(w).alias("to_node")).where("to_node is not null")


def as_of(events: DataFrame, group: str, at: str, key: str, asks: Column, gives: Column, value: str) -> DataFrame:
    """Rows where `asks` holds, with `found`: value of the latest earlier row of the group where `gives` holds (ties by key)."""
    w = Window.partitionBy(group).orderBy(at, key).rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("found", F.last(F.when(gives, F.col(value)), ignorenulls=True).over(w)).where(asks)


def suffixed(rows: DataFrame, base: Column, order: str) -> DataFrame:
    """rows with `unique_id`: base, then base~2, base~3 for later rows of equal base."""
    n = F.row_number().over(Window.partitionBy(base).orderBy(order))
    return rows.withColumn("unique_id", F.when(n == 1, base).otherwise(F.concat(base, F.lit("~"), n.cast("string"))))


def running_flags(rows: DataFrame, group: str, order: str, flags: dict[str, Column]) -> DataFrame:
    """rows with, for each flag, whether it has held up to and with this row, and `before_<flag>`, whether it had before."""
    w = Window.partitionBy(group).orderBy(order)
    out = rows
    for name, flag in flags.items():
        held = F.max(flag.cast("int"))
        out = out.withColumn(name, held.over(w.rowsBetween(Window.unboundedPreceding, 0)) == 1)
        out = out.withColumn(f"before_{name}", F.coalesce(held.over(w.rowsBetween(Window.unboundedPreceding, -1)) == 1, F.lit(False)))
    return out


def circle_layout(nodes: DataFrame, key: str, group: str) -> DataFrame:
    """nodes with x and y on a circle of radius max(64, 24 n) for each group, in order of key."""
    n = F.count("*").over(Window.partitionBy(group))
    angle = (F.row_number().over(Window.partitionBy(group).orderBy(key)) - 1) * F.lit(2 * 3.141592653589793) / n
    radius = F.greatest(F.lit(64.0), n * 24.0)
    return nodes.withColumns({"x": F.round(radius * F.cos(angle), 4), "y": F.round(radius * F.sin(angle), 4)})
