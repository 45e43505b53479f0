"""Steps of plans and members of clusters: what is ready, what belongs together, what does not add up."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ready(steps: DataFrame, dependencies: DataFrame, run: str, step: str) -> DataFrame:
    """Steps (run, step, done) not yet done with `state`: ready if all they depend on (step, needs) is done, else waiting."""
    done = steps.select(run, F.col(step).alias("needs"), F.col("done").alias("__d"))
    met = steps.where("not done").join(dependencies, step, "left").join(done, [run, "needs"], "left")
    blocked = F.max((F.col("needs").isNotNull() & ~F.coalesce(F.col("__d"), F.lit(False))).cast("int"))
    return met.groupBy(run, step).agg(blocked.alias("b")).select(run, step, F.when(F.col("b") == 1, "waiting").otherwise("ready").alias("state"))


def inside(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges (a, b) both of whose ends are members (node, cluster) of one cluster, with that cluster."""
    one = edges.join(members.select(F.col("node").alias("a"), "cluster"), "a")
    return one.join(members.select(F.col("node").alias("b"), "cluster"), ["b", "cluster"])


def best_cluster(members: DataFrame) -> DataFrame:
    """Per node of members (node, cluster) its largest cluster, ties by name: node, cluster, n."""
    sized = members.join(members.groupBy("cluster").agg(F.count("*").alias("n")), "cluster")
    w = Window.partitionBy("node").orderBy(F.desc("n"), "cluster")
    return sized.withColumn("__p", F.row_number().over(w)).where("__p = 1").select("node", "cluster", "n")


def miscounted(declared: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """Groups (key, declared) whose declared size is not the number of their members: key, declared, found; groups without members count 0."""
    counts = members.groupBy(key).agg(F.count("*").alias("found"))
    return declared.join(counts, key, "left").select(key, "declared", F.coalesce("found", F.lit(0)).alias("found")).where("declared <> found")


def inverse(edges: DataFrame) -> DataFrame:
    """Edges (a, b) seen from b: node, n_from, least and greatest a."""
    return edges.groupBy(F.col("b").alias("node")).agg(F.count_distinct("a").alias("n_from"), F.min("a").alias("first_from"), F.max("a").alias("last_from"))
