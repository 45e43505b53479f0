"""Graph operators: components, reachability, cycles, forests. Loops write each round to the shared folder."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import drop, stash


#: Rows of one node beyond which a join by it would burden one task.
HOT = 100_000


def with_least(rows: DataFrame, by: str, least: DataFrame) -> DataFrame:
    """rows (a, b) with m: that of the node `by` in least (a, m), null if it has none.

    Nodes of more than HOT rows are few; their m is broadcast, so that their rows stay where they are and no task gets them all.
    Both tables are written, as they are read more than once.
    """
    found = least.select(F.col("a").alias(by), "m")
    if rows.count() <= HOT:
        return rows.join(found, by, "left").select("a", "b", "m")
    hot = stash(rows.groupBy(by).agg(F.count("*").alias("n")).where(F.col("n") > HOT).join(found, by, "left").select(by, F.col("m").alias("hot_m"), F.lit(True).alias("hot")), "hot")
    if hot.isEmpty():
        return rows.join(found, by, "left").select("a", "b", "m")
    told = rows.join(F.broadcast(hot), by, "left")
    cold = told.where("hot is null").select("a", "b").join(found, by, "left").select("a", "b", "m")
    return told.where("hot").select("a", "b", F.col("hot_m").alias("m")).union(cold)


def components(edges: DataFrame, name: str = "components", rounds: int = 60) -> DataFrame:
    """(node, component) for each node of undirected edges (a, b); component is the smallest node reachable.

    Alternating large-star and small-star rounds: each keeps connectivity and moves every node towards its
    smallest neighbour, so chains halve in length and no node's neighbours are ever gathered in one row or one task.
    Ends when a round changes no edge. Raises if `rounds` do not suffice.
    """
    now = stash(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    seen = None
    for _ in range(rounds):
        # large star: a node's larger neighbours are linked to the smallest of its neighbourhood, itself included
        low = stash(now.groupBy("a").agg(F.min("b").alias("m")), "low")
        large = with_least(now, "b", low).select("a", F.coalesce("m", "b").alias("b")).distinct()
        large = stash(large, "large")
        # small star: smaller neighbours and the node itself are linked to the smallest
        least = stash(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = with_least(large, "a", least).select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        last, now = now, stash(small, name)
        drop(last, low, large, least)
        got = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"), F.count_distinct("a").alias("d")).first()
        if got == seen and got["n"] == got["d"]:
            break
        seen = got
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    ends = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return ends.union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def reachable(edges: DataFrame, starts: DataFrame, rounds: int = 1000) -> DataFrame:
    """(node, depth) of all nodes reachable from starts (node) along edges (a, b); breadth first, one round a depth."""
    seen = stash(starts.select("node").distinct().withColumn("depth", F.lit(0)), "reach")
    front = seen
    for depth in range(1, rounds + 1):
        found = edges.join(front, edges["a"] == front["node"]).select(F.col("b").alias("node")).distinct()
        front = stash(found.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)), "front")
        if front.isEmpty():
            return seen
        seen = seen.union(front)
    raise RuntimeError(f"more than {rounds} rounds")


def on_cycles(edges: DataFrame, rounds: int = 1000) -> DataFrame:
    """Edges left when nodes without a way in or out are peeled off again and again: those on cycles or between them."""
    now = stash(edges.select("a", "b").where("a is not null and b is not null").distinct(), "peel")
    n = now.count()
    for _ in range(rounds):
        last, now = now, stash(now.join(now.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(now.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b"), "peel")
        drop(last)
        left = now.count()
        if left == n:
            return now
        n = left
    raise RuntimeError(f"more than {rounds} rounds")


def cycles(edges: DataFrame, longest: int | None = None) -> DataFrame:
    """Simple cycles as arrays, each once, beginning at its smallest node; self-loops count. Of at most `longest` nodes, if that is given.

    All cycles are listed, which may be very many in a dense graph; operators/cycles.py finds one of each component.
    """
    core = on_cycles(edges)
    paths = core.where("b >= a").select(F.array("a").alias("path"), F.col("b").alias("next"))
    found = paths.where(F.col("path")[0] == F.col("next")).select("path")
    for _ in range(longest - 1) if longest else count():
        grown = paths.where("path[0] <> next").select(F.concat("path", F.array("next")).alias("path"))
        paths = stash(grown.join(core, F.element_at("path", -1) == F.col("a")).select("path", F.col("b").alias("next")).where("next >= path[0] and (next = path[0] or not array_contains(path, next))"), "paths")
        found = found.union(paths.where("path[0] = next").select("path"))
        if paths.where("path[0] <> next").isEmpty():
            break
    return found


#: Edges that one task settles by itself.
SMALL = 1 << 20


def ringless(x: np.ndarray, y: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Of edges (x, y) taken in an order, the places of those that close no ring."""
    nodes, ends = np.unique(np.concatenate([x, y]), return_inverse=True)
    ends = ends.reshape(2, -1)[:, order]
    above, kept, step = np.arange(len(nodes)), [], max(1 << 14, len(nodes) // 4)
    for at in range(0, len(order), step):
        i, j = above[ends[0, at : at + step]], above[ends[1, at : at + step]]
        apart = np.flatnonzero(i != j)
        if not len(apart):
            continue
        under = above.tolist()
        for place, u, v in zip(apart.tolist(), i[apart].tolist(), j[apart].tolist(), strict=True):
            while under[u] != u:
                under[u] = u = under[under[u]]
            while under[v] != v:
                under[v] = v = under[under[v]]
            if u != v:
                under[max(u, v)] = min(u, v)
                kept.append(at + place)
        above = np.array(under)
        while (above != (up := above[above])).any():
            above = up
    return order[np.array(kept, np.int64)]


def forest_places(a: np.ndarray, b: np.ndarray, w: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Places of the maximum spanning forest of edges between nodes x and y, ties by smaller (a, b)."""
    return ringless(x, y, np.lexsort((b, a, -np.where(np.isnan(w), np.inf, w))))


def sieve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The forest of a task's own edges; of those it has read so far, it holds 2 * SMALL besides the forest at most."""
    held, least = [], 0

    def forest() -> pa.Table:
        table = pa.Table.from_batches(held).combine_chunks()
        return table.take(pa.array(np.sort(forest_places(*(np.asarray(c) for c in table.columns)))))

    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) > least + 2 * SMALL:
            held = forest().to_batches()
            least = sum(map(len, held))
    if held:
        yield from forest().to_batches(1 << 16)


def merged(edges: DataFrame) -> DataFrame:
    """components of written edges (a, b) of no loops; few ones are settled in one task."""
    if edges.count() > SMALL:
        return components(edges, "merge")

    def settle(batches):
        if held := list(batches):
            a, b = (np.asarray(c, np.int64) for c in pa.Table.from_batches(held).columns)
            nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
            x, y = ends.reshape(2, -1)
            least = np.arange(len(nodes))
            while (least[x] != least[y]).any():
                low = np.minimum(least[x], least[y])
                last = least.copy()
                for end in (last[x], last[y]):  # the least numbers of both ends' trees meet
                    np.minimum.at(least, end, low)
                while (least != (up := least[least])).any():
                    least = up
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[least])], ["node", "component"])

    return edges.select("a", "b").repartition(1).mapInArrow(settle, "node bigint, component bigint")


def settled(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Edges (a, b, w) of the maximum spanning forest of edges (a, b, w, x, y) between nodes x and y, ties by smaller (a, b).

    In a round each component takes its best edge; once there are few components, each task leaves the forest of its own
    edges (what is not in it is not in the whole forest either), until one task can settle what is left.
    """
    rank = F.struct(F.col("w").alias("w"), (-F.col("a")).alias("na"), (-F.col("b")).alias("nb"))
    edges = edges.where("x <> y").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w", "x", "y")
    open_ = stash(edges.groupBy("a", "b").agg(F.max("w").alias("w"), F.max(F.struct(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))).alias("e")).select("a", "b", "w", "e.x", "e.y"), "forest")
    chosen = None
    for _ in range(rounds):
        n = open_.count()
        if n <= SMALL:
            rest = open_.repartition(1).mapInArrow(sieve, open_.schema).select("a", "b", "w")
            return rest if chosen is None else chosen.union(rest)
        last = open_
        if 4 * open_.select(F.col("x").alias("c")).union(open_.select("y")).distinct().count() <= SMALL:
            open_ = stash(open_.repartition(-(-n // SMALL)).mapInArrow(sieve, open_.schema), "forest")
        else:
            sides = open_.select(F.col("x").alias("c"), rank.alias("r")).union(open_.select(F.col("y").alias("c"), rank.alias("r")))
            best = sides.groupBy("c").agg(F.max("r").alias("r")).select((-F.col("r.na")).alias("a"), (-F.col("r.nb")).alias("b")).distinct()
            took = stash(open_.join(best, ["a", "b"]), "took")
            chosen = took.select("a", "b", "w") if chosen is None else chosen.union(took.select("a", "b", "w"))
            into = stash(merged(took.select(F.col("x").alias("a"), F.col("y").alias("b"))), "into")
            moved = open_.join(into.select(F.col("node").alias("x"), F.col("component").alias("cx")), "x", "left").join(into.select(F.col("node").alias("y"), F.col("component").alias("cy")), "y", "left")
            open_ = stash(moved.select("a", "b", "w", F.coalesce("cx", "x").alias("x"), F.coalesce("cy", "y").alias("y")).where("x <> y"), "forest")
        drop(last)
    raise RuntimeError(f"more than {rounds} rounds")


def spanning_forest(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Edges (a, b, w) of the maximum spanning forest, ties by smaller (a, b)."""
    return settled(edges.select("a", "b", "w", F.col("a").alias("x"), F.col("b").alias("y")), rounds)
