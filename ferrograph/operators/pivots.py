"""Exact joins and searches by cosine over a pivot index: blocks of vectors skipped by the angle's triangle inequality.

Vectors are sorted by their nearest pivot and their angle to it, and cut into blocks; a block knows the least and greatest angle
of its vectors to every pivot. Two vectors are at least as far apart as their angles to any pivot differ, so two blocks
whose ranges lie further apart than a bound at some pivot need no comparison. Searches and top-k begin where blocks are near and
let the bound fall with what they have found.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import drop, stash

#: What angles are widened by, so that rounding skips nothing.
SLACK = 1e-6
#: Summaries of blocks that one task compares with as many others.
TILE = 1024
#: Blocks of a group: those of two groups meet in one task. Of few blocks there are FEWEST groups, so that several tasks have work.
GROUP, FEWEST = 64, 6


@dataclass
class PivotIndex:
    """Written blocks (block, n, ids, vectors, low, high), the pivots as unit vectors, and the length of a vector."""

    blocks: DataFrame
    pivots: np.ndarray
    length: int


@dataclass
class Compared:
    """A result with the number of pairs of blocks that were compared, of how many."""

    rows: DataFrame
    compared: int
    possible: int


def units(lists: pa.Array, length: int) -> np.ndarray:
    v = np.asarray(lists.flatten(), np.float64).reshape(-1, length)
    return v / np.linalg.norm(v, axis=1)[:, None]


def angles(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ y.T, -1, 1))


def pivot_index(rows: DataFrame, key: str, vector: str, pivots: int = 64, block: int = 1024, chosen: np.ndarray | None = None) -> PivotIndex:
    """The index of all rows whose vector has a direction: not null, no null or non-finite component, not zero, and as long as the pivots.

    Pivots are the rows of least hashed keys (or `chosen`, so that two indexes can be compared); they alone pass through the driver.
    """
    v = F.transform(vector, lambda x: x.cast("double"))
    fit = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    known = rows.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias("id"), v.alias("v")).where(fit)
    if chosen is None:
        first = known.orderBy(F.xxhash64("id", F.lit(3)), "id").limit(pivots).toArrow()
        length = len(first["v"][0]) if first.num_rows else 0
        lists = [x.as_py() for x in first["v"] if len(x) == length]
        chosen = np.array(lists, np.float64).reshape(-1, max(1, length))
        chosen /= np.linalg.norm(chosen, axis=1)[:, None] if len(chosen) else 1
    length = chosen.shape[1]
    shared = rows.sparkSession.sparkContext.broadcast(chosen)

    def placed(batches):
        for batch in batches:
            if batch.num_rows:
                far = angles(units(batch.column(1), length), shared.value)
                near = far.argmin(1)
                yield pa.RecordBatch.from_arrays([pa.array(near), pa.array(far[np.arange(len(near)), near]), *batch.columns], ["pivot", "far", "id", "v"])

    def cut(batches):
        held, made = None, 0

        def out(table: pa.Table) -> pa.RecordBatch:
            nonlocal made
            x = units(table["v"].combine_chunks(), length)
            far = angles(x, shared.value)
            made += 1
            cells = [(TaskContext.get().partitionId() << 32) | made, len(x), np.asarray(table["id"], np.int64).tobytes(), x.tobytes(), far.min(0).tobytes(), far.max(0).tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([c]) for c in cells], ["block", "n", "ids", "vectors", "low", "high"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            pivot = np.asarray(held["pivot"])
            at = 0
            while True:
                end = min(int(np.searchsorted(pivot, pivot[at], side="right")), at + block)
                if end == len(pivot):
                    break
                yield out(held.slice(at, end - at))
                at = end
            held = held.slice(at)
        if held is not None:
            yield out(held)

    order = ["pivot", "far", "id"]
    sorted_ = stash(known.where(F.size("v") == length).mapInArrow(placed, "pivot bigint, far double, id bigint, v array<double>"), "placed")
    blocks = sorted_.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(cut, "block bigint, n bigint, ids binary, vectors binary, low binary, high binary")
    found = PivotIndex(stash(blocks, "blocks"), chosen, length)
    drop(sorted_)
    return found


def near_blocks(left: PivotIndex, right: PivotIndex) -> DataFrame:
    """(a, b, bound) for all pairs of a block of left and a block of right: no two of their vectors have a smaller angle. Summaries meet in tiles."""

    def tiles(index: PivotIndex, side: str) -> tuple[DataFrame, int]:
        n = max(1, -(-index.blocks.count() // TILE))
        row = F.struct("block", "low", "high").alias("r")
        return index.blocks.select(F.pmod(F.xxhash64("block"), F.lit(n)).alias(side), row).groupBy(side).agg(F.collect_list("r").alias(f"{side}_rows")), n

    (x, _), (y, n) = tiles(left, "p"), tiles(right, "q")
    met = x.withColumn("q", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))).join(y, "q").select("p_rows", "q_rows")

    def bounds(batches):
        for batch in batches:
            for p, q in zip(batch.column(0), batch.column(1), strict=True):
                sides = [([r["block"] for r in s.as_py()], *(np.array([np.frombuffer(r[f], np.float64) for r in s.as_py()]) for f in ("low", "high"))) for s in (p, q)]
                (a, la, ha), (b, lb, hb) = sides
                for i, name in enumerate(a):
                    gap = np.maximum(la[i] - hb, lb - ha[i]).max(1)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), name), pa.int64()), pa.array(b, pa.int64()), pa.array(np.maximum(gap, 0.0))], ["a", "b", "bound"])

    return met.mapInArrow(bounds, "a bigint, b bigint, bound double")


def compared(pairs: DataFrame, left: PivotIndex, right: PivotIndex, keep, schema: str) -> DataFrame:
    """What `keep` (ids, vectors, ids, vectors of two blocks) yields as arrays for each pair (a, b) of blocks.

    Blocks travel by groups of GROUP on either side: a block goes to a task once for all its pairs with a group, not once a pair.
    """

    def groups(index: PivotIndex, side: str) -> tuple[DataFrame, DataFrame]:
        n = index.blocks.count()
        n = max(1, min(n, FEWEST), -(-n // GROUP))
        of = index.blocks.select(F.col("block").alias(side), F.pmod(F.xxhash64("block"), F.lit(n)).cast("int").alias(f"g{side}"))
        return of, index.blocks.select(F.pmod(F.xxhash64("block"), F.lit(n)).cast("int").alias(f"g{side}"), "block", "ids", "vectors")

    (of_a, from_a), (of_b, from_b) = groups(left, "a"), groups(right, "b")
    met = pairs.select("a", "b").join(of_a, "a").join(of_b, "b").groupBy("ga", "gb").agg(F.collect_list(F.struct("a", "b")).alias("pairs"))
    met = stash(met, "met")
    used = lambda x, other: met.select("ga", "gb", F.explode(F.array_distinct(F.transform("pairs", lambda p: p[x]))).alias("block"), F.lit(x).alias("side"))
    sent_a = used("a", "b").join(from_a, ["ga", "block"]).select("ga", "gb", "side", "block", "ids", "vectors")
    sent_b = used("b", "a").join(from_b, ["gb", "block"]).select("ga", "gb", "side", "block", "ids", "vectors")
    asked = met.select("ga", "gb", F.lit("").alias("side"), F.explode("pairs").alias("p")).select("ga", "gb", "side", F.col("p.a").alias("block"), F.col("p.b").alias("other"))
    none = F.lit(None)
    rows = sent_a.unionByName(sent_b).withColumn("other", none.cast("bigint")).unionByName(asked.withColumns({"ids": none.cast("binary"), "vectors": none.cast("binary")}))
    names, length = [f.split()[0] for f in schema.split(", ")], left.length

    def run(batches):
        at, held = None, {}
        for batch in batches:
            for ga, gb, side, block, ids, vectors, other in zip(*batch.columns, strict=True):
                now = ga.as_py(), gb.as_py()
                if now != at:
                    at, held = now, {}
                if side.as_py():
                    held[side.as_py(), block.as_py()] = np.frombuffer(ids.as_py(), np.int64), np.frombuffer(vectors.as_py(), np.float64).reshape(-1, length)
                else:
                    made = keep(*held["a", block.as_py()], *held["b", other.as_py()])
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in made], names)

    # sides sort behind pairs as letters, so in falling order blocks come first
    dealt = rows.repartition(max(1, met.count()), "ga", "gb").sortWithinPartitions("ga", "gb", F.desc("side"))
    return dealt.select("ga", "gb", "side", "block", "ids", "vectors", "other").mapInArrow(run, schema)


PAIR = "a bigint, b bigint, cosine double"


def rounded(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.round(np.clip(x @ y.T, -1, 1), 9)


def over(least: float):
    """Pairs of two blocks of cosine `least` or more, the smaller id first; a block's pairs with itself once."""

    def keep(ids_a, x, ids_b, y):
        cos = rounded(x, y)
        i, j = np.nonzero(cos >= least)
        a, b = ids_a[i], ids_b[j]
        ok = a < b if np.array_equal(ids_a, ids_b) and np.array_equal(x, y) else a != b
        return np.minimum(a, b)[ok], np.maximum(a, b)[ok], cos[i, j][ok]

    return keep


def cosine_pairs(rows: DataFrame, key: str, vector: str, least: float, pivots: int = 64, block: int = 1024) -> Compared:
    """All pairs (a, b, cosine) of rows, a < b, whose cosine (to 9 places) is `least` or more."""
    index = pivot_index(rows, key, vector, pivots, block)
    every = stash(near_blocks(index, index), "near")
    every = every.where("a <= b")
    pairs = stash(every.where(F.col("bound") <= float(np.arccos(np.clip(least, -1, 1))) + SLACK), "pairs")
    return Compared(compared(pairs, index, index, over(least), PAIR), pairs.count(), every.count())


def top_pairs(rows: DataFrame, key: str, vector: str, k: int, pivots: int = 64, block: int = 1024, rounds: int = 4) -> Compared:
    """The k pairs (a, b, cosine), a < b, of greatest cosine above 0, with their place (ties: the smaller a, then b).

    A block is compared with itself first; then with others, nearest first, a growing share a round, as long as the pair's
    bound is under the angle of the k-th best pair so far. The driver holds k rows.
    """
    index = pivot_index(rows, key, vector, pivots, block)
    every = stash(near_blocks(index, index), "near")
    best = lambda df: df.where("cosine > 0").orderBy(F.desc("cosine"), "a", "b").limit(k)

    def top(x):
        """No more than k pairs leave two blocks."""

        def keep(ids_a, x_, ids_b, y):
            a, b, cos = over(max(x, 1e-9))(ids_a, x_, ids_b, y)
            order = np.lexsort((b, a, -cos))[:k]
            return a[order], b[order], cos[order]

        return keep

    done = every.where("a = b")
    found = stash(best(compared(done, index, index, top(0.0), PAIR)), "top")
    n, reach = done.count(), -1.0
    for r in range(rounds):
        last = found.agg(F.count("*").alias("n"), F.min("cosine").alias("c")).first()
        least = last["c"] if last["n"] == k else 0.0
        limit = float(np.arccos(np.clip(least, -1, 1))) + SLACK
        upto = limit if r == rounds - 1 else float(every.where((F.col("a") < F.col("b")) & (F.col("bound") > reach) & (F.col("bound") <= limit)).agg(F.percentile_approx("bound", (r + 1) / rounds)).first()[0] or 0.0)
        now = stash(every.where((F.col("a") <= F.col("b")) & (F.col("a") != F.col("b")) & (F.col("bound") > reach) & (F.col("bound") <= min(upto, limit))), "now")
        n += now.count()
        before, found = found, stash(best(found.union(compared(now, index, index, top(least), PAIR))), "top")
        drop(before, now)
        reach = max(reach, min(upto, limit))
        if upto >= limit:
            break
    place = F.row_number().over(Window.orderBy(F.desc("cosine"), "a", "b"))  # k rows
    return Compared(found.withColumn("place", place), n, every.where("a <= b").count())


def neighbours(rows: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", pivots: int = 64, block: int = 1024) -> Compared:
    """For each query (key, vector) its k rows of greatest cosine (to 9 places), itself left out: key, other, cosine, place (ties: the smaller other).

    Each block of queries meets its nearest block of rows first; the worst k-th angle of its queries then bounds the blocks it still has to meet.
    """
    index = pivot_index(rows, key, vector, pivots, block)
    asked = pivot_index(queries, key, vector, chosen=index.pivots, block=block)
    every = stash(near_blocks(asked, index), "near")

    def keep(ids_a, x, ids_b, y):
        cos = rounded(x, y)
        cos[ids_a[:, None] == ids_b[None]] = -np.inf
        order = np.lexsort((np.broadcast_to(ids_b, cos.shape), -cos), axis=1)[:, :k]
        got = np.take_along_axis(cos, order, 1)
        ok = got > -np.inf
        return np.broadcast_to(ids_a[:, None], order.shape)[ok], ids_b[order][ok], got[ok]

    first = every.groupBy("a").agg(F.min(F.struct("bound", "b")).alias("m")).select("a", F.col("m.b").alias("b"))
    first = stash(first, "first")
    start = stash(compared(first, asked, index, keep, PAIR), "start")
    ranked = Window.partitionBy("a").orderBy(F.desc("cosine"), "b")
    kth = start.withColumn("place", F.row_number().over(ranked)).where(F.col("place") == k).select("a", "cosine")
    # the angle within which all queries of a block have k rows; no bound if one of them has fewer yet
    owner = asked.blocks.select("block", "n", "ids").mapInArrow(owners, "block bigint, n bigint, a bigint")
    worst = owner.join(kth, "a").groupBy("block", "n").agg(F.min("cosine").alias("c"), F.count("*").alias("have"))
    reach = worst.select(F.col("block").alias("a"), F.when(F.col("have") == F.col("n"), F.acos(F.col("c")) + SLACK).alias("reach"))
    more = every.join(reach, "a", "left").where(F.col("reach").isNull() | (F.col("bound") <= F.col("reach"))).join(first, ["a", "b"], "left_anti")
    more = stash(more.select("a", "b"), "more")
    found = start.union(compared(more, asked, index, keep, PAIR)).withColumn("place", F.row_number().over(ranked)).where(F.col("place") <= k)
    return Compared(found.select(F.col("a").alias(key), F.col("b").alias("other"), "cosine", "place"), first.count() + more.count(), every.count())


def owners(batches):
    """The queries of each block, one a row."""
    for batch in batches:
        for block, n, ids in zip(*batch.columns, strict=True):
            ids = np.frombuffer(ids.as_buffer(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), block.as_py())), pa.array(np.full(len(ids), n.as_py())), pa.array(ids)], ["block", "n", "a"])
