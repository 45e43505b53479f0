"""Pairs by shared keys, sets and vectors; hybrid edges and their clusters."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import band, tanimoto
from ..tables import drop, stash
from .graphs import components, forest_places, merged, settled


def top_neighbours(rows: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", block: int = 1024, metric: str | None = None, where: list[Column] = ()) -> DataFrame:
    """For each query row (key, vector) its k rows of greatest cosine among rows, itself left out: key, other, cosine, place.

    With a metric ("cosine", "l2" or "inner_product") its k nearest rows instead: key, other, distance, place. Conditions
    restrict the rows that are found, not the queries.

    Both sides are packed into blocks of `block` vectors; each pair of blocks is one matrix product. A task merges what its
    pairs find, so what is shuffled is a block a pair and then k rows a query and task. Null vectors and zero vectors have none.
    """

    def packed(df: DataFrame, name: str) -> DataFrame:
        parts = F.pmod(F.xxhash64(key), F.lit(max(1, -(-df.count() // block)))).alias(name)
        return df.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(parts, F.struct(F.col(key).cast("bigint").alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v")).alias("r")).groupBy(name).agg(F.collect_list("r").alias(name + "_rows"))

    for condition in where:
        rows = rows.where(condition)
    left, right = packed(queries, "q"), packed(rows, "d")
    n = F.lit(max(1, -(-queries.count() // block)))
    pairs = right.withColumn("q", F.explode(F.sequence(F.lit(0).cast("bigint"), (n - 1).cast("bigint")))).join(left, "q")

    def product(batches):
        found: dict[int, tuple] = {}

        def merged(one: tuple) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c) for c in one], [key, "other", "cosine"])

        for batch in batches:
            for q, q_rows, d_rows in zip(*batch.columns, strict=True):
                (ids, a), (others, b) = square(q_rows.values), square(d_rows.values)
                a_length, b_length = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
                with np.errstate(all="ignore"):
                    if metric == "l2":  # dimension by dimension: the product's form loses small distances
                        cos = -np.round(np.sqrt(sum((x[:, None] - y[None]) ** 2 for x, y in zip(a.T, b.T, strict=True))), 9)
                    else:
                        cos = np.round(a @ b.T if metric == "inner_product" else (a @ b.T) / a_length[:, None] / b_length[None], 9)
                cos[(ids[:, None] == others[None]) | ~np.isfinite(cos)] = -np.inf
                got = foremost(cos, ids, others, k)
                q = q.as_py()
                if q in found:
                    got = first_k(*(np.concatenate(c) for c in zip(found[q], got, strict=True)), k)
                elif len(found) >= 64:
                    yield merged(found.pop(next(iter(found))))
                found[q] = got
        yield from map(merged, found.values())

    found = pairs.select("q", "q_rows", "d_rows").mapInArrow(product, f"{key} bigint, other bigint, cosine double")
    best = Window.partitionBy(key).orderBy(F.desc("cosine"), "other")
    found = found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)
    if metric is None:
        return found
    distance = F.lit(1.0) - F.col("cosine") if metric == "cosine" else -F.col("cosine")
    return found.select(key, "other", distance.alias("distance"), "place")


def square(rows: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a block's rows (id, v), and their vectors, all of one length, as a matrix."""
    return np.asarray(rows.field("id"), np.int64), np.asarray(rows.field("v").flatten(), np.float64).reshape(len(rows), -1)


def first_k(ids: np.ndarray, others: np.ndarray, cos: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each id the k rows of greatest cosine, ties by smaller other."""
    order = np.lexsort((others, -cos, ids))
    ids, others, cos = ids[order], others[order], cos[order]
    kept = np.arange(len(ids)) - np.searchsorted(ids, ids) < k
    return ids[kept], others[kept], cos[kept]


def foremost(cos: np.ndarray, ids: np.ndarray, others: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """first_k of a matrix (ids by others): only what reaches a row's k-th value is sorted."""
    least = -np.partition(-cos, k - 1, axis=1)[:, k - 1] if cos.shape[1] > k else np.full(len(ids), -np.inf)
    i, j = np.nonzero((cos >= least[:, None]) & (cos > -np.inf))
    return first_k(ids[i], others[j], cos[i, j], k)


def class_pairs(items: DataFrame, key: str, bases: dict[str, Column], scores: dict[str, float]) -> DataFrame:
    """Pairs of classes that share at least one basis: a, b (smallest keys), n_a, n_b, basis (names joined), score, confidence.

    Items with equal values of all bases are one class, named by its smallest key, so copies are never paired out; a class
    of two or more is paired with itself. score is the best of the shared bases' scores.
    """
    names = list(bases)
    classes = items.select(F.col(key).alias("id"), *(c.alias(n) for n, c in bases.items())).groupBy(*names).agg(F.min("id").alias("id"), F.count("*").alias("n"))
    keyed = classes.select("id", "n", F.explode(F.array_compact(F.array(*[F.when(F.col(n).isNotNull(), F.struct(F.lit(n).alias("basis"), F.col(n).cast("string").alias("value"))) for n in names]))).alias("k")).select("id", "n", "k.*")
    other = keyed.select(F.col("id").alias("b"), F.col("n").alias("n_b"), "basis", "value")
    score = F.coalesce(*[F.when(F.col("basis") == n, F.lit(s)) for n, s in scores.items()])
    met = keyed.join(other, ["basis", "value"]).where("id < b or id = b and n > 1")
    out = met.groupBy(F.col("id").alias("a"), "b").agg(F.first("n").alias("n_a"), F.first("n_b").alias("n_b"), F.array_join(F.sort_array(F.collect_set("basis")), "+").alias("basis"), F.max(score).alias("score"))
    return out.withColumn("confidence", band(F.col("score"), 0.85, 0.65))


#: Bits that one product of two packs of sets covers.
CHUNK = 2048


def common(x: pa.ListArray, y: pa.ListArray) -> np.ndarray:
    """Of two columns of sets of numbers, how many each of the one shares with each of the other."""
    sides = [np.asarray(c.flatten(), np.int64) for c in (x, y)]
    owners = [np.repeat(np.arange(len(c)), np.asarray(c.value_lengths())) for c in (x, y)]
    bits = np.intersect1d(np.unique(sides[0]), np.unique(sides[1]), assume_unique=True)
    shared = np.zeros((len(x), len(y)))
    for at in range(0, len(bits), CHUNK):
        some = bits[at : at + CHUNK]
        made = []
        for owner, side, column in zip(owners, sides, (x, y), strict=True):
            place = np.minimum(np.searchsorted(some, side), len(some) - 1)
            held = some[place] == side
            matrix = np.zeros((len(column), len(some)), np.float32)
            matrix[owner[held], place[held]] = 1
            made.append(matrix)
        shared += made[0] @ made[1].T
    return shared


def tanimoto_links(sets: DataFrame, key: str, bits: str, percent: int, pack: int = 2048) -> DataFrame:
    """Per item: key, class_id (smallest key with the same set), n_links: other items with 100 * shared >= percent * all bits.

    Equal sets are folded to classes first. Classes are packed, by number and by bits; a pair of packs is one product of 0-1
    matrices over the bits that both hold, `CHUNK` bits at a time, and only counts of links leave it. All pairs of classes are
    compared, as at low thresholds hardly any prefix tells sets apart. Bits travel as numbers. Empty sets have no links.
    """
    items = sets.select(F.col(key).alias("id"), F.array_sort(F.array_distinct(F.transform(bits, lambda b: F.xxhash64(b)))).alias("s"))
    classes = stash(items.groupBy("s").agg(F.min("id").alias("c"), F.count("*").alias("n")), "classes")
    full = classes.where(F.size("s") > 0)
    size = full.agg(F.count("*").alias("n"), F.sum(F.size("s")).alias("bits")).first()
    packs = max(1, -(-size["n"] // pack), -(-(size["bits"] or 0) // (1024 * pack)))
    packed = full.select(F.pmod(F.xxhash64("c"), F.lit(packs)).cast("int").alias("p"), F.struct(F.col("c").cast("bigint").alias("c"), "n", "s").alias("r")).groupBy("p").agg(F.collect_list("r").alias("p_rows"))
    left = packed.withColumn("q", F.explode(F.sequence(F.col("p"), F.lit(packs - 1))))
    pairs = left.join(packed.select(F.col("p").alias("q"), F.col("p_rows").alias("q_rows")), "q").select("p", "q", "p_rows", "q_rows")

    def linked(batches):
        for batch in batches:
            for p, q, x, y in zip(*batch.columns, strict=True):
                x, y = x.values, y.values
                over = (100 + percent) * common(x.field("s"), y.field("s")) >= percent * np.add.outer(*(np.asarray(r.field("s").value_lengths(), np.float64) for r in (x, y)))
                if p.as_py() == q.as_py():
                    np.fill_diagonal(over, False)
                for mine, other, held in ((x, y, over), (y, x, over.T))[: 1 if p.as_py() == q.as_py() else 2]:
                    m = held @ np.asarray(other.field("n"), np.float64)
                    some = np.flatnonzero(m)
                    yield pa.RecordBatch.from_arrays([mine.field("c").take(pa.array(some)), pa.array(m[some].astype(np.int64))], ["c", "m"])

    counts = pairs.mapInArrow(linked, "c bigint, m bigint").groupBy("c").agg(F.sum("m").alias("m"))
    known = classes.join(counts, "c", "left").select("s", "c", (F.coalesce("m", F.lit(0)) + F.when(F.size("s") > 0, F.col("n") - 1).otherwise(0)).cast("bigint").alias("n_links"))
    return items.join(known, "s").select(F.col("id").alias(key), F.col("c").alias("class_id"), "n_links")


# The two presets of component weights, and the thresholds of edge classes.
WEIGHTS = {"hybrid": {"semantic": 0.20, "fingerprint": 0.30, "center": 0.25, "embedding": 0.25}, "even": {"semantic": 0.25, "fingerprint": 0.30, "center": 0.25, "embedding": 0.20}}
STRICT, CANDIDATE, SEMANTIC = 0.75, 0.55, 0.65


def hybrid_edges(scores: DataFrame, preset: str = "hybrid") -> DataFrame:
    """Pairs (a, b) with one score from components (a, b, component, score): the best score of each component counts.

    "hybrid": a missing component's weight goes to the fingerprint if there is one, else the rest is scaled up; "even":
    always scaled up. Also basis (components present), computed (any but semantic), conflict (a centre of 0 beside a
    fingerprint under .55), and class: strict, candidate, semantic or none.
    """
    w = WEIGHTS[preset]
    pairs = scores.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "component", "score").where("a <> b")
    return scored(pairs.groupBy("a", "b").agg(*[F.max(F.when(F.col("component") == c, F.col("score"))).alias(c) for c in w]), preset)


def scored(wide: DataFrame, preset: str = "hybrid") -> DataFrame:
    """hybrid_edges of pairs (a, b) that hold their components as columns, each pair once."""
    w = WEIGHTS[preset]
    have = {c: F.when(F.col(c).isNotNull(), F.lit(x)).otherwise(0.0) for c, x in w.items()}
    total = sum((x for x in have.values()), F.lit(0.0))
    plain = sum((x * F.coalesce(c, F.lit(0.0)) for c, x in have.items()), F.lit(0.0))
    score = plain / total
    if preset == "hybrid":
        score = F.when(F.col("fingerprint").isNotNull(), plain + (F.lit(1.0) - total) * F.col("fingerprint")).otherwise(score)
    computed = F.col("fingerprint").isNotNull() | F.col("center").isNotNull() | F.col("embedding").isNotNull()
    conflict = F.coalesce((F.col("center") == 0) & (F.col("fingerprint") < 0.55), F.lit(False))
    basis = F.concat_ws("+", *[F.when(F.col(c).isNotNull(), F.lit(c)) for c in w])
    out = wide.select("a", "b", F.round(score, 6).alias("score"), basis.alias("basis"), computed.alias("computed"), conflict.alias("conflict"))
    kind = F.when(F.col("computed") & (F.col("score") >= STRICT) & ~F.col("conflict"), "strict").when(F.col("computed") & (F.col("score") >= CANDIDATE) & ~F.col("conflict"), "candidate").when(~F.col("computed") & (F.col("score") >= SEMANTIC), "semantic").otherwise("none")
    return out.withColumn("class", kind)


def clusters(edges: DataFrame, least: int = 2) -> DataFrame:
    """Components of edges (a, b, score): cluster, n_members, n_edges, mean_score, min_score, representative.

    The representative has most edges, then the greatest sum of scores, then the smallest id.
    """
    member = components(edges)
    inside = edges.join(member, edges["a"] == member["node"]).select("component", "a", "b", "score")
    ends = inside.select("component", F.col("a").alias("node"), "score").union(inside.select("component", "b", "score"))
    degree = ends.groupBy("component", "node").agg(F.count("*").alias("d"), F.sum(F.col("score").cast("decimal(18,6)")).alias("s"))
    best = degree.groupBy("component").agg(F.count("*").alias("n_members"), (-F.max(F.struct("d", "s", (-F.col("node")).alias("m")))["m"]).alias("representative"))
    stats = inside.groupBy("component").agg(F.count("*").alias("n_edges"), F.round(F.sum(F.col("score").cast("decimal(18,6)")).cast("double") / F.count("*"), 9).alias("mean_score"), F.min("score").alias("min_score"))
    return best.join(stats, "component").where(F.col("n_members") >= least).select(F.col("component").alias("cluster"), "n_members", "n_edges", "mean_score", "min_score", "representative")


#: Rows of a pack at most.
LARGE = 16384
#: Parts in which the pairs of one pack are dealt.
SHARES = 4
PARTS = "a bigint, b bigint, semantic double, fingerprint double, center double, embedding double"


def folded(rows: DataFrame, key: str, vector: str, label: str) -> tuple[DataFrame, DataFrame]:
    """Classes (id, l, v) of rows of equal vector and label, named by their smallest key, and (a, b) with components for each class a and its further members b."""
    from ..functions.scalars import cosine, sign_bits

    double = F.transform("v", lambda x: x.cast("double"))
    known = rows.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.col(vector).alias("v"), F.col(label).cast("string").alias("l")).where("v is not null or l is not null")
    if known.schema["v"].dataType.elementType.typeName() != "float":  # floats travel as they are, in half the bytes
        known = known.withColumn("v", double)
    classes = stash(known.groupBy("v", "l").agg(F.min("id").alias("c"), F.count("*").alias("n")), "classes")
    copies = known.join(classes.where("n > 1").withColumnsRenamed({"v": "cv", "l": "cl"}), F.col("v").eqNullSafe(F.col("cv")) & F.col("l").eqNullSafe(F.col("cl"))).where("id <> c").withColumn("v", double)
    has = F.col("v").isNotNull()
    within = copies.select(
        F.col("c").alias("a"), F.col("id").alias("b"), F.when(F.col("l").isNotNull(), 0.95).alias("semantic"), F.when(has, F.round(tanimoto(sign_bits(F.col("v")), sign_bits(F.col("v"))), 9)).alias("fingerprint"),
        F.lit(None).cast("double").alias("center"), F.when(has, F.round(cosine(F.col("v"), F.col("v")), 9)).alias("embedding"),
    )
    return classes.select(F.col("c").alias("id"), "l", "v"), within


def packs(items: DataFrame, size: int, least: int, most: int) -> tuple[DataFrame, int]:
    """Packs (p, p_rows) of items (id and others), and their number: some 16, so that every core has pairs, of `least` rows or more and `most` or fewer."""
    n = max(1, -(-size // most), min(16, -(-size // least)))
    return stash(items.select(F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("p"), F.struct("id", *[c for c in items.columns if c != "id"]).alias("r")).groupBy("p").agg(F.collect_list("r").alias("p_rows")), "packs"), n


def dealt(left: DataFrame, right: DataFrame, n: int, spread: int = 1) -> DataFrame:
    """Pairs (p, q, p_rows, q_rows) of packs (p, p_rows, q, share) with those of n packs (p, p_rows) whose number is q, in `SHARES` parts each.

    There are `spread` tasks a part; with more of them, fewer parts share one.
    """
    right = right.select(F.col("p").alias("q"), F.col("p_rows").alias("q_rows"), F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("share"))
    sides = [side.repartition(spread * SHARES * n, "q", "share") for side in (left, right)]
    return sides[0].join(sides[1], ["q", "share"]).select("p", "q", "p_rows", "q_rows")


def ring(packed: DataFrame, n: int, spread: int = 1) -> DataFrame:
    """All pairs of n packs, also of one with itself: each meets the half of the others that follow it in a ring, so all have as many pairs."""
    left = packed.withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(n // 2)))).where(f"2 * d < {n} or 2 * p < {n}")
    return dealt(left.select("p", "p_rows", ((F.col("p") + F.col("d")) % n).alias("q"), (F.col("d") % SHARES).alias("share")), packed, n, spread)


def packed_classes(rows: DataFrame, key: str, vector: str, label: str, least: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (p, q, p_rows, q_rows) of packs of classes, and (a, b) with components for each class a and its further members b.

    Rows of equal vector and label are folded to a class, named by its smallest key: classes are paired with each other, and
    a class with each of its further members, so copies are linked but never paired out.
    """
    classes, within = folded(rows, key, vector, label)
    return ring(*packs(classes, classes.count(), least, most)), within


class Side:
    """The rows of a pack as matrices: id, label (-1: none) and length (-1: no vector), vectors filled up with zeros, their sign bits."""

    def __init__(self, rows: pa.StructArray, labels: np.ndarray, width: int):
        lists = rows.field("v")
        self.id, self.label = np.asarray(rows.field("id"), np.int64), labels
        self.size = np.asarray(lists.value_lengths().fill_null(-1), np.int64)
        self.v = np.zeros((len(rows), width))
        self.v[np.arange(width)[None] < self.size[:, None]] = np.asarray(lists.flatten(), np.float64)
        self.norm, self.bits = np.linalg.norm(self.v, axis=1), self.v > 0
        self.count = self.bits.sum(1)

    @classmethod
    def both(cls, x: pa.StructArray, y: pa.StructArray) -> tuple[Side, Side]:
        labels = np.asarray(pa.concat_arrays([x.field("l"), y.field("l")]).dictionary_encode().indices.fill_null(-1), np.int64)
        width = max((n for r in (x, y) for n in r.field("v").value_lengths().to_pylist() if n), default=0)
        return cls(x, labels[: len(x)], width), cls(y, labels[len(x) :], width)

    def even(self) -> set[int]:
        """Lengths of its vectors, and -1 if a norm is too small, too great or no number, so that no bound can be relied on."""
        odd = (self.norm != 0) & ~((self.norm > 1e-100) & (self.norm < 1e100))
        return {*np.unique(self.size[self.size >= 0]).tolist(), *([-1] if odd.any() else [])}

    def directions(self) -> np.ndarray:
        """Of each row its bits over the root of twice their number, and its vector of length 1: the one's products are half the bits' cosine."""
        bits = self.bits / np.sqrt(2 * np.maximum(self.count, 1))[:, None]
        return np.hstack([bits, self.v / np.where(self.norm > 0, self.norm, 1)[:, None]]).astype(np.float32)


def candidates(x: Side, y: Side, alone: bool, least: float, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) in two packs, or in one if `alone`, of all pairs whose score may be `least` or more, each once; few others.

    A fingerprint is f = r / (1 - r), r being the common bits over the sum of both counts, at most half the bits' cosine. What
    f must be at least, as no cosine is above 1, is known; from there on f lies under its chord up to r = 1/2. So a weighted
    sum of the bits' cosine and the vectors' is a bound of the score, and one product of matrices gives it for a tile.
    Pairs of one label, which need less, are looked at by label.
    """
    w = WEIGHTS["hybrid"]
    bounded = len(lengths := x.even() | y.even()) < 2 and -1 not in lengths
    width = x.v.shape[1]
    left = x.directions() if bounded else None
    right = left if alone else y.directions() if bounded else None

    def tile_pairs(rows: np.ndarray, others: np.ndarray, base: float, weight: float, same: bool):
        low = min(max((least - base - w["embedding"]) / weight, 0.0), 0.999)
        r = low / (1 + low)
        slope = (1 - low) / (0.5 - r)
        need = least - base - weight * (low - slope * r) - 1e-4  # room for 32-bit products
        scale = np.repeat([weight * slope, w["embedding"]], width).astype(np.float32)
        for i in range(0, len(rows), block):
            a = rows[i : i + block]
            mine = left[a] * scale if bounded else None
            for j in range(i if alone else 0, len(others), block):
                b = others[j : j + block]
                over = mine @ right[b].T >= need if bounded else np.ones((len(a), len(b)), bool)
                if same:  # rows without a vector meet by label only
                    over |= (x.size[a] < 0)[:, None] | (y.size[b] < 0)[None]
                found = np.flatnonzero(over)
                k, m = a[found // len(b)], b[found % len(b)]
                kept = ((x.label[k] == y.label[m]) & (x.label[k] >= 0)) == same
                if alone and i == j:
                    kept &= x.id[k] < y.id[m]
                yield k[kept], m[kept]

    yield from tile_pairs(np.arange(len(x.id)), np.arange(len(y.id)), 0.0, 1.0 - w["embedding"], False)
    order = [np.argsort(s.label, kind="stable") for s in (x, y)]
    for label in np.intersect1d(x.label, y.label):
        if label >= 0:
            of = [o[slice(*np.searchsorted(s.label[o], [label, label + 1]))] for s, o in zip((x, y), order, strict=True)]
            yield from tile_pairs(*of, w["semantic"] * 0.95, 1.0 - w["semantic"] - w["embedding"], True)


def tiles(p: int, q: int, x: pa.StructArray, y: pa.StructArray, block: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Two packs in tiles of at most `block` rows a side: ids, ids, score, to be paired."""
    left, right = Side.both(x, y)
    for i in range(0, len(x), block):
        for j in range(i if p == q else 0, len(y), block):
            a, b = slice(i, i + block), slice(j, j + block)
            norm = left.norm[a, None] * right.norm[None, b]
            shared = left.bits[a].astype(float) @ right.bits[b].astype(float).T
            *_, score = parts(left, right, (a, None), (None, b), shared, left.v[a] @ right.v[b].T, norm)
            ids, others = left.id[a], right.id[b]
            yield ids, others, score, (ids[:, None] < others[None]) if p == q and i == j else (ids[:, None] != others[None])


def parts(x: Side, y: Side, i, j, shared: np.ndarray, product: np.ndarray, norm: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of rows i of x and j of y: cosine, common sign bits, equal labels, both vectors known, score."""
    w = WEIGHTS["hybrid"]
    emb = np.where((norm > 0) & (x.size[i] == y.size[j]), np.round(np.clip(product / np.where(norm > 0, norm, 1), -1, 1), 9), 0)
    fp = np.round(shared / np.maximum(x.count[i] + y.count[j] - shared, 1), 9)
    same = (x.label[i] == y.label[j]) & (x.label[i] >= 0)
    both = (x.size[i] >= 0) & (y.size[j] >= 0)
    # term by term as in `scored`, so that both round alike
    plain = same * w["semantic"] * 0.95 + w["fingerprint"] * fp + w["embedding"] * emb
    score = plain + (1.0 - (same * w["semantic"] + w["fingerprint"] + w["embedding"])) * fp
    return emb, fp, same, both, np.where(both, score, np.where(same, 0.95, -np.inf))


def exact_parts(x: Side, y: Side, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, ...]:
    """`parts` of the pairs of rows i of x and j of y."""
    shared = (x.bits[i] & y.bits[j]).sum(1)
    return parts(x, y, i, j, shared, np.einsum("ij,ij->i", x.v[i], y.v[j]), x.norm[i] * y.norm[j])


def all_parts(rows: DataFrame, key: str, vector: str, label: str, least: float, block: int = 1024) -> DataFrame:
    """Pairs (a, b), each once, with their components of all rows, however far apart, whose "hybrid" score is `least` or more.

    Classes of equal rows are packed; in each pair of packs all pairs pass a bound, a product of 32-bit matrices by tiles of
    `block` rows, and those it leaves are scored exactly, so a task holds two packs and a tile. Only pairs that reach
    `least` leave it. Null vectors meet by label only.
    """
    pairs, within = packed_classes(rows, key, vector, label, block, max(block, LARGE))
    names = [f.split()[0] for f in PARTS.split(", ")]

    def product(batches):
        for batch in batches:
            for p, q, x_rows, y_rows in zip(*batch.columns, strict=True):
                alone = p.as_py() == q.as_py()
                x, y = Side.both(x_rows.values, y_rows.values)
                for found in candidates(x, y, alone, least - 1e-6, block):
                    for at in range(0, len(found[0]), LARGE):
                        i, j = (c[at : at + LARGE] for c in found)
                        emb, fp, same, both, score = exact_parts(x, y, i, j)
                        k = np.flatnonzero(score >= least - 1e-6)
                        known = lambda value, has: pa.array(value[k], mask=~has[k])
                        made = [known(np.full(len(i), 0.95), same), known(fp, both), pa.nulls(len(k), pa.float64()), known(emb, both)]
                        a, b = x.id[i[k]], y.id[j[k]]
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), *made], names)

    return pairs.mapInArrow(product, PARTS).unionByName(within)


def similar_edges(rows: DataFrame, key: str, vector: str, label: str, least: float = CANDIDATE, block: int = 1024) -> DataFrame:
    """The hybrid edges of score `least` or more among all pairs of classes of equal rows, and from a class to its copies."""
    return scored(all_parts(rows, key, vector, label, least, block)).where(F.col("score") >= least)


def millionths(score: np.ndarray) -> np.ndarray:
    """Scores to 6 places, halves up as Spark rounds them, as whole millionths."""
    near = np.floor(score * 1e6 + 0.5)
    at = np.nonzero(np.abs(score * 1e6 - np.floor(score * 1e6) - 0.5) < 1e-6)
    near[at] = [int(Decimal(repr(x)).scaleb(6).quantize(Decimal(1), ROUND_HALF_UP)) for x in score[at].tolist()]
    return near.astype(np.int64)


#: Tasks for each part of a pack's pairs where there are more than 16 packs, so that few parts share a task.
SPREAD = 4
#: Rows whose best edges tell the least score of a pass, the share of them that may go without an edge, and millionths below any score.
PROBES, FEW, NONE = 1024, 1 / 64, -(10**9)
EDGES = "a bigint, b bigint, w double, x bigint, y bigint"


def rough_tiles(x: Side, y: Side, block: int) -> Iterator[tuple[slice, slice, np.ndarray]]:
    """Scores of all rows of x and y in tiles of at most `block` rows a side, from 32-bit products: some 1e-5 off; not for rows that are not even()."""
    w = WEIGHTS["hybrid"]
    one, two = ((s.bits.astype(np.float32), (s.v / np.where(s.norm > 0, s.norm, 1)[:, None]).astype(np.float32), s.count.astype(np.float32)) for s in (x, y))
    for i in range(0, len(x.id), block):
        for j in range(0, len(y.id), block):
            a, b = slice(i, i + block), slice(j, j + block)
            shared = one[0][a] @ two[0][b].T
            fp = shared / np.maximum(one[2][a, None] + two[2][None, b] - shared, np.float32(1))
            same = (x.label[a, None] == y.label[None, b]) & (x.label[a, None] >= 0)
            score = np.float32(1 - w["embedding"]) * fp + one[1][a] @ (np.float32(w["embedding"]) * two[1][b]).T
            yield a, b, np.where(same, score + np.float32(w["semantic"]) * (np.float32(0.95) - fp), score)


def best_scores(probe: DataFrame, packed: list[DataFrame], block: int) -> list[int]:
    """Of the rows of one pack `probe`, the millionths (or a few less) of the best edge of each that has one to another component among the packs' rows, in order."""

    def best(batches):
        for batch in batches:
            for _, rows, mine in zip(*batch.columns, strict=True):
                top = np.full(len(mine.values), -np.inf)
                at_x, at_y = (np.asarray(r.values.field("x"), np.int64) for r in (mine, rows))
                x, y = Side.both(mine.values, rows.values)
                if len(lengths := x.even() | y.even()) < 2 and -1 not in lengths:
                    found = rough_tiles(x, y, block)
                else:
                    places = ((slice(i, i + block), slice(j, j + block)) for i in range(0, len(at_x), block) for j in range(0, len(at_y), block))
                    found = ((a, b, t[2]) for (a, b), t in zip(places, tiles(0, 1, mine.values, rows.values, block), strict=True))
                for a, b, score in found:
                    usable = (at_x[a, None] != at_y[None, b]) & (score > -np.inf)
                    top[a] = np.maximum(top[a], np.where(usable, score, -np.inf).max(1))
                some = np.flatnonzero(top > -np.inf)
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(np.floor(top[some] * 1e6).astype(np.int64) - 50)], ["i", "w"])

    all_packs = packed[0] if len(packed) == 1 else packed[0].union(packed[1])
    pairs = all_packs.crossJoin(F.broadcast(probe.select(F.col("p_rows").alias("mine"))))
    return sorted(r["w"] for r in pairs.mapInArrow(best, "i bigint, w bigint").groupBy("i").agg(F.max("w").alias("w")).collect())


def edges_of(pairs: DataFrame, least: int, block: int) -> DataFrame:
    """Edges (a, b, w, x, y) of `least` millionths or more between rows of two components x and y; of each pair of packs, only its forest of them."""

    def forests(batches):
        for batch in batches:
            for p, q, x_rows, y_rows in zip(*batch.columns, strict=True):
                alone = p.as_py() == q.as_py()
                x, y = Side.both(x_rows.values, y_rows.values)
                at_x, at_y = (np.asarray(r.values.field("x"), np.int64) for r in (x_rows, y_rows))
                held = [np.zeros((5, 0), np.int64)]
                size = bound = 0

                def forest():
                    a, b, w, u, v = edges = np.concatenate(held, axis=1)  # noqa: B023
                    return edges[:, np.sort(forest_places(a, b, w, u, v))]

                for found in candidates(x, y, alone, least / 1e6 - 2e-6, block):
                    apart = at_x[found[0]] != at_y[found[1]]
                    i_all, j_all = (c[apart] for c in found)
                    for at in range(0, len(i_all), LARGE):
                        i, j = i_all[at : at + LARGE], j_all[at : at + LARGE]
                        *_, score = exact_parts(x, y, i, j)
                        usable = np.flatnonzero(score > -np.inf)
                        w = millionths(score[usable])
                        k = usable[w >= least]
                        a, b = x.id[i[k]], y.id[j[k]]
                        held.append(np.stack([np.minimum(a, b), np.maximum(a, b), w[w >= least], at_x[i[k]], at_y[j[k]]]))
                        size += len(k)
                    if size > bound + 16 * LARGE:
                        held = [forest()]
                        size = bound = held[0].shape[1]
                made = forest()
                yield pa.RecordBatch.from_arrays([pa.array(c / 1e6 if n == 2 else c) for n, c in enumerate(made)], ["a", "b", "w", "x", "y"])

    return pairs.mapInArrow(forests, EDGES)


def forest_edges(rows: DataFrame, key: str, vector: str, label: str, block: int = 1024) -> DataFrame:
    """Edges (a, b, w) of the maximum spanning forest of all pairs of rows, whatever their score, ties by smaller (a, b).

    Passes go down the scores. Each looks at every pair of two components that could reach a least score, by the bound of
    `candidates`, and settles the forest of all edges from there up to the last pass's least score. Rows of the largest
    component need not meet each other any more, so after the first pass few rows are left that meet all. What the least score
    is changes time, not results: it is such that of `PROBES` rows only few lack an edge. Copies, and rows without a vector (which
    meet those of their label), have edges by themselves.
    """
    classes, within = folded(rows, key, vector, label)
    known = classes.where("v is not null")
    bare = classes.where("v is null").select(F.col("id").alias("c"), "l")
    met = bare.join(known.select("id", "l"), "l").select(F.least("c", "id").alias("a"), F.greatest("c", "id").alias("b"), F.lit(0.95).alias("w")).where("a <> b")
    ends = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    extra = stash(scored(within).select(*ends, F.col("score").alias("w")).union(met), "copies")
    at = stash(classes.select("id").union(extra.select("a")).union(extra.select("b")).distinct().withColumn("x", F.col("id")), "at")
    number, chosen, last = known.count(), None, None

    def settle(edges: DataFrame) -> DataFrame:
        nonlocal chosen, at
        took = stash(settled(edges), "chosen")
        chosen = took if chosen is None else chosen.union(took)
        into = stash(merged(stash(placed(took).select(F.col("x").alias("a"), F.col("y").alias("b")), "ends")).select(F.col("node").alias("x"), F.col("component").alias("c")), "into")
        before, at = at, stash(at.join(into, "x", "left").select("id", F.coalesce("c", "x").alias("x")), "at")
        drop(before)
        return at

    def placed(edges: DataFrame) -> DataFrame:
        one, two = at.select(F.col("id").alias("a"), "x"), at.select(F.col("id").alias("b"), F.col("x").alias("y"))
        return edges.join(one, "a").join(two, "b").select("a", "b", "w", "x", "y")

    while number > 1:
        items = known.join(at, "id")
        most = None if chosen is None else items.groupBy("x").count().orderBy(F.desc("count"), "x").first()
        inside = most["count"] if most else 0
        if number == inside:
            break
        parts_of = [(items, number)] if not most else [(items.where(F.col("x") != most["x"]), number - inside), (items.where(F.col("x") == most["x"]), inside)]
        packed = [packs(some, size, block, max(block, LARGE)) for some, size in parts_of]
        probe = parts_of[0][0].orderBy(F.xxhash64("id"), "id").limit(PROBES).agg(F.collect_list(F.struct("id", "l", "v", "x")).alias("p_rows"))
        best = best_scores(probe, [p for p, _ in packed], block)
        least = best[int(len(best) * FEW) if number - inside > PROBES else 0] if best else NONE
        pairs = ring(*packed[0], SPREAD if packed[0][1] > 16 else 1)
        if most:
            (few, _), (rest, n) = packed
            spread = few.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select("p", "p_rows", "q", (F.col("p") % SHARES).alias("share"))
            pairs = pairs.union(dealt(spread, rest, n).select((-1 - F.col("p")).alias("p"), "q", "p_rows", "q_rows"))
        found = stash(edges_of(pairs, least, block), "found")
        drop(*(p for p, _ in packed))
        more = extra.where(F.round(F.col("w") * 1e6) >= least)
        settle(found.union(placed(more if last is None else more.where(F.round(F.col("w") * 1e6) < last))))
        drop(found)
        last = least
        if not best:
            break
    rest = extra if last is None else extra.where(F.round(F.col("w") * 1e6) < last)
    if not rest.isEmpty():
        settle(placed(rest))
    return chosen if chosen is not None else extra.select("a", "b", "w")
