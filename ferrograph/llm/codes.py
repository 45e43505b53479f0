"""Compression of vectors to product codes by heap Lloyd (operator 11).

A vector is cut into equal consecutive parts, and each part position has a codebook of its own. Vectors travel in blocks;
a block holds, for each position and entry, a heap of the parts assigned to it. A part's key is its slack, the lower
bound of its distance to any other entry minus the upper bound of that to its own, raised by the entry's drift so far. When
entries move, only the entry's cumulative drift grows; parts whose key it has reached are popped and compared with all
entries again, exactly, and no other part is touched. Blocks are written after each round, so a lost executor costs
tasks, and entries are updated from partial sums.
"""

from __future__ import annotations

import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop, stash

#: Components of vectors that one block holds at most (a longer vector is a block by itself).
BLOCK_COMPONENTS = 1 << 18
#: What bounds are widened by, relative to themselves, so that rounding never hides a violation.
WIDE = 1e-12


class Codebooks:
    """Entries (positions, entries, width) of one round, and each entry's cumulative drift."""

    def __init__(self, entries: np.ndarray, drift: np.ndarray | None = None):
        self.entries = entries
        self.drift = np.zeros(entries.shape[:2]) if drift is None else drift

    def moved(self, sums: np.ndarray, counts: np.ndarray) -> Codebooks:
        """The entries at their parts' floored means; unused ones stay. An entry's drift grows by its own way and the longest of the others."""
        used = counts > 0
        now = np.where(used[:, :, None], sums // np.maximum(counts, 1)[:, :, None], self.entries)
        way = np.sqrt(((now - self.entries).astype(np.float64) ** 2).sum(2)) * (1 + WIDE)
        if way.shape[1] > 1:
            longest = np.sort(way, axis=1)
            others = np.where((way == longest[:, -1:]) & (np.cumsum(way == longest[:, -1:], 1) == 1), longest[:, -2:-1], longest[:, -1:])
        else:
            others = np.zeros_like(way)
        return Codebooks(now, self.drift + way + others)


def square_distances(parts: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of all parts (n, width) to all entries (k, width): by products of doubles where these hold them, else by integers."""
    most = max(int(np.abs(parts).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * most * most * max(1, parts.shape[1]) < 1 << 53:
        x, y = parts.astype(np.float64), entries.astype(np.float64)
        return ((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * (x @ y.T)).astype(np.int64)
    found = np.zeros((len(parts), len(entries)), np.int64)
    for c in range(parts.shape[1]):
        found += (parts[:, c, None] - entries[None, :, c]) ** 2
    return found


class Heaps:
    """One position's heaps in a block: for each entry the keys and parts in heap order, one entry after another."""

    def __init__(self, sizes: np.ndarray, keys: np.ndarray, which: np.ndarray):
        self.sizes, self.keys, self.which = sizes, keys, which

    def settle(self, parts: np.ndarray, entries: np.ndarray, drift: np.ndarray, codes: np.ndarray) -> tuple[Heaps, int]:
        """Pop what the drift has violated, compare it with all entries, push it where it belongs; codes change in place. Also how many were popped."""
        ends = np.cumsum(self.sizes)
        heaps: dict[int, list] = {}
        popped: list[int] = []
        for e in np.flatnonzero(self.sizes):
            a, b = ends[e] - self.sizes[e], ends[e]
            if self.keys[a] <= drift[e]:  # else the whole heap is left as it is
                heap = list(zip(self.keys[a:b].tolist(), self.which[a:b].tolist(), strict=True))
                while heap and heap[0][0] <= drift[e]:
                    popped.append(heapq.heappop(heap)[1])
                heaps[e] = heap
        if not popped:
            return self, 0
        again = np.array(popped)
        slack = self.scanned(parts, entries, codes, again)
        for i, e, s in zip(popped, codes[again].tolist(), slack.tolist(), strict=True):
            if e not in heaps:
                a, b = ends[e] - self.sizes[e], ends[e]
                heaps[e] = list(zip(self.keys[a:b].tolist(), self.which[a:b].tolist(), strict=True))
            heapq.heappush(heaps[e], (s + drift[e], i))
        sizes, keys, which = self.sizes.copy(), [], []
        for e in range(len(sizes)):
            if e in heaps:
                sizes[e] = len(heaps[e])
                keys.append(np.array([k for k, _ in heaps[e]], np.float64))
                which.append(np.array([i for _, i in heaps[e]], np.int32))
            else:
                keys.append(self.keys[ends[e] - self.sizes[e] : ends[e]])
                which.append(self.which[ends[e] - self.sizes[e] : ends[e]])
        return Heaps(sizes, np.concatenate(keys), np.concatenate(which)), len(popped)

    @staticmethod
    def scanned(parts: np.ndarray, entries: np.ndarray, codes: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Assign the parts `which` to their nearest entries (ties: the lower index); their slack."""
        square = square_distances(parts[which], entries)
        codes[which] = nearest = square.argmin(1)
        rows = np.arange(len(which))
        upper = np.sqrt(square[rows, nearest].astype(np.float64))
        if len(entries) == 1:
            return np.full(len(which), np.inf)
        square[rows, nearest] = np.iinfo(np.int64).max
        return np.sqrt(square.min(1).astype(np.float64)) * (1 - WIDE) - upper * (1 + WIDE)

    @staticmethod
    def of(parts: np.ndarray, entries: np.ndarray, drift: np.ndarray, codes: np.ndarray) -> Heaps:
        """The first assignment of all parts. A rising run of keys is a heap."""
        slack = Heaps.scanned(parts, entries, codes, np.arange(len(parts)))
        keys = slack + drift[codes]
        by = np.lexsort((keys, codes))
        return Heaps(np.bincount(codes, minlength=len(entries)).astype(np.int32), keys[by], by.astype(np.int32))


def bound_of(width: int, positions: int) -> int:
    """The greatest magnitude of a component with which a vector's squared distance fits a 64-bit integer."""
    return int((((1 << 63) - 1) / (4 * max(1, width) * positions)) ** 0.5)


def whole_numbers(lists: pa.Array, length: int, scale: int, most: int) -> np.ndarray:
    """floor(scale * x) of each component, (rows, length); shorter vectors end in zeros, magnitudes stop at `most`."""
    sizes = np.asarray(lists.value_lengths().fill_null(0), np.int64)
    flat = np.floor(np.asarray(lists.flatten(), np.float64) * scale).clip(-most, most).astype(np.int64)
    if (sizes == length).all():
        return flat.reshape(len(sizes), length)
    out = np.zeros((len(sizes), length), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def least_type(values: np.ndarray) -> np.ndarray:
    """values in the smallest integer type that holds them."""
    for kind in (np.int8, np.int16, np.int32):
        if len(values) == 0 or (np.iinfo(kind).min <= values.min() and values.max() <= np.iinfo(kind).max):
            return values.astype(kind)
    return values


STATE = "vectors binary, width tinyint, codes binary, sizes binary, keys binary, which binary, sums binary, counts binary, popped bigint"


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", positions: int = 16, entries: int = 64, scale: int = 256, rounds: int = 2) -> DataFrame:
    """Per kept row: key, code (two hex digits a position), error, label_error (error summed over equal labels, nulls together), codebooks_sha256.

    Rows whose vector is null or holds a null or non-finite component are dropped. Components become floor(scale * x). A
    codebook starts as that part of the rows of the `entries` smallest keys (null keys come last; of rows with one key the
    least vector starts an entry, and each row gets its code); with fewer keys it has fewer entries. If lengths differ or
    are no multiple of `positions`, shorter vectors are filled up with zeros. Components so large that a squared distance
    would not fit a long (beyond 2**27 for parts of four) stop there. An empty table gives no rows. Columns other than
    key, vector and label are ignored.

    No vector is shuffled: a round reads the written blocks, works on them where they lie and writes them again. The driver
    gets the codebooks and one sum an entry and component, whatever the number of vectors.
    """
    wrong = F.exists(F.col(vector), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = vectors.where(F.col(vector).isNotNull() & ~wrong).select(F.col(key).cast("bigint").alias("id"), F.col(vector).alias("v"), F.col(label).alias("label"))
    length = kept.agg(F.max(F.size("v"))).first()[0]
    if length is None:
        return kept.where("false").select(F.col("id").alias(key), F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error"), F.lit(0).cast("bigint").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    width = -(-length // positions)
    length, most = width * positions, bound_of(width, positions)
    firsts = [r["id"] for r in kept.select("id").distinct().orderBy(F.col("id").asc_nulls_last()).limit(entries).collect()]
    wanted = F.col("id").isin([i for i in firsts if i is not None])
    if None in firsts:
        wanted = wanted | F.col("id").isNull()
    starts = kept.where(wanted).groupBy("id").agg(F.min("v").alias("v")).toArrow()
    order = sorted(range(starts.num_rows), key=lambda i: (starts["id"][i].as_py() is None, starts["id"][i].as_py() or 0))
    first = whole_numbers(starts["v"].combine_chunks(), length, scale, most)[order]
    books = Codebooks(np.ascontiguousarray(first.reshape(len(first), positions, width).transpose(1, 0, 2)))
    a_block = max(1, BLOCK_COMPONENTS // max(1, length))
    kind = kept.schema["label"].dataType.simpleString()

    def row(ids, labels, x, codes, heaps, popped):
        """One block as a row of the state, with its sums and counts by position and entry."""
        k = heaps[0].sizes.size
        sums, counts = np.zeros((positions, k, width), np.int64), np.zeros((positions, k), np.int64)
        for p in range(positions):
            np.add.at(sums[p], codes[p], x[:, p * width : (p + 1) * width])
            counts[p] = np.bincount(codes[p], minlength=k)
        small = least_type(x)
        cells = [small.tobytes(), small.itemsize, codes.astype(np.uint8).tobytes(), *(np.concatenate([getattr(h, f) for h in heaps]).tobytes() for f in ("sizes", "keys", "which")), sums.tobytes(), counts.tobytes(), popped]
        arrays = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in (ids, labels)]
        names = ["ids", "labels", *(f.split()[0] for f in STATE.split(", "))]
        types = [None, None, pa.binary(), pa.int8(), *[pa.binary()] * 6, pa.int64()]
        return pa.RecordBatch.from_arrays([*arrays, *(pa.array([c], t) for c, t in zip(cells, types[2:], strict=True))], names)

    def begun(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, a_block):
                part = batch.slice(at, a_block)
                x = whole_numbers(part.column(1), length, scale, most)
                codes = np.zeros((positions, len(x)), np.int64)
                heaps = [Heaps.of(x[:, p * width : (p + 1) * width], books.entries[p], books.drift[p], codes[p]) for p in range(positions)]
                yield row(part.column(0), part.column(2), x, codes, heaps, positions * len(x))

    def settled(batches, now: Codebooks):
        """Each block's ids, labels, components, codes and heaps after what `now` has violated was assigned again."""
        k = now.entries.shape[1]
        for batch in batches:
            for i in range(batch.num_rows):
                ids, labels = batch.column(0)[i].values, batch.column(1)[i].values
                raw = [batch.column(c)[i].as_py() for c in range(2, batch.num_columns)]
                x = np.frombuffer(raw[0], f"i{raw[1]}").astype(np.int64).reshape(len(ids), length)
                codes = np.frombuffer(raw[2], np.uint8).reshape(positions, len(ids)).astype(np.int64)
                sizes, keys, which = np.frombuffer(raw[3], np.int32).reshape(positions, k), np.frombuffer(raw[4], np.float64).reshape(positions, -1), np.frombuffer(raw[5], np.int32).reshape(positions, -1)
                heaps, popped = [], 0
                for p in range(positions):
                    h, n = Heaps(sizes[p], keys[p], which[p]).settle(x[:, p * width : (p + 1) * width], now.entries[p], now.drift[p], codes[p])
                    heaps.append(h)
                    popped += n
                yield ids, labels, x, codes, heaps, popped

    def summed(state: DataFrame, books: Codebooks) -> Codebooks:
        """The codebooks after an update: blocks' sums are added up in each task, then by Spark, and come to the driver as one number a component."""
        shape = books.entries.shape

        def added(batches):
            total = np.zeros(shape[0] * shape[1] * (width + 1), np.int64)
            for batch in batches:
                for s, c in zip(batch.column(0), batch.column(1), strict=True):
                    total += np.concatenate([np.frombuffer(s.as_py(), np.int64), np.frombuffer(c.as_py(), np.int64)])
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["at", "n"])

        got = state.select("sums", "counts").mapInArrow(added, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
        total = np.zeros(shape[0] * shape[1] * (width + 1), np.int64)
        total[np.asarray(got["at"], np.int64)] = np.asarray(got["n"], np.int64)
        cut = shape[0] * shape[1] * width
        return books.moved(total[:cut].reshape(shape), total[cut:].reshape(shape[:2]))

    schema = f"ids array<bigint>, labels array<{kind}>, {STATE}"
    state = stash(kept.select("id", "v", "label").mapInArrow(begun, schema), "blocks")
    for n in range(rounds):
        books = summed(state, books)
        if n + 1 < rounds:

            def again(batches, now=books):
                for block in settled(batches, now):
                    yield row(*block)

            last, state = state, stash(state.mapInArrow(again, schema), "blocks")
            drop(last)

    def coded(batches, now=books):
        for ids, labels, x, codes, _, _ in settled(batches, now):
            own = np.concatenate([now.entries[p][codes[p]] for p in range(positions)], axis=1)
            error = ((x - own) ** 2).sum(1)
            names = [c.tobytes().hex() for c in codes.T.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([ids, labels, pa.array(names, pa.string()), pa.array(error, pa.int64())], ["id", "label", "code", "error"])

    found = stash(state.mapInArrow(coded, f"id bigint, label {kind}, code string, error bigint"), "codes")
    drop(state)
    sums = stash(found.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of"), "labelsums")
    name = hashlib.sha256(",".join(map(str, books.entries.ravel().tolist())).encode()).hexdigest()
    return found.join(sums, F.col("label").eqNullSafe(F.col("of"))).select(F.col("id").alias(key), "code", "error", "label_error", F.lit(name).alias("codebooks_sha256"))


def compress_sql(positions: int = 16, entries: int = 64, scale: int = 256, rounds: int = 2) -> str:
    """DuckDB's SQL for the query's rows (keys and lengths as in the supplied table: each key once, equal lengths)."""
    steps = []
    for n in range(rounds + 1):
        steps.append(f"""
a{n} as (select vec_id, p, x, min(d * {entries} + e) as best from (
    select q.vec_id, q.p, q.x, e.e, list_sum(list_transform(list_zip(q.x, e.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::hugeint as d
    from parts q join e{n} e using (p)) group by all),
e{n + 1} as (select p, e, coalesce(m.x, o.x) as x from e{n} o left join (
    select p, (best % {entries})::bigint as e, list(floor(s::double / n)::bigint order by k) as x
    from (select p, best, k, sum(x[k]) as s, count(*) as n from (select p, best % {entries} as best, x, unnest(range(1, len(x)::bigint + 1)) as k from a{n}) group by all)
    group by p, best) m using (p, e))""")
    return f"""
with kept as materialized (select vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::double)::bigint) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
parts as materialized (select vec_id, p, v[p * (len(v) // {positions}) + 1 : (p + 1) * (len(v) // {positions})] as x from kept, range({positions}) r(p)),
e0 as (select p, row_number() over (partition by p order by vec_id) - 1 as e, x from parts where vec_id in (select vec_id from kept order by vec_id limit {entries})),
{",".join(steps).replace(" as (select", " as materialized (select")},
coded as (select vec_id, string_agg(printf('%02x', (best % {entries})::bigint), '' order by p) as code, sum(best // {entries})::bigint as error from a{rounds} group by vec_id)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error,
  (select sha256(string_agg(array_to_string(x, ','), ',' order by p, e)) from e{rounds}) as codebooks_sha256
from coded join kept using (vec_id)
"""
