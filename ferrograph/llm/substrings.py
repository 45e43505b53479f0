"""Exact repeated substrings across a corpus (operator 3).

A byte goes if a string of `size` bytes that covers it also starts earlier. A full suffix order of the corpus would need
a row for each byte at every level of naming, many times the input; names are recursed on here as in difference-cover
sorting, but places are sampled by content and only what a level leaves open reaches the next one:

1. the sample: each string of `size` bytes names the place of its least gram of 32 bytes, so equal strings name equal
   grams. The strings that name one place are a stretch. A gram that occurs once in the corpus settles its stretch.
2. names of stretches: stretches whose bytes are equal share a name. All but the first stretch of a name go. If a
   gram has one name only, that settles it.
3. recursion: the first stretches of the names that share a gram are cut out, and 1 and 2 are done on them again with
   grams of 80 bytes, which nearly all strings that differ do not share.
4. names of strings: what is still open is named string by string, and equal names are compared by place: all but
   the first go.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import blocks, drop, stash

U = np.uint64
#: Bytes of the grams of each level.
GRAMS = (32, 80)
#: Odd multipliers of the two rolling hashes, and the mixing constants.
BASES, MIX = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93), (U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB))
PLACES = 32  # low bits of a choice that hold the place


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * MIX[0]
    x = (x ^ (x >> U(27))) * MIX[1]
    return x ^ (x >> U(31))


@cache
def powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo 2**64, n + 1 of each."""
    found = []
    for base in (BASES[which], pow(BASES[which], -1, 1 << 64)):
        p = np.full(n + 1, base, U)
        p[0] = 1
        found.append(np.multiply.accumulate(p))
    return found[0], found[1]


class Rolling:
    """Hashes of any substring of data, by prefix sums."""

    def __init__(self, data: np.ndarray, which: int):
        size = 1 << max(16, int(len(data)).bit_length())
        up, self.down = powers(size, which)
        self.sums = np.zeros(len(data) + 1, U)
        np.cumsum((data.astype(U) + U(1)) * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start])


def joined(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts (or bytes) in a row, and where each begins and ends."""
    raw = [t.encode() if isinstance(t, str) else t for t in texts]
    ends = np.cumsum([len(b) for b in raw], dtype=np.int64)
    return np.frombuffer(b"".join(raw), np.uint8), ends - [len(b) for b in raw], ends


def stretches(texts: list, size: int, gram: int) -> tuple[np.ndarray, ...]:
    """For each stretch: text, first string's place, number of strings, gram's hash, and the hash of the bytes."""
    data, starts, ends = joined(texts)
    if len(data) < size:
        return (np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64))
    roll, n = Rolling(data, 0), len(data)
    grams = mixed((roll.sums[gram:] - roll.sums[:-gram]) * roll.down[: n - gram + 1])
    least = (grams & ~U((1 << PLACES) - 1)) | np.arange(len(grams), dtype=U)
    width, have = size - gram + 1, 1
    while have * 2 <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < width:
        least = np.minimum(least[: len(least) - (width - have)], least[width - have :])
    named = (least & U((1 << PLACES) - 1)).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), ends - starts)[: len(named)]
    at = np.flatnonzero(np.arange(len(named)) + size <= ends[owner])
    owner, named = owner[at], named[at]
    begins = np.flatnonzero(np.concatenate([[True], (named[1:] != named[:-1]) | (owner[1:] != owner[:-1])])) if len(at) else np.zeros(0, int)
    last = np.append(begins[1:], len(at))[: len(begins)] - 1
    first, final, owner = at[begins], at[last], owner[begins]
    count = final - first + 1
    bytes_of = Rolling(data, 1).of(first, final + size) + mixed(count.astype(U))
    return owner, (first - starts[owner]).astype(np.int32), count.astype(np.int32), grams[named[begins]].view(np.int64), bytes_of.view(np.int64)


def settle(source: DataFrame, size: int, gram: int, level: str) -> tuple[DataFrame, DataFrame]:
    """One level over source (id, base, t): strings (id, p, n) that start earlier, and those (id, p, n) still open."""

    def sampled(batches):
        for _, texts in blocks(batches, 2):
            grams, counts = np.unique(stretches(texts, size, gram)[3], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(counts)], ["f", "c"])

    def cut(batches):
        for batch, texts in blocks(batches, 2):
            owner, first, count, grams, name = stretches(texts, size, gram)
            place = np.asarray(batch.column(1))[owner] + first
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), pa.array(place.astype(np.int32)), pa.array(count), pa.array(grams), pa.array(name)], ["id", "p", "n", "f", "h"])

    common = source.mapInArrow(sampled, "f bigint, c bigint").groupBy("f").agg(F.sum("c").alias("c")).where("c > 1").select("f")
    common = stash(common, f"grams-{level}")
    met = stash(source.mapInArrow(cut, "id bigint, p int, n int, f bigint, h bigint").join(common, "f", "left_semi"), f"stretches-{level}")
    names = stash(met.groupBy("f", "h").agg(F.min(F.struct("id", "p", "n")).alias("first"), F.count("*").alias("c")), f"names-{level}")
    later = met.join(names.where("c > 1").select("f", "h", "first"), ["f", "h"]).where("id > first.id or id = first.id and p > first.p").select("id", "p", "n")
    several = names.groupBy("f").agg(F.count("*").alias("c")).where("c > 1").select("f")
    found = stash(later, f"later-{level}"), stash(names.join(several, "f", "left_semi").select("first.*"), f"open-{level}")
    drop(common, met, names)
    return found


def of_pieces(source: DataFrame, pieces: DataFrame, size: int, schema: str, made) -> DataFrame:
    """made(ids, bases, starts in data, places, counts, data) for the pieces (id, p, n) that lie in the rows of source."""
    listed = pieces.groupBy("id").agg(F.collect_list(F.struct("p", "n")).alias("pieces"))

    def run(batches):
        for batch, texts in blocks(batches, 2):
            data, starts, ends = joined(texts)
            ids, bases, of = np.asarray(batch.column(0)), np.asarray(batch.column(1)), batch.column(3)
            flat = of.flatten()
            row = np.repeat(np.arange(len(texts)), np.asarray(of.value_lengths()))
            p, n = (np.asarray(flat.field(k), np.int64) for k in (0, 1))
            start = starts[row] + p - bases[row]
            inside = (p >= bases[row]) & (start + n + size - 1 <= ends[row])
            yield made(ids[row[inside]], start[inside], p[inside], n[inside], data)

    return source.join(listed.hint("merge"), "id").select("id", "base", "t", "pieces").mapInArrow(run, schema)


def repeated_substrings(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 100) -> DataFrame:
    """Per document: key, n_bytes, n_removed, n_spans, kept_sha256 (of the bytes that stay, joined), spans.

    Texts are UTF-8 bytes, null is empty; no string crosses documents; "earlier" is a smaller key, or the same document
    and an earlier start, judged on the input as it stands. `spans` lists start and end of each removed run in turn.
    Keys must be whole numbers; rows of one key are compared at equal places as one document (an equal row is no
    earlier copy of itself); a null key takes no part. Other columns are ignored. `size` is at least 80.

    Names are pairs of 64-bit hashes (a stretch's and its gram's, or a string's two). No group of equal names is ever gathered: first
    places are partial minima, and the rows are joined back with them, a join that Spark splits where a name is hot.
    """
    source = docs.select(F.col(key).cast("bigint").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    live = source.where("id is not null").select("id", F.lit(0).alias("base"), "t")

    def sliced(ids, start, p, n, data):
        bytes_of = [data[a:b].tobytes() for a, b in zip(start.tolist(), (start + n + size - 1).tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(p.astype(np.int32)), pa.array(bytes_of, pa.binary())], ["id", "base", "t"])

    def strings(ids, start, p, n, data):
        each, step = np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        begin = start[each] + step
        names = [Rolling(data, k).of(begin, begin + size).view(np.int64) if len(each) else np.zeros(0, np.int64) for k in (0, 1)]
        return pa.RecordBatch.from_arrays([pa.array(ids[each]), pa.array((p[each] + step).astype(np.int32)), *map(pa.array, names)], ["id", "p", "g", "h"])

    later, open_ = settle(live, size, GRAMS[0], "1")
    cuts = stash(of_pieces(live, open_, size, "id bigint, base int, t binary", sliced), "cuts")
    more, open_ = settle(cuts, size, GRAMS[1], "2")
    single = stash(of_pieces(cuts, open_, size, "id bigint, p int, g bigint, h bigint", strings).distinct(), "strings")
    firsts = single.groupBy("g", "h").agg(F.min(F.struct("id", "p")).alias("first"), F.count("*").alias("c")).where("c > 1")
    again = single.join(firsts, ["g", "h"]).where("id > first.id or id = first.id and p > first.p").select("id", "p", F.lit(1).alias("n"))
    gone = stash(later.union(more).union(again).groupBy("id").agg(F.collect_list(F.struct("p", "n")).alias("gone")), "gone")
    drop(later, more, open_, cuts, single)

    def removed(batches):
        for batch, texts in blocks(batches, 1):
            out: list[list] = [[] for _ in range(5)]
            for t, runs in zip(texts, batch.column(2), strict=True):
                raw, spans = t.encode(), []
                if runs.is_valid:
                    flat = runs.values
                    p, n = (np.asarray(flat.field(k), np.int64) for k in (0, 1))
                    order = np.argsort(p, kind="stable")
                    p, e = p[order], np.maximum.accumulate((p + n + size - 1)[order])
                    breaks = np.flatnonzero(p[1:] > e[:-1])
                    spans = np.stack([p[np.concatenate([[0], breaks + 1])], e[np.append(breaks, len(p) - 1)]], 1).reshape(-1).tolist()
                edges = [0, *spans, len(raw)]
                kept = b"".join(raw[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))
                for column, value in zip(out, (len(raw), len(raw) - len(kept), len(spans) // 2, hashlib.sha256(kept).hexdigest(), spans), strict=True):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], [key, "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    whole = source.join(gone.hint("merge"), "id", "left").select("id", "t", "gone")
    return whole.mapInArrow(removed, f"`{key}` bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<bigint>")
