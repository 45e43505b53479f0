"""Near-duplicate groups by one-permutation MinHash (operator 6).

A document's shingles are dealt to bins by one hash; the least hash of each bin is its signature, and an empty bin
borrows from a bin that a universal hash names (optimal densification). Bands of bins name buckets. A bucket is not
paired out but made a star around its smallest document, and every candidate is confirmed on the full shingle sets.
Where a star's links leave a bucket in several components that may still be linked, its members are joined on the rarest
shingles of their full sets (of two similar sets, each holds one of the other's), again by stars, round after round with
more centres, until no shingle is left with members of two components. The connected components of all confirmed links
are the groups.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import blocks, components, drop, stash

#: 192 bins in 32 bands of 6: two sets of similarity 0.85 share no band in 3 of 10 million cases, 0.8 in 5 of 100,000.
BANDS, ROWS = 32, 6
BINS = BANDS * ROWS
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX[1]
    x = (x ^ (x >> np.uint64(27))) * MIX[2]
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words; forgets all when it holds many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


def shingle_sets(texts: list[str], size: int, hashes: WordHashes) -> list[np.ndarray]:
    """Each text's distinct shingles of `size` words as sorted 64-bit hashes; shorter texts are one shingle, empty ones none.

    A-Z are lower-cased and words end at ASCII white space, which is what bytes' own methods do.
    """
    found = []
    for t in texts:
        words = np.array([hashes[w] for w in t.encode().lower().split()], np.uint64)
        k = min(size, len(words))
        if k:
            total = np.full(len(words) - k + 1, k, np.uint64)
            for i in range(k):
                total = mixed(total * MIX[0] + words[i : len(words) - k + 1 + i])
            words = np.unique(total)
        found.append(words)
    return found


DENSIFY = mixed(np.arange(BINS * 64, dtype=np.uint64) * MIX[0] + np.uint64(5)).reshape(64, BINS) % np.uint64(BINS)


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """The bucket names (one a band) of a non-empty set."""
    h = mixed(shingles ^ MIX[2])
    bins = (h % np.uint64(BINS)).astype(np.int64)
    least = np.full(BINS, ~np.uint64(0))
    np.minimum.at(least, bins, h)
    filled = np.zeros(BINS, bool)
    filled[bins] = True
    if not filled.all():
        empty = np.flatnonzero(~filled)
        source, k = np.full(len(empty), -1), 0
        while (source < 0).any():
            named = DENSIFY[k % 64, (empty + k // 64) % BINS].astype(np.int64)
            source = np.where((source < 0) & filled[named], named, source)
            k += 1
        least[empty] = least[source]
    keys = np.arange(BANDS, dtype=np.uint64) + np.uint64(1)
    for row in least.reshape(BANDS, ROWS).T:
        keys = mixed(keys * MIX[0] + row)
    return keys.view(np.int64)


def shingled(docs: DataFrame, named: DataFrame, size: int, name: str) -> DataFrame:
    """(id, s) for the ids of `named`: the bytes of their sorted shingle hashes, from the documents (id, t)."""

    def sets(batches):
        hashes = WordHashes()
        for batch, texts in blocks(batches, 1):
            made = [s.tobytes() for s in shingle_sets(texts, size, hashes)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["id", "s"])

    return stash(docs.join(named.select("id").distinct().hint("merge"), "id", "left_semi").mapInArrow(sets, "id bigint, s binary").distinct(), name)


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b) with `shared` and `total` shingles of their full sets (id, s)."""
    one = pairs.join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")).hint("merge"), "b")
    both = one.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")).hint("merge"), "a").select("a", "b", "sa", "sb")

    def compared(batches):
        for batch in batches:
            shared, total = [], []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                n = len(np.intersect1d(x, y, assume_unique=True))
                shared.append(n)
                total.append(len(x) + len(y) - n)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shared, pa.int64()), pa.array(total, pa.int64())], ["a", "b", "shared", "total"])

    return both.mapInArrow(compared, "a bigint, b bigint, shared bigint, total bigint").distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """Per document: key, n_shingles, component_id, kept (key = component_id).

    Documents are linked if 100 * shared >= percent * all shingles of `size` words; component_id is the smallest key
    reachable. Null and empty texts have no shingles and no links; rows with equal keys are one node. Keys must be whole
    numbers (null keys: no links, kept). Other columns are ignored.

    Copies (equal sets) are folded into their smallest document first, with a partial minimum, so groups of copies of any
    size cost one node. Stars have one candidate edge a member and bucket. Links that stars cannot show are found by
    `rare_links`, so none is missed but those that share no band. What is joined to a bucket's rows is written first, so
    that Spark may split a hot bucket in the join.
    """
    source = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("t"))

    def signed(batches):
        hashes = WordHashes()
        for batch, texts in blocks(batches, 1):
            made = shingle_sets(texts, size, hashes)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(s) for s in made], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in made], pa.binary()),
                    pa.array([band_keys(s) if len(s) else None for s in made], pa.list_(pa.int64())),
                ],
                ["id", "n", "sig", "bands"],
            )

    signatures = stash(source.mapInArrow(signed, "id bigint, n bigint, sig binary, bands array<bigint>"), "signatures")
    alive = signatures.where("sig is not null and id is not null")
    folded = alive.groupBy("sig").agg(F.min("id").alias("rep"))
    heads = alive.join(folded, (alive["id"] == folded["rep"]) & (alive["sig"] == folded["sig"]), "left_semi").select("id", F.explode("bands").alias("bucket")).distinct()
    hubs = stash(heads.groupBy("bucket").agg(F.min("id").alias("hub"), F.count("*").alias("c")).where("c > 1").drop("c"), "hubs")
    spokes = stash(heads.join(hubs.hint("merge"), "bucket").where("id > hub"), "spokes")
    pairs = stash(spokes.select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct(), "pairs")
    sets = shingled(source, pairs.select(F.col("a").alias("id")).union(pairs.select("b")), size, "sets")
    judged = stash(confirmed(pairs, sets), "judged")
    links = judged.where(f"100 * shared >= {percent} * total").select("a", "b")
    first = stash(components(links, "stars"), "stars")
    members = open_members(spokes, judged, first, percent)
    links = stash(links.union(rare_links(members, sets, percent)), "links")
    drop(hubs, spokes, pairs, sets, judged, first, members)
    groups = components(links, "groups")
    # a document's representative, and that one's group
    group_of = folded.join(groups, folded["rep"] == groups["node"], "left").select("sig", F.coalesce("component", "rep").alias("g"))
    out = signatures.select("id", F.col("n").alias("n_shingles"), F.coalesce("sig", F.lit(b"")).alias("sig")).join(group_of, "sig", "left")
    component = F.coalesce("g", "id")
    return out.select(F.col("id").alias(key), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def open_members(spokes: DataFrame, judged: DataFrame, first: DataFrame, percent: int) -> DataFrame:
    """Documents (id, c: component so far) of buckets in which two members of different components may be linked.

    The centre is settled with all. By the triangle inequality of the Jaccard distance, a member linked to the centre can
    be linked to one that is not only if it is itself far enough from the centre.
    """
    reach = 1 - percent / 100
    far = F.lit(1.0) - F.col("shared") / F.col("total")
    seen = spokes.join(judged.select(F.col("a").alias("hub"), F.col("b").alias("id"), far.alias("far"), F.expr(f"100 * shared >= {percent} * total").alias("near")).hint("merge"), ["hub", "id"])
    seen = stash(seen.join(first.withColumnsRenamed({"node": "id", "component": "c"}).hint("merge"), "id", "left").withColumn("c", F.coalesce("c", "id")), "seen")
    least = stash(seen.groupBy("bucket").agg(F.min(F.when(~F.col("near"), F.col("far"))).alias("least")).where("least is not null"), "least")
    left = seen.join(least.hint("merge"), "bucket").where(~F.col("near") | (F.col("far") >= F.col("least") - reach - 1e-9)).select("bucket", "id", "c")
    left = stash(left, "left")
    several = stash(left.groupBy("bucket").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("bucket"), "several")
    members = stash(left.join(several.hint("merge"), "bucket", "left_semi").select("id", "c").distinct(), "open")
    drop(seen, least, left, several)
    return members


def early(percent: int) -> Column:
    """Whether a row (n, rest) of a bucket could be linked with one like itself.

    Rows (n, rest) and (m, more) may be linked only if (100 + percent) * rest and (100 + percent) * more are both
    percent * (n + m) or more; were neither row early, the first would need m < n and the second n < m.
    """
    return F.expr(f"{100 + percent} * rest >= {2 * percent} * n")


def early_centres(rows: DataFrame, percent: int, parts: int) -> DataFrame:
    """Centres (token, hub) of buckets of rows (token, id, c, n, rest): the early row of least id of each of `parts` parts by hash."""
    part = F.pmod(F.xxhash64("id"), F.lit(parts))
    return rows.where(early(percent)).groupBy("token", part).agg(F.min(F.struct("id", "c", "n", "rest")).alias("hub")).select("token", "hub")


def meetings(rows: DataFrame, centres: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of a bucket's row and centre of different components whose places there allow a link."""
    most = "least(rest, hub.rest)"
    met = rows.join(centres, "token").where(f"id <> hub.id and c <> hub.c and 100 * {most} >= {percent} * (n + hub.n - {most})")
    return met.select(F.least("id", "hub.id").alias("a"), F.greatest("id", "hub.id").alias("b"))


def rare_links(members: DataFrame, sets: DataFrame, percent: int, cells: int = 1 << 20, rounds: int = 15) -> DataFrame:
    """Links (a, b) that join members (id, c) of different components c to the components that all their links make.

    Shingles are ordered by how many members hold one of their cell (a table of `cells` counts, whatever the input).
    Two sets of n and m shingles that are linked share one of the first n - ceil(n * percent / 100) + 1 of each, so a
    shingle's bucket holds those members only that have it so early: what most members share names no bucket unless
    hardly anything else is in the set. A place in the order also bounds what two sets may share: sets of n and m shingles
    that first meet at places i and j share min(n - i, m - j) at most, so a member leaves a bucket none of whose sets is
    small enough, and a pair meets only if that bound allows a link. Of two that may be linked, one at least is early (see
    `early`), so only early members are centres, and a bucket without one is closed however large it is. In each round a
    bucket's members of other components are compared with its centres, the least id of each of 1, 16, 256, ... parts by hash;
    centres then leave the bucket, links join components, and buckets of one component are closed. What is joined to a
    bucket's rows is written, so Spark broadcasts it where its files are small. Raises if buckets are open after `rounds`.
    """
    whole = members.join(sets.hint("merge"), "id").select("id", "c", "s")

    def counted(batches):
        found = np.zeros(cells, np.int64)
        for batch in batches:
            for s in batch.column(2):
                np.add.at(found, (np.frombuffer(s.as_py(), np.uint64) % np.uint64(cells)).astype(np.int64), 1)
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(found[at])], ["cell", "n"])

    counts = whole.mapInArrow(counted, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(cells, np.int64)
    table[np.asarray(counts["cell"], np.int64)] = np.asarray(counts["n"], np.int64)
    shared = members.sparkSession.sparkContext.broadcast(table)

    def prefixes(batches):
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for i, s in enumerate(batch.column(2)):
                tokens = np.frombuffer(s.as_py(), np.uint64)
                held = shared.value[(tokens % np.uint64(cells)).astype(np.int64)]
                kept = np.lexsort((tokens, held))[: len(tokens) - -(-len(tokens) * percent // 100) + 1]
                place = np.flatnonzero(held[kept] > 1)  # one holder has no partner
                kept = kept[place]
                for column, value in zip(rows, (tokens[kept].view(np.int64), *(np.full(len(kept), x) for x in (batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), len(tokens))), len(tokens) - place), strict=True):
                    column.append(value)
            if rows[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in rows], ["token", "id", "c", "n", "rest"])

    # rest: the shingles of a set from this one on
    open_ = stash(whole.mapInArrow(prefixes, "token bigint, id bigint, c bigint, n bigint, rest bigint"), "rare")
    links = None
    for k in range(rounds):
        several = stash(open_.groupBy("token").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.min(F.when(early(percent), F.col("n"))).alias("least")).where("low < high and least is not null").select("token", "least"), "several")
        left = open_.join(several, "token").where(f"100 * rest >= {percent} * (n + greatest(least, rest) - rest)").drop("least")
        left = stash(left, "left")
        drop(several)
        drop(open_)
        if left.isEmpty():
            drop(left)
            return links if links is not None else members.where("false").select(F.col("id").alias("a"), F.col("id").alias("b"))
        centres = stash(early_centres(left, percent, 16**k), "centres")
        pairs = stash(meetings(left, centres, percent).distinct(), "rarepairs")
        found = stash(confirmed(pairs, sets).where(f"100 * shared >= {percent} * total").select("a", "b"), "rarelinks")
        links = found if links is None else links.union(found)
        used = centres.select("token", F.col("hub.id").alias("id"))
        open_ = left.join(used, ["token", "id"], "left_anti")
        if not found.isEmpty():
            label = left.select("id", "c").distinct()
            edges = found.join(label.withColumnsRenamed({"id": "a", "c": "ca"}), "a").join(label.withColumnsRenamed({"id": "b", "c": "cb"}), "b")
            into = stash(components(edges.select(F.col("ca").alias("a"), F.col("cb").alias("b")), "merged"), "into")
            open_ = open_.join(into.withColumnsRenamed({"node": "c", "component": "now"}), "c", "left").select("token", "id", F.coalesce("now", "c").alias("c"), "n", "rest")
        open_ = stash(open_, "rare")
        drop(left, centres, pairs)
    raise RuntimeError(f"near duplicates are not settled after {rounds} rounds")
