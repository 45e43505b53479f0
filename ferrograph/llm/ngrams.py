"""Exact join of documents by the Jaccard similarity of their word n-grams (operator 13).

Under any order of all tokens, two sets of similarity t share a token among the first n - ceil(t n) + 1 of each. The
first order is by how many documents hold a token's cell, rarest first, so that common text names hardly a bucket; the
others are by two hashes. Documents that meet in a bucket of the first order are candidates only if their prefixes meet under
the other orders as well, and only then are their whole sets compared. A bucket is a star around its least document,
not a set of pairs; `settled` goes on with more centres until no bucket holds two components that may still be linked.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import stash
from .minhash import MIX, mixed
from .shared import blocks, components, drop, release

#: Cells of the table of token counts, whatever the input, and how many of them make a chunk.
CELLS, CHUNK = 1 << 20, 1 << 12
#: The seeds of the orders by hash.
SEEDS = (np.uint64(0x165667B19E3779F9), np.uint64(0x27D4EB2F165667C5))
#: Rows of a bucket beyond which its token is dealt over several buckets by a salt, which the token's low byte holds (0: not dealt).
SALTED, LOW = 50_000, 0xFF
#: Ids up to which a list of them is broadcast to filter texts by; beyond, texts are joined with it.
IDS = 1_000_000
#: Rows up to which a table's hot key may be one task's work; beyond, what is joined to it is written, so that Spark may split it.
SPLIT = 1_000_000


def prefix_length(n: int, percent: int) -> int:
    return n - -(-n * percent // 100) + 1


#: A factor for each byte and each place in a word (more places are worked out when a word is longer), and the bytes that end words.
FACTORS = mixed(np.arange(1, 4353, dtype=np.uint64) * MIX[0])
BYTES, PLACES = FACTORS[:256], FACTORS[256:]
BLANK = np.isin(np.arange(256), list(b" \t\n\v\f\r"))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of a block (A-Z lower-cased, words end at ASCII white space), and how many each text has.

    A word's hash is the sum of its bytes' factors, each times that of its place, so all bytes are worked on at once.
    """
    raw = [t.encode() for t in texts]
    codes = np.frombuffer((b"\n".join(raw) + b"\n").lower(), np.uint8)
    inside = np.flatnonzero(~BLANK[codes])
    if not len(inside):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    first = np.flatnonzero(np.concatenate([[True], inside[1:] != inside[:-1] + 1]))
    sizes = np.diff(np.append(first, len(inside)))
    place = np.arange(len(inside)) - np.repeat(first, sizes)
    most = int(sizes.max())
    factors = PLACES if most <= len(PLACES) else mixed(np.arange(257, most + 257, dtype=np.uint64) * MIX[0])
    found = mixed(np.add.reduceat(BYTES[codes[inside]] * factors[place], first) ^ sizes.astype(np.uint64))
    ends = np.cumsum([len(r) + 1 for r in raw])
    return found, np.diff(np.searchsorted(inside[first], np.concatenate([[0], ends])))


def shingle_sets(texts: list[str], size: int) -> list[np.ndarray]:
    """Each text's distinct shingles of `size` words as sorted 64-bit hashes; shorter texts are one shingle, empty ones none.

    All words of a block are hashed together; the shingles that cross from text to text are left out.
    """
    words, counts = word_hashes(texts)
    whole = np.full(max(0, len(words) - size + 1), size, np.uint64)
    for i in range(size):
        whole = mixed(whole * MIX[0] + words[i : len(words) - size + 1 + i])
    found = []
    for n, end in zip(counts.tolist(), np.cumsum(counts).tolist(), strict=True):
        if n >= size:
            one = np.sort(whole[end - n : end - size + 1])
            found.append(one[np.concatenate([[True], one[1:] != one[:-1]])])
        else:
            total = np.full(min(n, 1), n, np.uint64)
            for w in words[end - n : end]:
                total = mixed(total * MIX[0] + w)
            found.append(total)
    return found


def packed(df: DataFrame) -> DataFrame:
    """Rows with n and rest taken out of `size` (n << 32 | rest)."""
    return df.withColumn("n", F.shiftright("size", 32)).withColumn("rest", F.col("size").bitwiseAND(F.lit(0xFFFFFFFF)))


def read(docs: DataFrame, size: int) -> DataFrame:
    """For documents (id, t): rows (id, n, sig), and each task's counts of cells in rows (chunk, at, counts); at is null where counts has the whole chunk."""

    def run(batches):
        table = np.zeros(CELLS, np.int32)
        names = ["id", "n", "sig", "chunk", "at", "counts"]
        types = [pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32())]
        for batch, texts in blocks(batches, 1):
            sets = shingle_sets(texts, size)
            if sets:
                table += np.bincount((np.concatenate(sets) % np.uint64(CELLS)).astype(np.int64), minlength=CELLS).astype(np.int32)
            columns = [batch.column(0), [len(s) for s in sets], [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, types, strict=False)), *(pa.nulls(len(texts), t) for t in types[3:])], names)
        rows: list[tuple] = []
        for k in range(CELLS // CHUNK):
            part = table[k * CHUNK : (k + 1) * CHUNK]
            at = np.flatnonzero(part)
            if len(at):
                rows.append((k, None, part) if 4 * len(at) > CHUNK else (k, at.astype(np.int32), part[at]))
        if rows:
            yield pa.RecordBatch.from_arrays([*(pa.nulls(len(rows), t) for t in types[:3]), *(pa.array([r[i] for r in rows], types[3 + i]) for i in range(3))], names)

    return docs.mapInArrow(run, "id bigint, n bigint, sig binary, chunk int, at array<int>, counts array<int>")


def cell_counts(chunks: DataFrame) -> np.ndarray:
    """The table of counts, summed chunk by chunk in Spark; its size is fixed."""

    def summed(batches):
        now, total = None, None
        for batch in batches:
            for i, k in enumerate(batch.column(0).to_pylist()):
                if k != now:
                    if now is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["chunk", "counts"])
                    now, total = k, np.zeros(CHUNK, np.int64)
                at, part = batch.column(1)[i], np.asarray(batch.column(2)[i].values)
                if at.is_valid:
                    total[np.asarray(at.values)] += part
                else:
                    total += part
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["chunk", "counts"])

    got = chunks.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(summed, "chunk int, counts binary").toArrow()
    table = np.zeros(CELLS, np.int64)
    for k, c in zip(got["chunk"].to_pylist(), got["counts"], strict=True):
        table[k * CHUNK : (k + 1) * CHUNK] = np.frombuffer(c.as_py(), np.int64)
    return table


def first_tokens(tokens: np.ndarray, table: np.ndarray, mean: float, percent: int, twin: int) -> tuple[np.ndarray, np.ndarray]:
    """A set's prefix, rarest first, less tokens that no other set can hold; and how many tokens the set has from each on.

    A token is named by its upper 56 bits. One held by many more sets than the mean cell is dealt over buckets: its low byte
    is a salt, by the set's hash `twin`.
    """
    held = table[(tokens % np.uint64(CELLS)).astype(np.int64)]
    order = (np.minimum(held, (1 << 31) - 1).astype(np.uint64) << np.uint64(32)) | (tokens >> np.uint64(32))
    n = prefix_length(len(tokens), percent)
    kept = np.argpartition(order, n - 1)[:n]
    kept = kept[np.argsort(order[kept])]
    place = np.flatnonzero(held[kept] > 1)
    kept = kept[place]
    salts = np.minimum((held[kept] - 2 * mean) // SALTED, LOW - 1).clip(0).astype(np.int64)
    salt = np.where(salts > 0, 1 + twin % (salts + 1), 0).astype(np.uint64)
    return (tokens[kept] & ~np.uint64(LOW)) | salt, len(tokens) - place


def pieces(batches, most: int = 200_000):
    """Sorted rows in pieces of whole buckets (equal first column) as lists of arrays, with whether the first and the last bucket may be cut.

    A bucket of more than `most` rows is cut.
    """
    held: list[np.ndarray] | None = None
    front = False
    for batch in batches:
        columns = [np.asarray(c, np.int64) for c in batch.columns]
        held = columns if held is None else [np.concatenate(x) for x in zip(held, columns, strict=True)]
        if len(held[0]) > most:
            cut = int(np.searchsorted(held[0], held[0][-1]))
            if cut:
                yield [c[:cut] for c in held], front, False
                held, front = [c[cut:] for c in held], False
            else:
                yield held, True, True
                held, front = None, True
    if held is not None and len(held[0]):
        yield held, front, False


def starred(rows: DataFrame) -> DataFrame:
    """Rows (token, twin, id, c, size) of buckets with partners, with their bucket's hub (its first row) and `border`.

    Rows are dealt and sorted by token, salts and all, and read in order; of equal sets (one twin) the first one stays. A
    bucket that a salt or the reading in pieces has cut has several hubs and is marked, as those have still to meet. So no
    bucket is held in memory, and a hot one is dealt over tasks. Tokens come back without salts.
    """
    order, names = ["token", "twin", "id"], ["token", "id", "c", "size", "hub", "border"]

    def run(batches):
        for columns, front, back in pieces(batches):
            same = (columns[0][1:] == columns[0][:-1]) & (columns[1][1:] == columns[1][:-1])
            token, _, *rest = [c[np.concatenate([[True], ~same])] for c in columns]
            new = np.concatenate([[True], token[1:] != token[:-1]])
            bucket, first = np.cumsum(new) - 1, np.flatnonzero(new)
            border = (bucket == 0) & front | (bucket == bucket[-1]) & back | ((token & LOW) != 0)
            shown = np.flatnonzero(border | (np.bincount(bucket)[bucket] > 1))
            hubs = [c[first[bucket[shown]]] for c in rest]
            hub = pa.StructArray.from_arrays([pa.array(c) for c in hubs], ["id", "c", "size"])
            yield pa.RecordBatch.from_arrays([pa.array(token[shown] & ~LOW), *(pa.array(c[shown]) for c in rest), hub, pa.array(border[shown])], names)

    schema = "token bigint, id bigint, c bigint, size bigint, hub struct<id: bigint, c: bigint, size: bigint>, border boolean"
    return rows.select(*order, "c", "size").repartition("token").sortWithinPartitions(*order).mapInArrow(run, schema)


def listed(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of df whose id is in the written table ids, which is broadcast while it is small."""
    return df.join(F.broadcast(ids) if ids.count() <= IDS else ids, "id", "left_semi")


def sets_of(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """(id, s, counts) for the documents (id, t) named in ids: the bytes of the sorted shingle hashes, and of how many fall in each of 256 parts (255: that many or more)."""

    def sets(batches):
        for batch, texts in blocks(batches, 1):
            made = shingle_sets(texts, size)
            counts = [np.minimum(np.bincount((s >> np.uint64(56)).astype(np.int64), minlength=256), 255).astype(np.uint8).tobytes() for s in made]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in made], pa.binary()), pa.array(counts, pa.binary())], ["id", "s", "counts"])

    return listed(docs, ids).mapInArrow(sets, "id bigint, s binary, counts binary")


def prefix(tokens: np.ndarray, seed: np.uint64, percent: int) -> np.ndarray:
    """A set's prefix under the order by hash with this seed, as sorted hashes."""
    order, n = mixed(tokens ^ seed), prefix_length(len(tokens), percent)
    return np.sort(np.partition(order, n - 1)[:n])


def meet(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted arrays share a value."""
    at = np.searchsorted(y, x)
    return bool((y[np.minimum(at, len(y) - 1)] == x).any())


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b), those whose prefixes meet under every other order too, and whose whole sets are similar.

    Two sets share at most the sum of the lesser counts of their parts; pairs that this bound rules out move no set.
    """

    def joined(pairs: DataFrame, df: DataFrame, what: str) -> DataFrame:
        side = lambda x: df.select(F.col("id").alias(x), F.col(what).alias(f"s_{x}"))
        return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "s_a", "s_b")

    def possible(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, 256).astype(np.int64) for c in (2, 3))
            most, full = np.minimum(x, y).sum(1), (np.maximum(x, y) == 255).any(1)
            yield batch.select([0, 1]).filter(pa.array(full | (100 * most >= percent * (x.sum(1) + y.sum(1) - most))))

    def compared(batches):
        for batch in batches:
            linked = np.zeros(batch.num_rows, bool)
            for i, sides in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in sides)
                if all(meet(prefix(x, seed, percent), prefix(y, seed, percent)) for seed in SEEDS):
                    shared = len(np.intersect1d(x, y, assume_unique=True))
                    linked[i] = 100 * shared >= percent * (len(x) + len(y) - shared)
            yield batch.select([0, 1]).filter(pa.array(linked))

    left = stash(joined(pairs, sets, "counts").mapInArrow(possible, "a bigint, b bigint").distinct(), "possible")
    ids = stash(left.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
    found = stash(joined(left, listed(sets, ids), "s").mapInArrow(compared, "a bigint, b bigint").distinct(), "found")
    drop(left, ids)
    return found


def sized(df: DataFrame, rows: int, name: str) -> DataFrame:
    """df, written if what it is joined to has so many rows that a hot key's share must be split."""
    return stash(df, name) if rows > SPLIT else df


def settled(rows: DataFrame, percent: int, make_sets: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Links (a, b) that join all nodes with tokens (token, twin, id, c, size) in common that are linked, given that nodes of one c are joined.

    size holds n, a set's tokens, and rest, how many of them come from this token on in the first order. Sets that first
    meet at a token share the lesser rest at most, so no pair is compared whose bound forbids a link, and a row leaves a bucket
    that holds no set small enough. In round k a bucket's rows of other components are compared with its centres, the
    least of each of 16**k parts by hash; centres then leave the bucket, links join components, and buckets of one
    component are closed. As parts outgrow buckets, the rounds end. make_sets gives the sets
    (id, s) of a written table of ids: a round moves the sets that it compares, and no others.
    """
    open_ = stash(starred(rows), "open")
    release(open_)
    links = None
    low = "least(rest, hub_rest)"
    bound = f"c <> hub_c and 100 * least(n, hub_n) >= {percent} * greatest(n, hub_n) and 100 * {low} >= {percent} * (n + hub_n - {low})"
    for k in count():
        n_open = open_.count()
        if k:
            part = F.pmod(F.xxhash64("id"), F.lit(16 ** min(k, 15)))
            centres = sized(open_.groupBy("token", part.alias("part")).agg(F.min(F.struct("id", "c", "size")).alias("hub")).select("token", "hub"), n_open, "centres")
            met = open_.join(centres, "token")
        else:
            met = open_
        met = packed(met.where("id <> hub.id")).withColumn("hub_c", F.col("hub.c"))
        met = met.withColumn("hub_n", F.shiftright("hub.size", 32)).withColumn("hub_rest", F.col("hub.size").bitwiseAND(F.lit(0xFFFFFFFF)))
        pairs = stash(met.where(bound).select(F.least("id", "hub.id").alias("a"), F.greatest("id", "hub.id").alias("b")).distinct(), "pairs")
        ids = stash(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
        sets = stash(make_sets(ids), "sets")
        found = verified(pairs, sets, percent)
        drop(pairs, ids, sets)
        links = found if links is None else links.union(found)
        left = open_.join(centres.select("token", F.col("hub.id").alias("id")), ["token", "id"], "left_anti") if k else open_.where("id <> hub.id or border")
        left = left.select("token", "id", "c", "size")
        if not found.isEmpty():
            # the components of components; a node's c is what it was in the rows
            label = open_.select("id", "c").distinct()
            edges = found.join(label.withColumnsRenamed({"id": "a", "c": "ca"}), "a").join(label.withColumnsRenamed({"id": "b", "c": "cb"}), "b")
            into = stash(components(edges.select(F.col("ca").alias("a"), F.col("cb").alias("b")), "merged"), "into")
            left = left.join(into.withColumnsRenamed({"node": "c", "component": "now"}), "c", "left").select("token", "id", F.coalesce("now", "c").alias("c"), "size")
        several = left.groupBy("token").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.min(F.shiftright("size", 32)).alias("least")).where("low < high").select("token", "least")
        rest = packed(left.join(sized(several, n_open, "several"), "token")).where(f"100 * rest >= {percent} * (n + greatest(least, rest) - rest)")
        last, open_ = open_, stash(rest.select("token", "id", "c", "size"), "open")
        drop(last)
        if open_.isEmpty():
            drop(open_)
            return links


def ngram_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """Per document: key, n_shingles, component_id (the smallest key reachable by links, itself included).

    A document's set are its distinct shingles of `size` words (A-Z lower-cased, words end at ASCII white space); a shorter
    text is one shingle, null, empty and blank texts have none and are linked with nothing. Two documents are linked if
    100 * shared >= percent * all of their shingles. Keys must be whole numbers; rows with a null key are linked with
    nothing and have no component. Rows with equal keys count as one document if their texts are equal; else each row
    shows the component of its own text. Other columns are ignored.

    Texts are read once for sizes and counts, once for prefixes, and once a round for the sets that are compared; they are
    not shuffled while a round compares fewer than a million documents (whose ids are then broadcast). Equal sets are one node, named by the least key. All links between
    different sets are found or implied by a path of links.
    """
    source = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("t"))
    signatures = stash(read(source, size), "signatures")
    table = cell_counts(signatures.where("chunk is not null").select("chunk", "at", "counts"))
    shared = docs.sparkSession.sparkContext.broadcast((table, float(table.mean())))

    def tokens(batches):
        for batch, texts in blocks(batches, 1):
            made = shingle_sets(texts, size)
            out: list[list] = [[], [], [], []]
            for i, s in enumerate(made):
                if len(s):
                    twin = xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)
                    kept, rest = first_tokens(s, *shared.value, percent, twin)
                    for column, value in zip(out, (kept.view(np.int64), np.full(len(kept), twin, np.int64), np.full(len(kept), batch.column(0)[i].as_py()), (len(s) << 32) | rest), strict=True):
                        column.append(value)
            if out[0]:
                token, twin, ids, sizes = (pa.array(np.concatenate(c).astype(np.int64)) for c in out)
                yield pa.RecordBatch.from_arrays([token, twin, ids, ids, sizes], ["token", "twin", "id", "c", "size"])

    rows = source.where("id is not null").mapInArrow(tokens, "token bigint, twin bigint, id bigint, c bigint, size bigint")
    links = stash(settled(rows, percent, lambda ids: sets_of(source, ids, size)), "links")
    texts = signatures.where("chunk is null").select("id", "n", F.coalesce("sig", F.lit(b"")).alias("sig"))
    folded = texts.where("id is not null and n > 0").groupBy("sig").agg(F.min("id").alias("rep"))
    groups = components(links, "groups")
    group_of = stash(folded.join(groups, folded["rep"] == groups["node"], "left").select("sig", F.coalesce("component", "rep").alias("g")), "group")
    drop(links)
    component = F.when(F.col("id").isNotNull(), F.coalesce("g", "id"))
    return texts.join(group_of, "sig", "left").select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"))


def ngram_sql(size: int = 4, percent: int = 85) -> str:
    """DuckDB's SQL for the query's rows: all pairs of sets that share a shingle, then the closure of their links."""
    return rf"""
with recursive w as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') as w from documents),
sh as materialized (select doc_id, list_distinct(list_transform(range(1, greatest(len(w) - {size} + 2, least(len(w), 1) + 1)::bigint), lambda i: array_to_string(w[i : i + {size - 1}], ' '))) as s from w where w is not null),
tok as materialized (select doc_id as id, md5(unnest(s)) as k from sh),
pairs as (select a.id as a, b.id as b, count(*) as n from tok a join tok b on a.k = b.k and a.id < b.id group by all),
links as materialized (select a, b from pairs join sh x on x.doc_id = a join sh y on y.doc_id = b where 100 * n >= {percent} * (len(x.s) + len(y.s) - n)),
both_ as (select a, b from links union select b, a from links),
reach(a, b) as (select a, b from both_ union select r.a, o.b from reach r join both_ o on r.b = o.a)
select doc_id, coalesce(len(s), 0)::bigint as n_shingles, least(doc_id, (select min(b) from reach where a = doc_id))::bigint as component_id
from (select doc_id from documents) left join sh using (doc_id)
"""
