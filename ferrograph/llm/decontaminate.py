"""Benchmark decontamination by multi-pattern search over words (operator 7).

Patterns are the word windows of the benchmark items. As in Wu and Manber's search, a table says how far the search may
shift for the last two words seen, only a pair that ends a pattern opens the bucket of patterns with that suffix, the
pattern's first two words select among them, and a direct comparison confirms. Windows of one length share one set of tables.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import blocks, per_text, stash

# Fixed value: a word, once A-Z are lower-cased, in UTF-8 bytes.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: str) -> list[bytes]:
    return WORD.findall(text.encode().lower())  # bytes lower-case ASCII letters only


class Patterns:
    """Search tables for word windows, for each window length: a shift table, whose zeros name buckets, and the windows as one matrix.

    Words are numbers, two words in a row one number; a bucket is a range of rows that end alike, ordered by how they begin.
    """

    def __init__(self, items: list[tuple[str | None, str]], window: int):
        self.names, self.ids = [name for name, _ in items], {}
        texts = [np.array([self.ids.setdefault(w, len(self.ids) + 1) for w in words_of(text)], np.int64) for _, text in items]
        self.base = len(self.ids) + 1
        self.tables = []
        for size in sorted({min(window, len(t)) for t in texts} - {0}):
            of = [k for k, t in enumerate(texts) if min(window, len(t)) == size]
            rows = np.concatenate([np.lib.stride_tricks.sliding_window_view(texts[k], size) for k in of]).astype(np.int32)
            owner = np.repeat(of, [len(texts[k]) - size + 1 for k in of])
            rows, which = np.unique(rows, axis=0, return_inverse=True)
            block = min(2, size)
            suffix, prefix = self.pairs(rows, size - block), self.pairs(rows, 0)
            order = np.lexsort((prefix, suffix))
            rows, suffix, prefix = rows[order], suffix[order], prefix[order]
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            owned = np.unique(np.stack([place[which.reshape(-1)], owner], 1), axis=0)
            first = np.searchsorted(owned[:, 0], np.arange(len(rows) + 1))
            # the shift of two words is the least distance to a window's end at which they stand
            shift: dict[int, int] = {}
            for end in range(block, size):
                for key in np.unique(self.pairs(rows, end - block)).tolist():
                    shift[key] = size - end
            keys, low = np.unique(suffix, return_index=True)
            for k, key in enumerate(keys.tolist()):
                shift[key] = -k
            self.tables.append((size, block, size - block + 1, shift, np.append(low, len(rows)), prefix, rows, first, owned[:, 1].astype(np.int32)))

    def pairs(self, rows: np.ndarray, at: int) -> np.ndarray:
        """The word at a place, or it and the next as one number where rows are longer."""
        return rows[:, at].astype(np.int64) * self.base + rows[:, at + 1] if rows.shape[1] > 1 else rows[:, at].astype(np.int64)

    def search(self, text: str) -> tuple[int, list[tuple[int, int]], set[int]]:
        """Words of the text, (start, end) of the windows that occur, in order and merged, and the items they are of."""
        known = self.ids.get
        words = [known(w, 0) for w in words_of(text)]
        n, base, spans, owners = len(words), self.base, [], set()
        pairs = [a * base + b for a, b in zip(words, words[1:], strict=False)]
        for size, block, most, shift, low, prefix, rows, first, owner in self.tables:
            blocks_, at = pairs if block == 2 else words, size - 1
            while at < n:
                step = shift.get(blocks_[at - block + 1], most)
                if step > 0:
                    at += step
                    continue
                start, bucket = at - size + 1, prefix[low[-step] : low[1 - step]]
                for k in range(*(low[-step] + np.searchsorted(bucket, [blocks_[start], blocks_[start] + 1])).tolist()):
                    if rows[k].tolist() == words[start : at + 1]:
                        spans.append((start, at + 1))
                        owners.update(owner[first[k] : first[k + 1]].tolist())
                at += 1
        return n, merged(spans), owners


def merged(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def digest(n: int, spans: list[tuple[int, int]], names) -> tuple:
    hit = sum(b - a for a, b in spans)
    return n, hit, len(names), hashlib.sha256(",".join(sorted(names - {None})).encode()).hexdigest(), hit > 0


SCHEMA = "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 10, pass_bytes: int = 4_000_000, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per document: key, the columns `keep`, n_words, n_hit (words inside an occurrence of an item's window), n_items, items_sha256, contaminated.

    A window is `window` consecutive words of an item; a shorter item is one window; items without words have none.
    Items that share an id are one; those without an id count as one more, which items_sha256 leaves out. Null texts have
    no words; repeated rows are judged each by itself; other columns are ignored. The benchmark's size is measured first:
    while its text has at most `pass_bytes` bytes its tables (some 30 bytes of memory for each) go with the tasks and one
    pass over the documents, without a shuffle, is all. A larger benchmark is searched in as many passes of that size,
    whose findings (only documents with hits have any) are then merged by document.
    """
    items = benchmark.select(F.col(item).cast("string").alias("name"), F.coalesce(F.col(item_text), F.lit("")).alias("words"))
    total = items.agg(F.sum(F.octet_length("words")).alias("n")).first()["n"] or 0
    passes = max(1, -(-total // pass_bytes))
    spark = docs.sparkSession
    part = lambda k: [(r["name"], r["words"]) for r in items.where(F.pmod(F.xxhash64("name", "words"), F.lit(passes)) == k).collect()]
    if passes == 1:
        tables = spark.sparkContext.broadcast(Patterns(part(0), window))

        def work(texts: list[str]) -> list[list]:
            patterns = tables.value
            found = (patterns.search(t) for t in texts)
            return [list(c) for c in zip(*(digest(n, spans, {patterns.names[k] for k in owners}) for n, spans, owners in found), strict=True)]

        return per_text(docs, [key, *keep], text, SCHEMA, work)

    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"), F.struct(*keep).alias("kept") if keep else F.lit(None).cast("int").alias("kept"))
    found = None
    for k in range(passes):
        tables = spark.sparkContext.broadcast(Patterns(part(k), window))

        def search(batches, tables=tables):
            for batch, texts in blocks(batches, 1):
                patterns, out = tables.value, []
                for i, t in enumerate(texts):
                    _, spans, owners = patterns.search(t)
                    if spans:
                        out.append((i, hashlib.sha256(t.encode()).hexdigest(), list(chain(*spans)), [patterns.names[o] for o in owners]))
                if out:
                    at, hashes, spans, names = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(hashes), pa.array(spans, pa.list_(pa.int64())), pa.array(names, pa.list_(pa.string()))], ["k", "h", "spans", "names"])

        out = StructType([rows.schema["k"], *StructType.fromDDL("h string, spans array<bigint>, names array<string>").fields])
        one = stash(rows.select("k", "t").mapInArrow(search, out), "hits")
        found = one if found is None else found.union(one)
    found = found.distinct().groupBy("k", "h").agg(F.collect_list("spans").alias("spans"), F.array_distinct(F.flatten(F.collect_list("names"))).alias("names"))
    counts = per_text(rows, ["k", "t", "kept"], "t", "n bigint", lambda texts: [[len(words_of(t)) for t in texts]])
    counts = counts.select("k", F.sha2("t", 256).alias("h"), "kept", "n")
    joined = counts.alias("c").join(found.alias("f"), F.expr("c.k <=> f.k and c.h = f.h"), "left")

    def finish(batches):
        for batch in batches:
            out = []
            for n, spans, names in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                out.append(digest(n, merged((s[i], s[i + 1]) for s in spans or () for i in range(0, len(s), 2)), set(names or ())))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
            if out:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True))], ["k", "kept", *(x.split()[0] for x in SCHEMA.split(", "))])

    out = StructType([rows.schema["k"], rows.schema["kept"], *StructType.fromDDL(SCHEMA).fields])
    done = joined.select("c.k", "c.kept", "c.n", "f.spans", "f.names").mapInArrow(finish, out)
    return done.select(F.col("k").alias(key), *(F.col("kept")[c].alias(c) for c in keep), *(x.split()[0] for x in SCHEMA.split(", ")))


#: The same in DuckDB's SQL, over documents and benchmark.
DECONTAMINATE_SQL = r"""
with w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
bw as (
  select distinct item_id, least(10, len(w)) as n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') as g
  from (select item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i from b where len(w) > 0)),
dw as (
  select doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') as g
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from w, (select distinct n from bw) where len(w) >= n)),
h as (select doc_id, i, dw.n, item_id from dw join bw on dw.n = bw.n and dw.g = bw.g),
hit as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + n)) as p from h) group by doc_id),
it as (
  select doc_id, count(*) as n, string_agg(item_id::varchar, ',' order by item_id::varchar) as s
  from (select distinct doc_id, item_id from h) group by doc_id)
select w.doc_id, len(w)::bigint as n_words, coalesce(hit.n, 0)::bigint as n_hit, coalesce(it.n, 0)::bigint as n_items,
       sha256(coalesce(s, '')) as items_sha256, coalesce(hit.n, 0) > 0 as contaminated
from w left join hit on w.doc_id = hit.doc_id left join it on w.doc_id = it.doc_id
"""
