"""Line dedup by winnowing (operator 4).

A document is the sequence of its lines' hashes. Of each window of `width` consecutive lines, and of each shorter one of
enough words, the place of the least hash is selected; windows that overlap mostly select the same place, which is kept
once, with the lines around it. Any repeated run selects the same places in all its copies. Places join by their hash
if it occurs twice or more; a match is extended to the left and to the right over the windows that selected the
place, and of equal extents all but the first are repeats. What they cover together are the later repeated runs, which
are deleted.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .shared import blocks, drop, free_name, stash


def line_hashes(text: str) -> tuple[list[str], np.ndarray, list[int]]:
    """Lines of a text, hashes of those that are not blank (white space at their ends apart), and their line numbers."""
    lines = text.split("\n")
    kept = [(i, s) for i, x in enumerate(lines) if (s := x.strip())]
    hashes = np.array([int.from_bytes(hashlib.blake2b(s.encode(), digest_size=8).digest(), "big", signed=True) for _, s in kept], np.int64)
    return lines, hashes, [i for i, _ in kept]


def long_windows(lines: list[str], numbers: list[int], width: int, words: int) -> list[tuple[int, int]]:
    """Start and size of the windows of fewer than `width` lines that have `words` words or more."""
    chars = [len(lines[i]) for i in numbers]
    counts: dict[int, int] = {}
    found = []
    for size in range(1, min(width, len(numbers) + 1)):
        for p in range(len(numbers) - size + 1):
            if sum(chars[p : p + size]) < 2 * words - size:  # each word but a line's last has white space after it
                continue
            for q in range(p, p + size):
                if q not in counts:
                    counts[q] = len(lines[numbers[q]].split())
            if sum(counts[q] for q in range(p, p + size)) >= words:
                found.append((p, size))
    return found


def selected(hashes: np.ndarray, short: list[tuple[int, int]], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct places that windows select, and the extents of those windows, one place after another: how many a place has, and each as a code.

    A code is (size * width + lines to the left) * 2, and 1 more if the window is a whole text of fewer than `width` lines.
    """
    n, none = len(hashes), np.zeros(0, np.int64)
    windows = [(np.arange(n - width + 1), width, 0)] if n >= width else []
    windows += [(np.array([p for p, size in short if size == s], np.int64), s, 0) for s in sorted({size for _, size in short})]
    if 0 < n < width and (0, n) not in short:
        windows.append((np.zeros(1, np.int64), n, 1))
    if not windows:
        return none, none, none
    places, codes = [], []
    for starts, size, whole in windows:
        left = np.lib.stride_tricks.sliding_window_view(hashes, size)[starts].argmin(1)
        places.append(starts + left)
        codes.append((size * width + left) * 2 + whole)
    places, codes = np.concatenate(places), np.concatenate(codes)
    order = np.argsort(places, kind="stable")
    distinct, counts = np.unique(places, return_counts=True)
    return distinct, counts, codes[order]


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, words: int = 50) -> DataFrame:
    """docs with text without repeated runs, and n_lines_removed; all columns and rows of docs are kept.

    A run of `width` non-blank lines or more, or of fewer that have `words` words together, that occurs earlier (smaller
    key, or same document and earlier) is deleted, so are overlapping runs; what is compared are the lines of the input.
    A text of fewer lines and words is one window besides, which only an equal text of as many lines repeats. Blank lines
    neither count nor separate; those between deleted lines go with them. Null and empty texts stay, so do rows with a
    null key. Rows with equal keys count as one document by order of their places only: equal rows keep their text. Keys
    must be whole numbers. Columns of docs may have any names: n_lines_removed gets underscores until it is free.

    Shuffled are the selected places (about half of the lines, counted by hash first) and, of those whose hash repeats,
    the windows; first places are partial minima, so a line that a third of the documents share is never gathered. What
    is joined back is written first, so that Spark may split a hot key's rows in the join. Each document then gets back
    only the list of its deleted windows.
    """
    source = docs.select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("t"))
    side = 2 * width - 1

    def select(batches):
        for batch, texts in blocks(batches, 1):
            columns: list[list] = [[] for _ in range(6)]
            for i, t in enumerate(texts):
                lines, hashes, numbers = line_hashes(t)
                places, counts, codes = selected(hashes, long_windows(lines, numbers, width, words), width)
                if len(places):
                    around = np.lib.stride_tricks.sliding_window_view(np.pad(hashes, width - 1), side)[places]
                    for column, value in zip(columns, (np.full(len(places), batch.column(0)[i].as_py(), np.int64), hashes[places], places, around.reshape(-1), counts, codes), strict=True):
                        column.append(value)
            if columns[0]:
                k, f, p, around, counts, codes = map(np.concatenate, columns)
                lists = [pa.ListArray.from_arrays(np.arange(0, len(around) + 1, side, dtype=np.int32), around)]
                lists.append(pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), codes.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(f), pa.array(p.astype(np.int32)), *lists], ["k", "f", "p", "around", "spans"])

    places = stash(source.where("k is not null and t is not null").mapInArrow(select, "k bigint, f bigint, p int, around array<bigint>, spans array<int>"), "places")
    prints = stash(places.groupBy("f").agg(F.count("*").alias("c")).where("c > 1").select("f"), "prints")
    met = stash(places.join(prints.hint("merge"), "f", "left_semi"), "met")
    drop(places, prints)
    size, left = F.expr(f"s div 2 div {width}"), F.expr(f"s div 2 % {width}")
    windows = met.select("k", "f", "p", "around", F.explode("spans").alias("s"))
    windows = windows.select("k", "f", F.xxhash64("s", F.slice("around", F.lit(width) - left, size)).alias("w"), (F.col("p") - left).cast("int").alias("start"), size.cast("int").alias("size"))
    first = stash(windows.groupBy("f", "w").agg(F.min(F.struct("k", "start")).alias("first"), F.count("*").alias("c")).where("c > 1").drop("c"), "first")
    later = windows.join(first.hint("merge"), ["f", "w"]).where(F.struct("k", "start") > F.col("first"))
    gone = stash(later.groupBy("k").agg(F.sort_array(F.collect_set(F.struct("start", "size"))).alias("gone")), "gone")
    drop(met, first)

    names, at, removed = docs.columns, docs.columns.index(text), free_name(docs.columns, "n_lines_removed")
    # a merge join at every size: the list of windows grows with the documents
    joined = docs.select(F.struct(*names).alias("row"), F.col(key).cast("bigint").alias("k")).join(gone.hint("merge"), "k", "left").select("row", "gone")

    def delete(batches):
        flat = (pa.RecordBatch.from_arrays([*b.column(0).flatten(), b.column(1)], [*names, "gone"]) for b in batches)
        for part, whole in blocks(flat, at):
            texts, counts = [], []
            for t, was, runs in zip(whole, part.column(at), part.column(len(names)).to_pylist(), strict=True):
                dead: set[int] = set()
                if runs:
                    lines, _, numbers = line_hashes(t)
                    for run in runs:
                        if run["start"] + run["size"] <= len(numbers):
                            dead.update(range(numbers[run["start"]], numbers[run["start"] + run["size"] - 1] + 1))
                    t = "\n".join(x for i, x in enumerate(lines) if i not in dead)
                texts.append(t if was.is_valid else None)
                counts.append(len(dead))
            arrays = [pa.array(texts, part.column(i).type) if i == at else part.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(counts, pa.int64())], [*names, removed])

    return joined.mapInArrow(delete, StructType([*docs.schema.fields, StructField(removed, LongType())]))
