"""Toxicity scores from the nearest labelled examples (operator 1).

A bounded sample of labelled rows is the index: TF-IDF vectors over every term (word, or beginning of a word) that the
sample holds, each term also weighted by how far its frequencies in the two classes lie apart. Document frequencies are
counted over all documents. The inverted lists are cut into blocks of examples, each list with its greatest weight a
block. A query reads the lists that matter, adds the block maxima of the others as a bound, settles examples from the best
bound down, and stops when no bound reaches the k-th best cosine found, so the k nearest are exact. Their distance-weighted votes become
probabilities by a monotone curve, fitted to the votes that each fold of the examples gets from the others.
"""

from __future__ import annotations

import math
import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import blocks, per_text

WORD = re.compile(r"[^\W\d_]+")
BLOCK = 64
#: Length of the beginnings of longer words that are terms beside the words, so that inflected forms meet.
BEGINNING = 5
#: A term's weight is halved where its z between the classes is this (rare and even terms weigh little, none is left out).
HALF_Z = 10.0
FOLDS = 4
#: Share of a cosine's bound that the lists read whole must hold; what the others add is bounded by block.
ESSENTIAL = 0.99


#: The odd multiplier of the hash of a word, what tells beginnings from words, and the mixing constants.
BASE, BEGUN, MIX = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93), (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


@cache
def letters() -> np.ndarray:
    """Which code points are in words."""
    every = "".join(map(chr, range(0xD800))) + "\0" * 0x800 + "".join(map(chr, range(0xE000, 0x110000)))
    table = np.zeros(0x110000, bool)
    for m in WORD.finditer(every):
        table[m.start() : m.end()] = True
    return table


@cache
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, n of each."""
    found = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        found.append(np.multiply.accumulate(p))
    return found[0], found[1]


def hashed_terms(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The text and the 64-bit hash of every word, and of the beginning of every longer word; the words of a block at once, by prefix sums."""
    low = [t.lower() for t in texts]
    codes = np.frombuffer(("\0".join(low) + "\0").encode("utf-32-le"), np.uint32)
    inside = np.concatenate([[False], letters()[codes], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[0::2], edges[1::2]
    owner = np.searchsorted(np.cumsum([len(t) + 1 for t in low]), start, side="right")
    up, down = powers(1 << int(len(codes)).bit_length())
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[: len(codes)])])

    def mixed(first: np.ndarray, last: np.ndarray) -> np.ndarray:
        x = (sums[last] - sums[first]) * down[first]
        x = (x ^ (x >> np.uint64(30))) * MIX[0]
        x = (x ^ (x >> np.uint64(27))) * MIX[1]
        return x ^ (x >> np.uint64(31))

    longer = end - start > BEGINNING
    return np.concatenate([owner, owner[longer]]), np.concatenate([mixed(start, end), mixed(start[longer], start[longer] + BEGINNING) ^ BEGUN])


class Terms:
    """Texts as (terms, counts); a term is its 64-bit hash, or its place in `vocabulary` (sorted), others left out."""

    def __init__(self, vocabulary: np.ndarray | None = None):
        self.vocabulary = vocabulary

    def counted(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, term and count of each distinct term of each text, text after text."""
        owner, terms = hashed_terms(texts)
        if self.vocabulary is None:
            order = np.lexsort((terms, owner))
            owner, terms = owner[order], terms[order]
            first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (terms[1:] != terms[:-1])])) if len(terms) else np.zeros(0, np.int64)
            return owner[first], terms[first], np.diff(np.append(first, len(terms)))
        size = max(1, len(self.vocabulary))
        place = np.searchsorted(self.vocabulary, terms)
        known = place < len(self.vocabulary)
        known[known] = self.vocabulary[place[known]] == terms[known]
        keys, counts = np.unique(owner[known] * size + place[known], return_counts=True)
        return keys // size, keys % size, counts

    def each(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(terms, counts) of each text."""
        owner, terms, counts = self.counted(texts)
        cuts = np.searchsorted(owner, np.arange(1, len(texts)))
        return list(zip(np.split(terms, cuts), np.split(counts, cuts), strict=True))

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        return self.each([text])[0]


class Rows:
    """Examples' terms (places in the vocabulary) and counts, one row after another."""

    def __init__(self, first: np.ndarray, terms: np.ndarray, counts: np.ndarray):
        self.first, self.terms, self.counts = first, terms.astype(np.int32), counts.astype(np.int32)

    def of(self, which: np.ndarray) -> Rows:
        size = self.first[which + 1] - self.first[which]
        places, _ = spread(self.first[which], self.first[which + 1], which)
        return Rows(np.concatenate([[0], np.cumsum(size)]).astype(np.int64), self.terms[places], self.counts[places])

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1, dtype=np.int32), np.diff(self.first))


def relevance(rows: Rows, labels: np.ndarray, size: int) -> np.ndarray:
    """z * z / (z * z + HALF_Z ** 2) of each term: z is the distance of its document frequencies in the classes, in standard errors."""
    of = labels[rows.owners()]
    d = [np.bincount(rows.terms[of == c], minlength=size) for c in (0, 1)]
    n = [max(1, int((labels == c).sum())) for c in (0, 1)]
    p = (d[0] + d[1]) / max(1, len(labels))
    z2 = (d[1] / n[1] - d[0] / n[0]) ** 2 / (p * (1 - p) * (1 / n[0] + 1 / n[1]) + 1e-12)
    return z2 / (z2 + HALF_Z**2)


def spread(first: np.ndarray, end: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the ranges first to end, one range after another, and the range's value at each."""
    size = end - first
    return np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum()), np.repeat(values, size)


class Index:
    """Labelled examples with block-max inverted lists."""

    def __init__(self, names: np.ndarray, labels: np.ndarray, rows: Rows, idf: np.ndarray, prior: float, k: int, curve: tuple | None = None):
        """rows: the examples' terms; idf: of each term; prior: share of label 1 among all labelled rows; curve: from votes to P(label 1)."""
        self.made_of = (names, labels, rows, idf, prior, k)
        self.curve = curve or (np.zeros(1), np.full(1, prior))
        self.k, self.prior = k, prior
        self.weight = idf * relevance(rows, labels, len(idf))
        owners = rows.owners()
        weights = (1 + np.log(rows.counts)) * self.weight[rows.terms]
        length = np.sqrt(np.bincount(owners, weights * weights, len(labels)))
        weights /= np.where(length > 0, length, 1)[owners]
        by = np.lexsort((rows.terms, -weights, owners))  # each example's heaviest term comes first
        empty = np.diff(rows.first) == 0
        heavy = np.full(len(labels), -1)
        heavy[~empty] = rows.terms[by[rows.first[:-1][~empty]]]
        order = np.lexsort((names, heavy, labels))  # examples alike share blocks
        self.names, self.labels, self.blocks = names[order], labels[order], max(1, -(-len(labels) // BLOCK))
        # the examples' own vectors, one after another
        own = rows.of(order)
        self.row, self.row_terms = own.first, own.terms
        self.row_weights = weights[spread(rows.first[order], rows.first[order + 1], order)[0]].astype(np.float32)
        # the inverted lists, term after term
        docs = own.owners()
        by = np.lexsort((docs, self.row_terms))
        self.docs, self.weights, terms = docs[by].astype(np.int64), self.row_weights[by], self.row_terms[by]
        self.start = np.searchsorted(terms, np.arange(len(idf) + 1))
        self.greatest, self.query = np.zeros(len(idf), np.float32), np.zeros(len(idf))
        np.maximum.at(self.greatest, terms, self.weights)
        # a slot is a pair of term and block that holds postings, with the greatest weight among them
        slot = terms.astype(np.int64) * self.blocks + self.docs // BLOCK
        first = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]])) if len(slot) else np.zeros(0, np.int64)
        self.top = np.maximum.reduceat(self.weights, first) if len(first) else np.zeros(0, np.float32)
        self.slot_block = (slot[first] % self.blocks).astype(np.int32)
        self.slots = np.searchsorted(slot[first] // self.blocks, np.arange(len(idf) + 1))

    def __reduce__(self):
        """Only what it is made of travels; the lists are made again where it arrives."""
        return Index, (*self.made_of, self.curve)

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        weights = (1 + np.log(counts)) * self.weight[terms]
        length = math.sqrt(float(weights @ weights))
        return terms, weights / length if length else weights

    def nearest(self, terms: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of greatest cosine (ties: the earlier one) and the cosines; fewer where no more have one above 0.

        Lists that may add much are read whole; the others, most of them long, only bound what they may add to a block's
        examples. Examples are then settled on their own vectors from the best bound down, until none left can be nearer.
        """
        if not len(terms) or not len(self.labels):
            return np.zeros(0, np.int64), np.zeros(0)
        most = weights * self.greatest[terms]
        by = np.argsort(-most, kind="stable")
        upto = np.cumsum(most[by])
        cut = int(np.searchsorted(upto, ESSENTIAL * upto[-1])) + 1
        long, short = by[cut:], by[:cut]
        places, own = spread(self.start[terms[short]], self.start[terms[short] + 1], weights[short])
        bound = np.bincount(self.docs[places], own * self.weights[places], self.blocks * BLOCK)
        slots, own = spread(self.slots[terms[long]], self.slots[terms[long] + 1], weights[long])
        bound += np.repeat(np.bincount(self.slot_block[slots], own * self.top[slots], self.blocks), BLOCK)
        bound = bound[: len(self.labels)]
        self.query[terms] = weights
        seen, score, least = np.zeros(0, np.int64), np.zeros(0), 0.0
        now = np.argpartition(-bound, self.k)[: self.k] if self.k < len(bound) else np.arange(len(bound))
        while len(now):
            places, which = spread(self.row[now], self.row[now + 1], np.arange(len(now)))
            exact = np.bincount(which, self.query[self.row_terms[places]] * self.row_weights[places], len(now))
            bound[now] = -1  # settled
            seen, score = np.concatenate([seen, now]), np.concatenate([score, exact])
            best = np.lexsort((seen, -np.round(score, 9)))
            best = best[score[best] > 0][: self.k]
            seen, score = seen[best], score[best]
            least = score[-1] - 1e-9 if len(seen) == self.k else 0.0
            now = np.flatnonzero((bound > 0) & (bound >= least))
            now = now[np.argsort(-bound[now], kind="stable")[: 4 * self.k]]
        self.query[terms] = 0
        return seen, score

    def vote(self, found: np.ndarray, cosine: np.ndarray) -> float:
        """Log-odds of the distance-weighted share of label 1, with the prior as one more neighbour."""
        weight = cosine / (0.05 + 1 - np.minimum(cosine, 1))
        share = (float(weight @ self.labels[found]) + 0.2 * self.prior) / (float(weight.sum()) + 0.2)
        share = min(max(share, 1e-6), 1 - 1e-6)
        return math.log(share / (1 - share))

    def score(self, terms: np.ndarray, counts: np.ndarray) -> tuple[float, str]:
        """P(label 1), and its evidence: id, label and cosine of the nearest three examples."""
        found, cosine = self.nearest(*self.vector(terms, counts))
        shown = " ".join(f"{self.names[i]}:{self.labels[i]}:{c:.3f}" for i, c in zip(found[:3].tolist(), cosine[:3].tolist(), strict=True))
        return float(np.interp(self.vote(found, cosine), *self.curve)), shown


def monotone(x: np.ndarray, y: np.ndarray, w: np.ndarray, prior: float, least: int = 15) -> tuple[np.ndarray, np.ndarray]:
    """A rising curve of P(label 1) over x: runs of `least` rows, pooled while they fall, each pool drawn to the prior by one row's weight."""
    order, pools = np.argsort(x, kind="stable"), []
    for run in np.array_split(order, max(1, len(order) // least)):
        pools.append(np.array([w[run].sum(), (w[run] * y[run]).sum(), (w[run] * x[run]).sum()]))
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            last = pools.pop()
            pools[-1] = pools[-1] + last
    one = float(w.mean())
    at = np.array([p[2] / p[0] for p in pools])
    value = np.maximum.accumulate([(p[1] + one * prior) / (p[0] + one) for p in pools])
    # rising beyond both ends too, so that different votes give different scores
    at = np.concatenate([[min(at[0], -14.0) - 1e-3], at, [max(at[-1], 14.0) + 1e-3]])
    return at, np.concatenate([[value[0] * 0.5], value, [(value[-1] + 1) / 2]])


def fitted(names: np.ndarray, labels: np.ndarray, rows: Rows, idf: np.ndarray, prior: float, k: int) -> Index:
    """The index with its curve: each fold (by place in the order of names) is voted on by an index of the others."""
    curve = None
    if len(labels) and labels.min() != labels.max():
        votes, fold = np.zeros(len(labels)), np.argsort(np.argsort(names, kind="stable"), kind="stable") % FOLDS
        for f in range(FOLDS):
            rest = np.flatnonzero(fold != f)
            other = Index(names[rest], labels[rest], rows.of(rest), idf, prior, k)
            for i in np.flatnonzero(fold == f).tolist():
                own = slice(rows.first[i], rows.first[i + 1])
                votes[i] = other.vote(*other.nearest(*other.vector(rows.terms[own], rows.counts[own])))
        weight = np.where(labels == 1, prior / labels.mean(), (1 - prior) / (1 - labels.mean()))
        curve = monotone(votes, labels, weight, prior)
    return Index(names, labels, rows, idf, prior, k, curve)


def build_index(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, examples: int, k: int) -> tuple[np.ndarray, Index]:
    """The vocabulary (sorted hashes of all terms of the examples) and the index over at most `examples` labelled rows of each class.

    Rows are chosen by a hash of the id. The document frequencies of the vocabulary are counted over all documents in
    Spark; the driver gets the examples' hashed terms and one count a term, which the number of examples bounds.
    """
    spark = docs.sparkSession
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.max(label).cast("int").alias("y"))
    shares = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    prior = shares.get(1, 0) / max(1, sum(shares.values()))
    chosen = [r for y in (0, 1) for r in known.where(F.col("y") == y).orderBy(F.xxhash64("id", F.lit(7)), "id").limit(examples).collect()]
    none = np.zeros(0, np.int64)
    if not chosen:
        return none, Index(none, none, Rows(np.zeros(1, np.int64), none, none), np.zeros(0), prior, k)
    few = spark.createDataFrame([(r["id"], r["y"]) for r in chosen], "id bigint, y int")
    every = docs.select(F.col(key).alias("id"), F.col(text).alias("t"))

    def counted(batches):
        terms = Terms()
        for batch, whole in blocks(batches, 2):
            found = terms.each(whole)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([t.view(np.int64) for t, _ in found], pa.list_(pa.int64())), pa.array([c for _, c in found], pa.list_(pa.int64()))], ["id", "y", "terms", "counts"])

    sample = every.join(F.broadcast(few), "id").select("id", "y", "t").mapInArrow(counted, "id bigint, y int, terms array<bigint>, counts array<bigint>").toArrow().sort_by("id")
    names, ys = np.asarray(sample["id"], np.int64), np.asarray(sample["y"], np.int64)
    lists = sample["terms"].combine_chunks()
    first = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()))]).astype(np.int64) if len(names) else np.zeros(1, np.int64)
    vocabulary, places = np.unique(np.asarray(lists.flatten(), np.int64).view(np.uint64), return_inverse=True)
    rows = Rows(first, places, np.asarray(sample["counts"].combine_chunks().flatten()))
    del sample, lists, places
    shared = spark.sparkContext.broadcast(vocabulary)

    def frequencies(batches):
        terms, found, n = Terms(shared.value), np.zeros(len(shared.value), np.int64), 0
        for _, whole in blocks(batches, 1):
            n += len(whole)
            found += np.bincount(terms.counted(whole)[1], minlength=len(found))
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(found[at], n))], ["term", "n"])

    df = every.mapInArrow(frequencies, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    at, n = np.asarray(df["term"], np.int64), np.asarray(df["n"], np.float64)
    count = np.zeros(len(vocabulary) + 1)  # the last place holds the number of documents
    count[at] = n
    idf = np.log((count[-1] + 1) / (count[:-1] + 0.5))
    return vocabulary, fitted(names, ys, rows, idf, prior, k)


def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", threshold: float = 0.7, examples: int = 1200, k: int = 31) -> DataFrame:
    """Per document: key, score (P(label 1), also for null and empty texts), predicted (1 if score >= threshold), evidence.

    `labels` holds the rows to learn from; unlabelled and repeated ids are no trouble (a repeated id counts once, with
    its greatest label; documents that share it are examples each). Without labelled rows every score is 0. Only the
    texts of the chosen examples, document frequencies and a document's own text enter its score. Other columns are
    ignored; repeated rows are scored each by itself. The index holds the whole vocabulary of at most 2 * examples
    labelled ids and is broadcast; documents are read twice (frequencies, scores), and only counts are shuffled.
    """
    index = docs.sparkSession.sparkContext.broadcast(build_index(docs, labels, key, text, label, examples, k))
    readers: list[Terms] = []

    def work(texts: list[str]) -> list[list]:
        vocabulary, known = index.value
        if not readers:
            readers.append(Terms(vocabulary))
        found = [known.score(*t) for t in readers[0].each(texts)]
        return [[s for s, _ in found], [int(s >= threshold) for s, _ in found], [e for _, e in found]]

    return per_text(docs, [key], text, "score double, predicted int, evidence string", work)
