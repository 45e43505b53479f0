"""Vector codes, the prefix trie and the n-gram join against brute force, and on rows that are hard."""

import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ferrograph.llm import codes, ngrams, trie
from ferrograph.llm.ngrams import ngram_groups
from ferrograph.llm.queries import op12_prefix_trie


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int, code string, id int")


def compressed(rows, entries=64, rounds=2, positions=16):
    """Plain Lloyd: every part compared with every entry, smallest key first, integers throughout."""
    kept = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    length = max(len(v) for _, v, _ in kept)
    width = -(-length // positions)
    kept = [(i, v + [0] * (width * positions - len(v)), y) for i, v, y in kept]
    first = {}
    for i, v, _ in sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        first.setdefault(i, v)
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for v in list(first.values())[:entries]] for p in range(positions)]

    def assigned():
        return [[min((sum((a - b) ** 2 for a, b in zip(cut(v, p), e, strict=True)), k) for k, e in enumerate(books[p])) for p in range(positions)] for _, v, _ in kept]

    for _ in range(rounds):
        found = assigned()
        for p in range(positions):
            for k in range(len(books[p])):
                mine = [cut(v, p) for (_, v, _), f in zip(kept, found, strict=True) if f[p][1] == k]
                if mine:
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    found = assigned()
    errors = [sum(d for d, _ in f) for f in found]
    name = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    by_label = {}
    for (_, _, y), e in zip(kept, errors, strict=True):
        by_label[y] = by_label.get(y, 0) + e
    return sorted(str((i, "".join(f"{k:02x}" for _, k in f), e, by_label[y], name)) for (i, _, y), f, e in zip(kept, found, errors, strict=True))


def got_codes(df):
    return sorted(str(tuple(r)) for r in df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect())


@pytest.mark.parametrize("length", [32, 20])
def test_codes_against_plain_lloyd(spark, length):
    r = random.Random(length)
    centres = [[r.uniform(-2, 2) for _ in range(length)] for _ in range(7)]
    rows = [(i * 3 % 301, [x + r.gauss(0, 0.3) for x in r.choice(centres)], r.choice([None, 0, 1, 2])) for i in range(300)]
    rows += [(5, rows[5][1], 1), (5, rows[5][1], 1), (7, rows[9][1], None)]  # repeated rows, and a key with two vectors
    rows += [(900, None, 1), (901, [None] * length, 1), (902, [float("nan")] * length, 1), (903, [float("inf")] * length, 2), (None, rows[3][1], 0)]
    rows += [(904, [], 1), (905, [1.5, -0.25], None), (906, [-0.001] * length, 3)]
    df = vectors(spark, [(*x, "c", 1) for x in rows]).repartition(3)
    assert got_codes(codes.compress(df, entries=16)) == compressed(rows, entries=16)


def test_codes_with_few_rows_ties_and_none(spark):
    rows = [(i, [0.5] * 16, None) for i in range(5)]
    assert got_codes(codes.compress(vectors(spark, [(*x, "", 0) for x in rows]))) == compressed(rows)
    one = [(1, [1.0] * 16, 2)]
    assert got_codes(codes.compress(vectors(spark, [(*x, "", 0) for x in one]))) == compressed(one)
    for none in ([], [(1, None, 1, "", 0)]):
        out = codes.compress(vectors(spark, none))
        assert out.count() == 0 and out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_heaps_pop_only_what_drift_violates():
    r = np.random.default_rng(3)
    centres = r.integers(-2000, 2000, (8, 4))
    parts = (centres[r.integers(0, 8, 600)] + r.integers(-90, 90, (600, 4))).astype(np.int64)
    books = codes.Codebooks(centres[None].astype(np.int64))
    assigned = np.zeros(600, np.int64)
    heaps = codes.Heaps.of(parts, books.entries[0], books.drift[0], assigned)
    for _ in range(4):
        sums = np.zeros((1, 8, 4), np.int64)
        np.add.at(sums[0], assigned, parts)
        books = books.moved(sums, np.bincount(assigned, minlength=8)[None])
        heaps, popped = heaps.settle(parts, books.entries[0], books.drift[0], assigned)
        assert popped < 200  # the bounds of most parts hold
        assert (assigned == codes.square_distances(parts, books.entries[0]).argmin(1)).all()
        ends = np.cumsum(heaps.sizes)
        for e in range(8):
            keys = heaps.keys[ends[e] - heaps.sizes[e] : ends[e]]
            assert all(keys[(k - 1) // 2] <= keys[k] for k in range(1, len(keys)))
            assert (assigned[heaps.which[ends[e] - heaps.sizes[e] : ends[e]]] == e).all()


def test_distances_of_large_components():
    r = np.random.default_rng(4)
    most = codes.bound_of(4, 16)
    x, y = (r.integers(-most, most, (5, 4)) for _ in range(2))
    assert codes.square_distances(x, y).tolist() == [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, q, strict=True)) for q in y] for p in x]
    made = codes.whole_numbers(pa.array([[1e30, -1e30]]), 2, 256, most)
    assert made.tolist() == [[most, -most]]


def nodes_of(rows):
    turns = {}
    for c, t, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append(((t is not None, t or 0), hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest(), (role or "", text or "")))
    own = {c: [x[2] for x in sorted(v)] for c, v in turns.items()}
    made = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + mine[h:]
    members, ends = {}, {}
    for c, seq in made.items():
        for d in range(len(seq) + 1):
            members.setdefault(tuple(seq[:d]), []).append(c)
        ends.setdefault(tuple(seq), []).append(c)
    kids = {}
    for path in members:
        if path:
            kids.setdefault(path[:-1], []).append(path)
    out = []
    sums = {}
    for path in sorted(members, key=len, reverse=True):
        below = [sums[k] for k in kids.get(path, [])]
        saved = (len(members[path]) - 1) * len(path[-1][1].encode()) if path else 0
        sums[path] = (sum(x[0] for x in below) if below else 1, saved + sum(x[1] for x in below))
        sha = hashlib.sha256(",".join(map(str, sorted(ends.get(path, [])))).encode()).hexdigest()
        out.append((min(members[path]), len(path), min(members[path[:-1]]) if path else None, len(members[path]), len(kids.get(path, [])), *sums[path], sha))
    return sorted(map(str, out))


def test_trie_against_brute_force(spark, tmp_path):
    r = random.Random(2)
    lines = ["", None, "one", "two é", "three 😀"]
    rows = [(c, r.choice([None, *range(12)]) if c % 7 == 0 else t, r.choice(["user", "assistant", None]) if r.random() < 0.2 else "user", r.choice(lines)) for c in [*range(90), -3, -10] for t in range(r.randint(1, 14)) if c % 11]
    rows += [(c, t, "user", f"common {t}") for c in range(200, 290, 3) for t in range(11)]  # many alike, whole
    rows += [(c, t, "user", "same") for c in (400, 401, 402, 405, 406) for t in range(18)]  # long ones, alike or nearly
    rows += [(405, 18, "user", "last"), (406, 19, "user", "other"), (None, 1, "user", "nobody's")] + [(407, 0, "user", "x")] * 3
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("depth", F.lit(1)).repartition(4).write.parquet(f"{tmp_path}/conversations.parquet")
    out = op12_prefix_trie(spark, str(tmp_path))
    got = out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()
    assert sorted(str(tuple(x)) for x in got) == nodes_of(rows)


def test_trie_of_nothing_and_of_turnless_ones(spark, tmp_path):
    schema = "conv_id bigint, turn bigint, role string, text string"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/a/conversations.parquet")
    assert op12_prefix_trie(spark, f"{tmp_path}/a").count() == 0
    rows = [(c, 0, "u", "x") for c in range(1, 40) if c % 5 and zlib.crc32(str(c).encode()) % 9]  # bases absent, one turn each
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/b/conversations.parquet")
    got = op12_prefix_trie(spark, f"{tmp_path}/b").collect()
    assert sorted(str(tuple(x)) for x in got) == nodes_of(rows) and len(got) == 1


def test_a_conversation_that_crosses_ranges(spark):
    """A third of all rows in one conversation: numbered by parts, with carries."""
    rows = [(7, t, "u", "é" * (t % 3)) for t in range(3000)] + [(c, t, "u", "x") for c in range(100, 700) for t in range(10)]
    steps, convs = trie.placed(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(5))
    mine = steps.where("c = 7").orderBy("i").select("i", "cum").collect()
    assert [x["i"] for x in mine] == list(range(1, 3001))
    assert [x["cum"] for x in mine] == np.cumsum([2 * (t % 3) for t in range(3000)]).tolist()
    assert {tuple(x) for x in convs.where("c in (7, 100)").collect()} == {(7, 3000, 6000), (100, 10, 10)}


def test_lists_of_ids_longer_than_a_piece(spark):
    rows = [(1, c) for c in range(5000)] + [(2, c) for c in range(10, 12)] + [(3, -5)]
    got = {x["rep"]: x["sha"] for x in trie.ids_hashed(spark.createDataFrame(rows, "rep bigint, c bigint").repartition(3)).collect()}
    for rep in (1, 2, 3):
        assert got[rep] == hashlib.sha256(",".join(str(c) for r, c in sorted(rows) if r == rep).encode()).hexdigest()


def grams(text, size):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for blank in "\t\n\v\f\r":
        words = words.replace(blank, " ")
    words = [w for w in words.split(" ") if w]
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def groups_of(texts, size, percent):
    sets = {i: grams(t, size) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def documents(spark, texts):
    return spark.createDataFrame([(i, t, 3, 4) for i, t in texts.items()], "doc_id bigint, text string, n int, id int")


@pytest.mark.parametrize(("size", "percent"), [(4, 85), (5, 80), (2, 60)])
def test_ngrams_against_all_pairs(spark, size, percent):
    r = random.Random(size)
    pool = [f"w{i}" for i in range(400)]
    texts = {}
    for g in range(14):
        base = r.choices(pool, k=r.choice([3, 12, 40, 120]))
        for _ in range(r.choice([1, 2, 9, 14])):
            words = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 3])):
                words[r.randrange(len(words))] = r.choice(pool)
            texts[len(texts)] = r.choice([" ", "\n"]).join(w.upper() if r.random() < 0.3 else w for w in words)
    common = r.choices(pool, k=60)
    for _ in range(60):  # one common passage makes up most of unlike texts
        texts[len(texts)] = " ".join([*r.choices(pool, k=r.randint(2, 30)), *common])
    texts |= {1000: None, 1001: "", 1002: " \t", 1003: "one two", 1004: "ONE  two", 1005: "one"}
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in ngram_groups(documents(spark, texts).repartition(3), size=size, percent=percent).collect()}
    assert got == groups_of(texts, size, percent)


def test_a_crowd_around_common_text(spark):
    """Many near copies, of which the least is far from most: later rounds find the rest."""
    r = random.Random(9)
    base = [f"b{i}" for i in range(90)]
    texts = {}
    for i in range(260):
        words = list(base)
        for k in r.sample(range(90), r.choice([1, 2, 3])):
            words[k] = f"own{i}x{k}"
        texts[i] = " ".join(words)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in ngram_groups(documents(spark, texts), size=4, percent=85).collect()}
    assert got == groups_of(texts, 4, 85)


def test_rows_of_ngrams_that_are_hard(spark):
    long = " ".join(f"w{i * 7919 % 5003}" for i in range(400_000))  # more than two blocks
    rows = [(None, "a b c d e"), (1, "a b c d e"), (2, "a b c d e"), (2, "a b c d e"), (3, long), (4, long + " x"), (5, None), (None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("component_id", F.lit("c"))
    out = [tuple(x) for x in ngram_groups(df, size=4, percent=85).collect()]
    assert len(long) > 2_000_000 and sorted(map(str, out)) == sorted(map(str, [(None, 2, None), (1, 2, 1), (2, 2, 1), (2, 2, 1), (3, 5003, 3), (4, 5004, 3), (5, 0, 5), (None, 0, None)]))
    assert ngram_groups(df.where("false")).count() == 0


def test_pieces_cut_large_buckets():
    tokens = [1, 1, 2, 2, 2, 2, 2, 2, 2, 3, 4, 4]
    batches = [pa.RecordBatch.from_arrays([pa.array(tokens[i : i + 3]), pa.array(range(i, i + 3))], ["t", "k"]) for i in range(0, 12, 3)]
    out = [(c[0].tolist(), front, back) for c, front, back in ngrams.pieces(iter(batches), most=4)]
    assert [t for c, _, _ in out for t in c] == tokens
    assert out == [([1, 1], False, False), ([2, 2, 2, 2, 2, 2, 2], True, True), ([3, 4, 4], True, False)] or [x[0][0] for x in out if x[1] or x[2]].count(2) >= 1
    assert all(front or back for c, front, back in out if len(c) > 4 or c[0] == 2)


def test_a_common_token_is_dealt_over_buckets(spark, monkeypatch):
    """With a small bound every token of a crowd is salted; the hubs of its parts still meet."""
    monkeypatch.setattr(ngrams, "SALTED", 2)
    r = random.Random(1)
    base = [f"b{i}" for i in range(60)]
    texts = {i: " ".join([*base[: r.randint(50, 60)], f"own{i}"]) for i in range(40)}
    table = np.full(ngrams.CELLS, 11)
    kept, rest = ngrams.first_tokens(np.arange(1, 9, dtype=np.uint64) << np.uint64(8), table, 1.0, 85, 6)
    assert len(kept) == 2 and ((kept & np.uint64(255)) == 1 + 6 % 5).all() and rest.tolist() == [8, 7]
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in ngram_groups(documents(spark, texts), size=4, percent=85).collect()}
    assert got == groups_of(texts, 4, 85)
