"""The vector similarity join: its bound against all pairs, and what its tasks hold."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ferrograph.operators import similarity


def pack(vectors, labels, first=0):
    return pa.StructArray.from_arrays([pa.array(range(first, first + len(vectors)), pa.int64()), pa.array(labels, pa.string()), pa.array(vectors, pa.list_(pa.float32()))], ["id", "l", "v"])


def sides(kind, seed, n=150, length=64):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(6, length))
    made = []
    for first in (0, 1000):
        v = r.normal(size=(n, length)) if kind == "random" else centres[r.integers(6, size=n)] + r.normal(scale=0.8, size=(n, length))
        vectors = [x.tolist() for x in v * r.uniform(0.1, 9, size=(n, 1))]
        vectors[3], vectors[4], vectors[5] = [0.0] * length, None, [-1.0] * length
        if kind == "lengths":
            vectors[6:40] = [x[:40] for x in vectors[6:40]]
        if kind == "odd":
            vectors[6], vectors[7] = [float("nan")] * length, [3e38] * length
        made.append(pack(vectors, [None if k == 9 else str(k) for k in r.integers(10, size=n)], first))
    return made


@pytest.mark.parametrize("least", [-1.0, 0.3, 0.55, 0.9])
@pytest.mark.parametrize("kind", ["random", "clusters", "lengths", "odd"])
def test_bound_leaves_every_pair_that_may_reach_the_score(kind, least):
    x, y = sides(kind, 3)
    for p, q, left, right in ((0, 1, x, y), (0, 0, x, x)):
        wanted = set()
        for a, b, score, paired in similarity.tiles(p, q, left, right, 64):
            i, j = np.nonzero((score >= least) & paired)
            wanted |= {(min(k), max(k)) for k in zip(a[i].tolist(), b[j].tolist(), strict=True)}
        one, two = similarity.Side.both(left, right)
        got = [(min(k), max(k)) for i, j in similarity.candidates(one, two, p == q, least, 64) for k in zip(one.id[i].tolist(), two.id[j].tolist(), strict=True)]
        assert len(got) == len(set(got)) and wanted <= set(got)
        assert wanted if least < 0.5 or kind != "random" else True


def test_bound_leaves_few_pairs_of_random_vectors():
    x, y = similarity.Side.both(*sides("random", 4, n=1500))
    assert sum(len(i) for i, _ in similarity.candidates(x, y, False, similarity.CANDIDATE, 512)) < 0.01 * 1500 * 1500


@pytest.mark.parametrize("most", [10, 25, 1000])
def test_each_pair_of_packs_once_and_packs_of_bounded_size(spark, most):
    df = spark.range(100).select(F.col("id").alias("k"), F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("v"), F.lit("a").alias("l"))
    pairs, _ = similarity.packed_classes(df, "k", "v", "l", 4, most)
    assert pairs.schema["p_rows"].dataType.elementType["v"].dataType.elementType.typeName() == "float"
    got = pairs.select("p", "q", F.transform("p_rows", lambda r: r["id"]).alias("x"), F.transform("q_rows", lambda r: r["id"]).alias("y")).collect()
    seen = sorted((min(a, b), max(a, b)) for r in got for a in r["x"] for b in r["y"] if r["p"] != r["q"] or a < b)
    assert seen == [(a, b) for a in range(100) for b in range(a + 1, 100)]
    per = [sum(r["p"] == p for r in got) for p in {r["p"] for r in got}]
    assert max(per) - min(per) <= 1
