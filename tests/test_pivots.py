"""The pivot index against whole products, and how many blocks it spares."""

import numpy as np

from ferrograph.operators import pivots


def clustered(spark, n=2400, groups=24, length=12, seed=1):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(groups, length))
    rows = [(i, (centres[i % groups] + r.normal(scale=0.04, size=length)).tolist()) for i in range(n)]
    rows[7] = (7, rows[31][1])  # an exact copy
    return rows, spark.createDataFrame([*rows, (n, None), (n + 1, [0.0] * length), (n + 2, [float("nan")] * length), (None, rows[0][1]), (n + 3, [1.0])], "id bigint, v array<double>")


def products(rows):
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    return np.round(np.clip(x @ x.T, -1, 1), 9)


def test_joins_and_top_pairs_on_clusters(spark):
    rows, df = clustered(spark)
    cos = products(rows)
    i, j = np.nonzero(np.triu(cos >= 0.97, 1))
    got = pivots.cosine_pairs(df, "id", "v", 0.97, pivots=32, block=60)
    assert {(x["a"], x["b"]): x["cosine"] for x in got.rows.collect()} == {(a, b): cos[a, b] for a, b in zip(i.tolist(), j.tolist(), strict=True)}
    assert 3 * got.compared < got.possible
    top = pivots.top_pairs(df, "id", "v", 150, pivots=32, block=60)
    i, j = np.triu_indices(len(cos), 1)
    order = np.lexsort((j, i, -cos[i, j]))[:150]
    assert [(x["a"], x["b"], x["cosine"]) for x in top.rows.orderBy("place").collect()] == [(int(i[o]), int(j[o]), cos[i[o], j[o]]) for o in order]
    assert 3 * top.compared < top.possible


def test_searches_on_clusters(spark):
    rows, df = clustered(spark, seed=2)
    cos = products(rows)
    got = pivots.neighbours(df, df.where("id % 20 = 0"), 9, "id", "v", pivots=32, block=60)
    wanted = {}
    for q in range(0, len(rows), 20):
        order = [o for o in np.lexsort((np.arange(len(rows)), -cos[q])) if o != q][:9]
        wanted |= {(q, p + 1): (int(o), cos[q, o]) for p, o in enumerate(order)}
    assert {(x["id"], x["place"]): (x["other"], x["cosine"]) for x in got.rows.collect()} == wanted
    assert 3 * got.compared < got.possible


def test_few_rows_and_none(spark):
    _, df = clustered(spark)
    few = df.where("id < 3")
    assert pivots.top_pairs(few, "id", "v", 10).rows.where("a is null").count() == 0
    assert pivots.neighbours(few, few, 10, "id", "v").rows.count() == 6
    for none in (df.where("false"), df.where("id = 2400")):
        assert pivots.cosine_pairs(none, "id", "v", 0.5).rows.count() == 0 and pivots.top_pairs(none, "id", "v", 5).rows.count() == 0
        assert pivots.neighbours(none, none, 5, "id", "v").rows.count() == 0


def test_a_block_travels_once_a_group_of_blocks(spark):
    rows, df = clustered(spark, n=600)
    index = pivots.pivot_index(df, "id", "v", 8, 20)
    pairs = pivots.near_blocks(index, index).where("a <= b")

    def keep(ids_a, x, ids_b, y):
        return np.array([len(ids_a)]), np.array([len(ids_b)]), np.array([0.0])

    found = pivots.compared(pairs, index, index, keep, pivots.PAIR)
    assert found.count() == pairs.count()
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "ids_a" not in plan and "v_b" not in plan  # no row holds the vectors of both blocks of a pair
