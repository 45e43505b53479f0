import random

import pytest
from pyspark.sql import functions as F

from ferrograph.functions import scalars
from ferrograph.operators import diffs, expressions, graphs, quality, series, similarity, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def model_components(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {x: min(y for y in parent if root(y) == root(x)) for x in parent}


@pytest.mark.parametrize("seed", range(3))
def test_components_match_a_model(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 130)]
    edges = [e for e in edges if e[0] != e[1]]
    found = graphs.components(spark.createDataFrame(edges, "a bigint, b bigint"))
    assert {x["node"]: x["component"] for x in found.collect()} == model_components(edges)


def test_components_of_every_line(spark):
    from ferrograph import plans

    sf = "/root/testdata/sf0.001"
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr("l_orderkey", "l_partkey + 1000000000 as p").distinct().collect()
    found = {x["node"]: x["component"] for x in plans.queries()["components"](spark, sf).collect()}
    above = {}

    def root(x):
        while above.setdefault(x, x) != x:
            above[x] = above[above[x]]
            x = above[x]
        return x

    for a, b in lines:
        x, y = sorted((root(a), root(b)))
        above[y] = x
    assert found == {x: root(x) for x in above}


def test_components_of_no_edges(spark):
    assert graphs.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_spanning_forest_has_the_greatest_weight(spark):
    r = random.Random(4)
    edges = {(a, b): r.randrange(1000) for a in range(12) for b in range(a + 1, 12) if r.random() < 0.4}
    found = graphs.spanning_forest(spark.createDataFrame([(a, b, float(w)) for (a, b), w in edges.items()], "a bigint, b bigint, w double")).collect()
    seen, total = {}, 0

    def root(x):
        seen.setdefault(x, x)
        while seen[x] != x:
            x = seen[x]
        return x

    for (a, b), w in sorted(edges.items(), key=lambda e: -e[1]):
        if root(a) != root(b):
            seen[root(a)] = root(b)
            total += w
    assert sum(x["w"] for x in found) == total


def test_spanning_forest_of_unlike_vectors(spark, tmp_path):
    from ferrograph import plans

    rows = [(0, [1.0, -1.0], 1), (50, [-1.0, 1.0], 2), (90, [1.0, -1.0], 1)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = {(x["a"], x["b"]): x["w"] for x in plans.queries()["spanning_forest"](spark, str(tmp_path)).collect()}
    assert found == pytest.approx({(0, 90): 0.99, (0, 50): -0.25})


def test_cycles_and_reachability(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 5)], "a bigint, b bigint")
    assert sorted(x["path"] for x in graphs.cycles(edges, 4).collect()) == [[1, 2, 3], [5]]
    reach = graphs.reachable(edges, spark.createDataFrame([(2,)], "node bigint")).collect()
    assert {x["node"]: x["depth"] for x in reach} == {2: 0, 3: 1, 1: 2, 4: 2}


@pytest.mark.parametrize(
    ("scores", "kind", "score"),
    [
        ({"semantic": 0.90, "fingerprint": 0.82, "embedding": 0.88}, "strict", 0.851),
        ({"semantic": 0.88}, "semantic", 0.88),
        ({"fingerprint": 0.40, "center": 0.0}, "none", None),
        ({"semantic": 0.75}, "semantic", 0.75),
    ],
)
def test_gold_cases_of_hybrid_edges(spark, scores, kind, score):
    rows = [(2, 1, k, v) for k, v in scores.items()]
    got = similarity.hybrid_edges(spark.createDataFrame(rows, "a bigint, b bigint, component string, score double")).first()
    assert (got["a"], got["b"], got["class"]) == (1, 2, kind)
    assert score is None or got["score"] == pytest.approx(score)


def test_tanimoto_links_against_all_pairs(spark):
    r = random.Random(1)
    sets = {i: sorted({r.randrange(12) for _ in range(r.randrange(0, 8))}) for i in range(60)}
    got = similarity.tanimoto_links(spark.createDataFrame(list(sets.items()), "id bigint, s array<bigint>"), "id", "s", 60)
    for x in got.collect():
        s = set(sets[x["id"]])
        n = sum(1 for j, t in sets.items() if j != x["id"] and s and 100 * len(s & set(t)) >= 60 * len(s | set(t)))
        assert x["n_links"] == n
        assert x["class_id"] == min(j for j, t in sets.items() if t == sets[x["id"]])


def test_links_between_users_from_a_tanimoto_of_40(spark, tmp_path):
    from ferrograph import plans

    r = random.Random(12)
    events = [(u, f"2024-03-{r.randrange(1, 6):02d} 10:00:00", r.choice(["view", "error"])) for u in range(25) for _ in range(r.randrange(1, 8))]
    spark.createDataFrame(events, "user_id bigint, at string, event_type string").selectExpr("user_id", "cast(at as timestamp) as ts", "event_type").write.parquet(f"{tmp_path}/events.parquet")
    sets = {u: {(t, e) for v, t, e in events if v == u} for u, _, _ in events}
    links = {u: sum(10 * len(s & t) >= 4 * len(s | t) for v, t in sets.items() if v != u) for u, s in sets.items()}
    found = {n: {x["user_id"]: x["n_links"] for x in plans.queries()[n](spark, str(tmp_path)).collect()} for n in ("tanimoto_links",)}
    assert found["tanimoto_links"] == links


def test_neighbours_of_small_blocks(spark):
    r = random.Random(2)
    rows = [(i, [r.random() - 0.5 for _ in range(4)]) for i in range(40)] + [(40, [0.0] * 4), (41, None)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = similarity.top_neighbours(df, df.where("vec_id % 20 = 0"), 3, block=7).collect()

    def cos(a, b):
        return sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5)

    for q in (0, 20):
        best = sorted(((-round(cos(rows[q][1], v), 9), i) for i, v in rows[:40] if i != q))[:3]
        assert [(x["other"]) for x in sorted(got, key=lambda x: x["place"]) if x["vec_id"] == q] == [i for _, i in best]


@pytest.mark.parametrize("metric", ["l2", "inner_product"])
def test_searches_by_metric_and_condition(spark, metric):
    r = random.Random(6)
    rows = [(i, [r.random() - 0.5 for _ in range(4)], i % 3) for i in range(50)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    got = similarity.top_neighbours(df, df.where("vec_id % 20 = 0"), 3, block=7, metric=metric, where=[F.col("label") != 1]).collect()
    far = {"l2": lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True)) ** 0.5, "inner_product": lambda a, b: -sum(x * y for x, y in zip(a, b, strict=True))}[metric]
    best = {(q, p + 1): (i, d) for q in (0, 20, 40) for p, (d, i) in enumerate(sorted((round(far(rows[q][1], v), 9), i) for i, v, label in rows if i != q and label != 1)[:3])}
    assert {(x["vec_id"], x["place"]): x["other"] for x in got} == {k: i for k, (i, _) in best.items()}
    assert {(x["vec_id"], x["place"]): x["distance"] for x in got} == pytest.approx({k: d for k, (_, d) in best.items()})


def test_search_without_its_query_vector(spark, tmp_path):
    from ferrograph import plans

    spark.createDataFrame([(7, [1.0, 2.0], 1)], "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert plans.queries()["knn_cosine"](spark, str(tmp_path)).count() == 0


def test_diff_treats_nulls_as_equal(spark):
    a = spark.createDataFrame([(1, None), (2, "x"), (3, "y")], "k int, v string")
    b = spark.createDataFrame([(1, None), (2, None), (4, "z")], "k int, v string")
    assert {(x["k"], x["change"]) for x in diffs.rows_diff(a, b, ["k"], ["v"]).collect()} == {(2, "changed"), (3, "removed"), (4, "added")}


def test_scalars(spark):
    v = lambda *x: F.array(*map(F.lit, x))
    assert one(spark, scalars.cosine(v(0.0, 0.0), v(1.0, 1.0))) == 0
    assert one(spark, scalars.cosine(v(1.0, 0.0), v(1.0))) == 0
    assert one(spark, scalars.tanimoto(v(1, 2), v(2, 3))) == pytest.approx(1 / 3)
    assert one(spark, scalars.fnv1a(F.lit("a"))) == "e40c292c"
    assert one(spark, scalars.check_digit(F.lit("7732-18-5"))) is True
    assert one(spark, scalars.check_digit(F.lit("7732-18-6"))) is False
    assert one(spark, scalars.clamp01(F.lit(float("nan")))) == 0
    assert one(spark, scalars.convert(F.lit(5.0), F.lit("mg"), F.lit("g"))) == pytest.approx(0.005)
    assert one(spark, scalars.convert(F.lit(5.0), F.lit("mg"), F.lit("L"))) is None
    assert one(spark, scalars.multiset_equal(F.lit("C.O"), F.lit("O.C"), r"\.")) is True


@pytest.mark.parametrize(("written", "low", "high", "unit"), [(">= 5.5 mg", 5.5, None, "mg"), ("2-4 mL", 2.0, 4.0, "mL"), ("rt", 25.0, None, "C"), ("some", None, None, None)])
def test_quantities(spark, written, low, high, unit):
    parts = text.quantity(F.lit(written))
    assert one(spark, F.struct(*[c.alias(k) for k, c in parts.items()])).asDict() | {} == {"comparator": ">=" if ">" in written else None, "low": low, "high": high, "uncertainty": None, "unit": unit}


def test_conditions(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "n int, s string")
    wanted = expressions.condition({"or": [{"field": "n", "op": ">", "value": 2}, {"and": [{"field": "s", "in": ["a"]}, {"not": {"field": "n", "op": "==", "value": 9}}]}]})
    assert [x["n"] for x in df.where(wanted).collect()] == [1, 3]
    assert [x["n"] for x in df.where(expressions.all_of(n=None, s=["a", "b"])).collect()] == [1, 2]


def test_overlaps_meet_once(spark):
    r = random.Random(3)
    spans = [(i, 1, r.randrange(100), 0) for i in range(30)]
    spans = [(i, k, a, a + r.randrange(0, 40)) for i, k, a, _ in spans]
    df = spark.createDataFrame(spans, "id bigint, k int, start bigint, end bigint")
    got = sorted((x["left_id"], x["right_id"]) for x in text.overlaps(df, df, "k", 10).collect())
    assert got == sorted((a[0], b[0]) for a in spans for b in spans if a[2] < a[3] and b[2] < b[3] and a[2] < b[3] and b[2] < a[3])


def test_rank_leaves_nulls_out(spark):
    df = spark.createDataFrame([(1, 1, None), (2, 1, 5.0), (3, 1, 7.0)], "k int, s int, v double")
    assert {x["k"]: x["place"] for x in series.ranked(df, "s", "v", ["k"]).collect()} == {1: None, 2: 2, 3: 1}


def test_common_value(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "a", 2)], "g int, x string, y int")
    assert quality.common_value(df, "g", ["x", "y"]).first().asDict() == {"g": 1, "n": 2, "x": "a", "y": None}


def test_similar_edges_against_all_pairs(spark):
    r = random.Random(5)
    rows = [(10 * i, [round(r.random() - 0.3, 3) for _ in range(6)], r.choice([1, 2, None])) for i in range(40)]
    rows += [(1000, rows[0][1], rows[0][2]), (1003, rows[0][1], rows[0][2]), (1006, [0.0] * 6, 1), (1009, None, 1), (1012, None, 2), (1015, None, None)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    got = {(x["a"], x["b"]): x["score"] for x in similarity.similar_edges(df, "vec_id", "embedding", "label", 0.5, block=7).collect()}
    scores, first = [], {}
    for i, v, k in rows:
        first.setdefault((str(v), k), i)
    for a, va, la in rows:
        for b, vb, lb in rows:
            ca, cb = first[str(va), la], first[str(vb), lb]
            if a < b and (ca == a and cb == b or ca == cb == a):
                if la is not None and la == lb:
                    scores.append((a, b, "semantic", 0.95))
                if va and vb:
                    x, y = ({i for i, z in enumerate(v) if z > 0} for v in (va, vb))
                    length = (sum(z * z for z in va) * sum(z * z for z in vb)) ** 0.5
                    scores.append((a, b, "embedding", round(sum(s * t for s, t in zip(va, vb, strict=True)) / length, 9) if length else 0.0))
                    scores.append((a, b, "fingerprint", round(len(x & y) / len(x | y), 9) if x | y else 0.0))
    every = similarity.hybrid_edges(spark.createDataFrame(scores, "a bigint, b bigint, component string, score double")).where("score >= 0.5").collect()
    assert got == pytest.approx({(x["a"], x["b"]): x["score"] for x in every})
    assert (0, 1003) in got and any(b - a > 100 for a, b in got)


def test_a_customer_without_orders_as_in_sql(spark, tmp_path):
    import duckdb

    from ferrograph import plans

    spark.createDataFrame([(1,), (2,), (3,)], "c_custkey bigint").write.parquet(f"{tmp_path}/customer.parquet")
    orders = [(10, 1, "F", "a"), (11, 1, "O", "b"), (12, 3, None, "a")]
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    for t in ("customer", "orders"):
        con.sql(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    columns = "c_custkey, n_orders, n_priorities, finished, completeness"
    wanted = con.sql(f"select {columns} from ({plans.oracle_sql()['minimal_set_status']})").fetchall()
    assert sorted(map(tuple, plans.queries()["minimal_set_status"](spark, str(tmp_path)).select(columns.split(", ")).collect())) == sorted(wanted)


def test_forest_edges_hold_the_forest_of_all_pairs(spark):
    r = random.Random(5)
    vectors = [[r.choice([-1.0, -0.5, 0.5, 1.0]) for _ in range(4)] for _ in range(40)]
    rows = [(i, r.choice(vectors) if r.random() < 0.9 else None, r.choice([None, 1, 2])) for i in range(150)]
    df = spark.createDataFrame(rows, "id bigint, v array<double>, l int")
    every = graphs.spanning_forest(similarity.similar_edges(df, "id", "v", "l", -1.0).select("a", "b", F.col("score").alias("w")))
    edges = similarity.forest_edges(df, "id", "v", "l", block=6)
    assert edges.count() < 1200
    assert sorted(map(tuple, graphs.spanning_forest(edges).collect())) == sorted(map(tuple, every.collect()))


def test_forest_edges_are_the_forest_itself(spark, monkeypatch):
    monkeypatch.setattr(similarity, "PROBES", 8, raising=False)
    r = random.Random(12)
    centres = [[r.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    near = lambda c: [x + r.gauss(0, 0.3) for x in c]
    rows = [(i, near(r.choice(centres)) if r.random() < 0.9 else None, r.choice([None, 1, 2, 3])) for i in range(120)]
    rows += [(500 + i, rows[i][1], rows[i][2]) for i in range(0, 30, 3)]  # copies
    rows += [(700, None, 9), (701, [0.0] * 6, None), (702, [float("nan")] * 6, 2), (7, near(centres[0]), 3)]  # alone, no length, no numbers, an id again
    df = spark.createDataFrame(rows, "id bigint, v array<double>, l int")
    every = graphs.spanning_forest(similarity.similar_edges(df, "id", "v", "l", -1.0).select("a", "b", F.col("score").alias("w")))
    assert sorted(map(tuple, similarity.forest_edges(df, "id", "v", "l", block=16).collect())) == sorted(map(tuple, every.collect()))


def test_spanning_forest_by_rounds_and_by_tasks(spark, monkeypatch):
    monkeypatch.setattr(graphs, "SMALL", 200, raising=False)
    r = random.Random(13)
    edges = {(a, b): float(r.randrange(20)) for a in range(90) for b in range(a + 1, 90) if r.random() < 0.2}
    edges |= {(a, a + 1): 30.0 + a % 7 for a in range(100, 180) if a % 9}
    seen = list(range(200))

    def root(x):
        while seen[x] != x:
            x = seen[x]
        return x

    wanted = []
    for (a, b), w in sorted(edges.items(), key=lambda e: (-e[1], e[0])):
        if root(a) != root(b):
            seen[root(a)] = root(b)
            wanted.append((a, b, w))
    given = [(b, a, w) if (a + b) % 2 else (a, b, w) for (a, b), w in edges.items()]
    found = graphs.spanning_forest(spark.createDataFrame([*given, (3, 3, 99.0)], "a bigint, b bigint, w double"))
    assert sorted(map(tuple, found.collect())) == sorted(wanted)


def test_top_neighbours_over_many_blocks(spark):
    r = random.Random(6)
    rows = [(i, [float(r.randrange(-2, 3)) for _ in range(3)]) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    for metric in ("l2", "inner_product"):
        far = lambda x, y: round(sum((p - q) ** 2 for p, q in zip(x, y, strict=True)) ** 0.5, 9) if metric == "l2" else -sum(p * q for p, q in zip(x, y, strict=True))  # noqa: B023, E731
        got = similarity.top_neighbours(df, df.where("vec_id % 4 = 0"), 5, block=7, metric=metric)
        wanted = {(i, n + 1): o for i, v in rows if i % 4 == 0 for n, (_, o) in enumerate(sorted((far(v, y), j) for j, y in rows if j != i)[:5])}
        assert {(x["vec_id"], x["place"]): x["other"] for x in got.collect()} == wanted


def test_tanimoto_links_over_packs_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(similarity, "CHUNK", 5)
    r = random.Random(9)
    sets = {i: sorted({r.randrange(30) for _ in range(r.randrange(0, 20))}) for i in range(90)}
    df = spark.createDataFrame([*sets.items(), (200, sets[3])], "id bigint, s array<bigint>")
    sets[200] = sets[3]
    found = similarity.tanimoto_links(df, "id", "s", 40, pack=8)
    # classes meet in packs: no join pairs them out by their bits
    assert "bit#" not in found._jdf.queryExecution().toString()
    for x in found.collect():
        s = set(sets[x["id"]])
        assert x["n_links"] == sum(1 for j, t in sets.items() if j != x["id"] and s and 100 * len(s & set(t)) >= 40 * len(s | set(t)))


def test_components_of_nodes_with_many_neighbours(spark, monkeypatch):
    """With a small bound stars and chains have hot nodes on either end, whose rows are not dealt by node."""
    from ferrograph.operators import graphs

    monkeypatch.setattr(graphs, "HOT", 5)
    edges = [(0, i) for i in range(1, 40)] + [(i, 500) for i in range(100, 140)] + [(i, i + 1) for i in range(600, 640)] + [(39, 100), (7, 7)]
    got = {r["node"]: r["component"] for r in graphs.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 600 if i >= 600 else 0 for i in [*range(40), *range(100, 140), 500, *range(600, 641)]}
