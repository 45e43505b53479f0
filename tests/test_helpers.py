"""Scalar helpers and small operators that no query shows in full."""

import pytest
from pyspark.sql import functions as F

from ferrograph.functions import notation, scalars
from ferrograph.operators import clusters, diffs, expressions, links, lookup, series, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("column", "wanted"),
    [
        (lambda: notation.is_key(F.lit("AAAAAAAAAAAAAA-BBBBBBBBBB-C")), True),
        (lambda: notation.is_key(F.lit("AAAA-B-C")), False),
        (lambda: notation.sentences(F.lit("It was heated. Then e.g. cooled! Done?")), ["It was heated.", "Then e.g. cooled!", "Done?"]),
        (lambda: notation.canonical_json(F.create_map(F.lit("b"), F.lit(1), F.lit("a"), F.lit(2))), '{"a":2,"b":1}'),
        (lambda: notation.values_conflict(F.lit("50 %"), F.lit("50.0%")), False),
        (lambda: notation.values_conflict(F.lit("white solid"), F.lit("oil")), True),
        (lambda: notation.is_formula(F.lit("TiCl4")), True),
        (lambda: notation.is_formula(F.lit("KMnO4-")), True),
        (lambda: notation.is_formula(F.lit("NaCl")), False),
        (lambda: notation.is_formula(F.lit("Xq2O3")), False),
        (lambda: notation.participants(F.array(F.lit("a"), F.lit("b")), F.array().cast("array<string>")), "a+b=>none"),
        (lambda: notation.sided_similarity(F.array(F.lit(1), F.lit(17)), F.array(F.lit(1), F.lit(17)), 16), 0.4),
        (lambda: scalars.blank_as(F.lit("  "), "unknown"), "unknown"),
        (lambda: scalars.clamp01(F.lit(float("nan"))), 0.0),
        (lambda: scalars.check_digit(F.lit("7732-18-5")), True),
        (lambda: scalars.multiset_equal(F.lit("A.B.A"), F.lit("A.A.B"), r"\."), True),
        (lambda: expressions.theoretical_yield(F.lit(2.0), F.lit(None).cast("double"), F.lit(3.0)), 6.0),
        (lambda: text.compact(F.lit(" a "), F.lit(""), F.lit("b")), "a b"),
        (lambda: F.array(*text.line_column(F.lit("ab\ncd"), F.lit(4))), [2, 2]),
        (lambda: diffs.map_diff(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("b"), F.lit("3"))), "a+b"),
    ],
)
def test_scalars(spark, column, wanted):
    assert one(spark, column()) == wanted


def test_spans_apart_prefers_the_longest(spark):
    spans = F.array(*[F.struct(F.lit(s).alias("score"), F.lit(a).alias("start"), F.lit(b).alias("end")) for s, a, b in ((0.5, 0, 4), (0.9, 3, 5), (0.1, 5, 9))])
    assert [(x["start"], x["end"]) for x in one(spark, lookup.spans_apart(spans))] == [(0, 4), (5, 9)]


def test_latest_is_one_row_a_key(spark):
    rows = spark.createDataFrame([(1, 2, "a"), (1, 3, "b"), (1, 3, "c"), (2, None, "d")], "k int, at int, id string")
    assert sorted(map(tuple, series.latest(rows, ["k"], [F.col("at"), F.col("id")]).collect())) == [(1, 3, "c"), (2, None, "d")]


def test_longest_prefix_of_names(spark):
    rules = spark.createDataFrame([("a", "one"), ("a.b", "two"), ("x", "three")], "prefix string, kind string")
    rows = spark.createDataFrame([("a.b.c",), ("a.bc",), ("ab",), (None,), ("a.b.c",)], "n string")
    assert sorted(map(str, ((x["n"], x["kind"]) for x in lookup.longest_prefix(rows, F.col("n"), rules).collect()))) == sorted(map(str, [("a.b.c", "two"), ("a.bc", "one"), ("ab", None), (None, None), ("a.b.c", "two")]))


def test_clusters_of_graded_edges(spark):
    edges = spark.createDataFrame([(1, 2, 0.9, ["x"]), (2, 3, 0.8, ["x", "y"]), (7, 8, 0.7, ["y"])], "a bigint, b bigint, score double, basis array<string>")
    found = {x["cluster"]: x for x in clusters.summaries(clusters.clustered(edges)).collect()}
    assert (found[1]["n_members"], found[1]["mean_score"], found[1]["basis"], found[1]["warnings"]) == (3, 0.85, "x+y", "")
    assert found[7]["warnings"] == "pair_only"
    assert {x["cluster"]: x["representative"] for x in clusters.representatives(clusters.clustered(edges), "degree").collect()} == {1: 2, 7: 7}


def test_missing_vectors_are_those_that_are_unsound(spark):
    chunks = spark.createDataFrame([(1,), (2,), (3,), (4,)], "id int")
    vectors = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, [float("nan"), 1.0])], "id int, vector array<double>")
    assert {x["id"]: x["action"] for x in links.missing_vectors(chunks, vectors, ["id"], 2).collect()} == {1: "kept", 2: "embed", 3: "embed", 4: "embed"}
    assert links.missing_vectors(chunks, vectors, ["id"], 2, overwrite=True).where("action = 'kept'").count() == 0
