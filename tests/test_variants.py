"""Records without a schema: one form whatever the order of keys, guards, leaves of any depth."""

from pyspark.sql import functions as F

from ferrograph.operators import variants


def rows(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("id", variants.record(F.col("t")).alias("v"))


def test_one_hash_for_equal_records(spark):
    texts = ['{"b":{"y":[1,{"q":2,"p":1}],"x":null},"a":"é"}', '{ "a" : "\\u00e9", "b" : {"x": null, "y": [1, {"p":1, "q":2}]} }', '{"a":"é","b":{"x":null,"y":[{"p":1,"q":2},1]}}', "{", None, "[1, 2]", '"s"', "null"]
    got = {r["id"]: (r["c"], r["h"]) for r in rows(spark, texts).select("id", variants.canonical(F.col("v")).alias("c"), variants.record_hash(F.col("v")).alias("h")).collect()}
    assert got[0] == got[1] and got[0][0] == '{"a":"é","b":{"x":null,"y":[1,{"p":1,"q":2}]}}'
    assert got[2][1] != got[0][1] and got[3] == got[4] == (None, None) and got[5][0] == "[1,2]"


def test_guards(spark):
    df = rows(spark, ['{"n":1,"s":"x","o":{}}', '{"n":"7","s":2,"o":[]}', "3", None])
    got = df.orderBy("id").select(variants.guarded(F.col("v"), "$.n", "int"), variants.guarded(F.col("v"), "$.s", "int"), variants.kind_of(F.try_variant_get("v", "$.o", "variant"))).collect()
    assert [tuple(r) for r in got] == [(1, None, "object"), (7, 2, "array"), (None, None, None), (None, None, None)]


def test_leaves(spark):
    deep = '{"a":' * 12 + "1" + "}" * 12
    df = rows(spark, ['{"a":[1,[true,{"b":"x"}]],"c":{},"d":null}', deep, "{", "5"])
    got = {(r["id"], r["path"]): r["value"] for r in variants.leaves(df, "id", "v").collect()}
    assert got == {(0, "$.a[0]"): "1", (0, "$.a[1][0]"): "true", (0, "$.a[1][1].b"): "x", (0, "$.d"): None, (1, "$" + ".a" * 12): "1", (3, "$"): "5"}
