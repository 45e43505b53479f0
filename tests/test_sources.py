import json

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ferrograph.operators import lookup
from ferrograph.sources import files, outbox, records


def test_text_documents(spark, tmp_path):
    for name in ("a.txt", "x/b.txt", "x/y/c.txt", "node_modules/d.txt", "x/e.md"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(f"text of\n{name}")
    found = files.text_documents(spark, str(tmp_path), "*.txt")
    assert {r["name"]: r["text"] for r in found.collect()} == {"a.txt": "text of\na.txt", "b.txt": "text of\nx/b.txt", "c.txt": "text of\nx/y/c.txt"}
    assert {r["name"] for r in files.text_documents(spark, str(tmp_path), "*.txt", depth=1).collect()} == {"a.txt", "b.txt"}


def test_pages_of_a_listing(spark):
    rows = spark.range(25)
    got = files.page(rows, "id", 10, 10).collect()
    assert [r["id"] for r in got] == list(range(10, 20)) and {(r["total_count"], r["next_cursor"]) for r in got} == {(25, 20)}
    assert {r["next_cursor"] for r in files.page(rows, "id", 20, 10).collect()} == {None}


def test_json_jobs(spark, tmp_path):
    (tmp_path / "1.json").write_text(json.dumps({"job_id": "a", "n": 3}))
    (tmp_path / "2.json").write_text(json.dumps({"n": 3}))
    (tmp_path / "3.json").write_text("{not json")
    got = files.json_jobs(spark, str(tmp_path), StructType.fromDDL("job_id string, n int"), ["job_id"]).collect()
    assert sorted(r["problems"] for r in got) == ["", "malformed", "missing:job_id"]
    files.write_json(spark.createDataFrame([(1, "x")], "b int, a string"), str(tmp_path / "out"))
    assert "".join(f.read_text() for f in (tmp_path / "out").glob("part*")) == '{"a":"x","b":1}\n'


def test_outbox(spark):
    old = spark.createDataFrame([("a", "1", "failed", 2), ("b", "2", "sent", 1), ("c", "3", "failed", 3)], "idempotency_key string, payload string, status string, attempts int")
    entries = outbox.put(old, spark.createDataFrame([("d", "4"), ("b", "5")], "idempotency_key string, payload string"))
    due = {r["idempotency_key"]: r["disposition"] for r in outbox.due(entries).collect()}
    assert due == {"a": "retryable", "b": "eligible", "d": "eligible"}
    done = outbox.settle(entries, spark.createDataFrame([("a", False), ("d", True)], "idempotency_key string, ok boolean"))
    assert {r["idempotency_key"]: (r["status"], r["attempts"]) for r in done.collect()} == {"a": ("failed", 3), "b": ("pending", 0), "c": ("failed", 3), "d": ("sent", 1)}


def test_records(spark):
    df = spark.createDataFrame([(1, [(7, "x"), (8, "y")]), (2, [])], "k int, parts array<struct<id:int,name:string>>")
    assert [tuple(r) for r in records.decompose(df, "k", {"parts": "part"})["part"].collect()] == [(1, 0, 7, "x"), (1, 1, 8, "y")]
    assert [r["entity_id"] for r in records.entities(df, "k", {"parts": "part"}).collect()] == ["part::1::7", "part::1::8"]
    kids = spark.createDataFrame([(1,), (9,), (None,)], "k int")
    assert sorted(str(r["k"]) for r in records.orphans(kids, df.withColumnRenamed("k", "id"), "k", "id").collect()) == ["9", "None"]


def test_spans_apart(spark):
    spans = F.array(*[F.struct(F.lit(float(s)).alias("score"), F.lit(a).alias("start"), F.lit(b).alias("end")) for s, a, b in [(1, 0, 5), (2, 3, 9), (1, 9, 12), (5, 10, 12)]])
    got = spark.range(1).select(lookup.spans_apart(spans).alias("s")).first()["s"]
    assert [(x["start"], x["end"]) for x in got] == [(3, 9), (9, 12)]
