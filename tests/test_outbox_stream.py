"""Delivery from a stream: once each, one failure stops no other, and a stop between writing down and committing."""

import os
import uuid

import pytest

from ferrograph.streaming.outbox import deliver, retry, statuses


def test_a_repeated_batch_delivers_nothing_twice(spark, tmp_path):
    box, at, folder = str(tmp_path / "box"), str(tmp_path / "at"), str(tmp_path / "in")
    os.makedirs(box)

    def send(key, payload):
        open(f"{box}/{key}-{uuid.uuid4().hex}", "w").close()
        if payload == "bad":
            raise ValueError("refused")

    schema = "idempotency_key string, payload string"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    stream = lambda: spark.readStream.schema(schema).parquet(folder)
    sent = lambda: sorted(x.split("-")[0] for x in os.listdir(box))
    put([("a", "x"), ("b", "bad"), ("c", None), ("a", "x"), (None, "x")])

    def killed(number):
        raise RuntimeError("killed before the commit")

    with pytest.raises(Exception, match="killed before the commit"):
        deliver(stream(), at, send, killed)
    assert sent() == ["a", "b", "c"]
    done = deliver(stream(), at, send)  # the same batch comes again
    assert sent() == ["a", "b", "c"] and {(r["idempotency_key"], r["ok"]) for r in done.collect()} == {("a", True), ("b", False), ("c", True)}
    put([("a", "x"), ("d", "y")])
    deliver(stream(), at, send)
    assert sent() == ["a", "b", "c", "d"]
    entries = spark.read.parquet(folder)
    for _ in range(4):
        done = retry(entries, at, send)
    assert sent() == ["a", "b", "b", "b", "c", "d"]
    got = {r["idempotency_key"]: (r["status"], r["attempts"], r["error"]) for r in statuses(done).collect()}
    assert got == {"a": ("sent", 1, None), "b": ("blocked", 3, "ValueError: refused"), "c": ("sent", 1, None), "d": ("sent", 1, None)}
