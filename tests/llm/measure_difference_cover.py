"""What the first level of a difference-cover sort of all suffixes takes: sampled triples sorted and named, names brought back in order of place.

Not a test: python tests/llm/measure_difference_cover.py DOCUMENTS LOCAL_DIR prints bytes of text and of the table, rows,
seconds, and bytes of shuffle files and of the written names. Deeper levels come on top, each with a third less rows.
"""

import os
import subprocess
import sys
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F


def bytes_in(folder: str) -> int:
    return int(subprocess.run(["du", "-sB1", folder], capture_output=True, text=True, check=True).stdout.split()[0])


def sampled(batches):
    """(id, p, triple) of each place p of a text's bytes that is no multiple of three; zeros follow the end."""
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            data = np.frombuffer((t or "").encode() + b"\0\0", np.uint8).astype(np.int32)
            p = np.arange(len(data) - 2, dtype=np.int32)
            p = p[p % 3 != 0]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), i or 0, np.int64)), pa.array(p), pa.array((data[p] << 16) | (data[p + 1] << 8) | data[p + 2])], ["id", "p", "triple"])


def main(documents: str, local: str) -> None:
    spark = (
        SparkSession.builder.master("local[4]").config("spark.driver.memory", "6g").config("spark.local.dir", local)
        .config("spark.sql.shuffle.partitions", "32").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    docs = spark.read.parquet(documents).select("doc_id", "text")
    text, began, before = docs.agg(F.sum(F.octet_length("text"))).first()[0], time.perf_counter(), bytes_in(local)
    triples = docs.mapInArrow(sampled, "id bigint, p int, triple int")
    parts = triples.repartitionByRange(32, "triple").sortWithinPartitions("triple").withColumn("part", F.spark_partition_id())
    named = parts.withColumn("rank", F.dense_rank().over(Window.partitionBy("part").orderBy("triple")))
    named.select("id", "p", "part", "rank").repartition(32, "id").sortWithinPartitions("id", "p").write.parquet(f"{local}/names")
    rows = spark.read.parquet(f"{local}/names").count()
    written = bytes_in(f"{local}/names")
    table = sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(documents) for f in files) if os.path.isdir(documents) else os.path.getsize(documents)
    print({"text_bytes": text, "table_bytes": table, "rows": rows, "seconds": round(time.perf_counter() - began, 1), "shuffle_bytes": bytes_in(local) - before - written, "names_bytes": written})


if __name__ == "__main__":
    main(*sys.argv[1:])
