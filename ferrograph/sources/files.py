"""Text documents and JSON jobs as tables, and JSON out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def text_documents(spark: SparkSession, paths: str | list[str], pattern: str = "*", ignore: tuple[str, ...] = ("node_modules", ".git"), depth: int | None = None) -> DataFrame:
    """path, name, text of all files below the paths that match the pattern; folders named in `ignore` are left out.

    `depth` is the greatest number of folders between a path given and a file.
    """
    found = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(paths)
    out = found.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"), F.col("value").alias("text"))
    for folder in ignore:
        out = out.where(~F.contains("path", F.lit(f"/{folder}/")))
    if depth is not None:
        roots = [paths] if isinstance(paths, str) else paths
        below = F.least(*[F.when(F.contains("path", F.lit(r.rstrip("/").removeprefix("file:").lstrip("/"))), F.size(F.split(F.substring_index("path", r.rstrip("/").rsplit("/", 1)[-1] + "/", -1), "/")) - 1) for r in roots], F.lit(1 << 20))
        out = out.where(below <= depth)
    return out


def page(rows: DataFrame, order: str, cursor: int, limit: int, most: int = 250) -> DataFrame:
    """One page of rows in order, each with total_count and next_cursor (null on the last page)."""
    limit = min(max(limit, 1), most)
    total = rows.agg(F.count("*").alias("total_count"))
    nxt = F.when(F.lit(cursor + limit) < F.col("total_count"), F.lit(cursor + limit))
    return rows.orderBy(order).offset(cursor).limit(limit).crossJoin(F.broadcast(total)).withColumn("next_cursor", nxt)


def json_jobs(spark: SparkSession, path: str, schema: StructType, required: list[str]) -> DataFrame:
    """Jobs of a folder of JSON files by a fixed schema, with `problems`: malformed, or missing:<field>, joined by +."""
    corrupt = "_corrupt_record"
    full = StructType([*schema.fields]).add(corrupt, "string")
    rows = spark.read.schema(full).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", corrupt).json(path)
    bad = F.col(corrupt).isNotNull()
    problems = F.concat_ws("+", F.when(bad, "malformed"), *[F.when(~bad & F.col(f).isNull(), F.lit(f"missing:{f}")) for f in required])
    return rows.withColumn("problems", problems).drop(corrupt)


def write_json(rows: DataFrame, path: str) -> None:
    """JSON lines with their keys in order."""
    rows.select(*sorted(rows.columns)).write.mode("overwrite").json(path)
