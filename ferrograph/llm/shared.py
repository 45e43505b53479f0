"""What the operators share: shared-folder tables and block iteration over Arrow batches."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graphs import components  # noqa: F401
from ..tables import drop, shared_dir  # noqa: F401
from ..tables import stash as write_table

#: Code points of text that one block of Python work holds at most (one longer text is a block by itself).
BLOCK_CHARS = 1_000_000


def stash(df: DataFrame, name: str) -> DataFrame:
    """A written table in the shared folder, after which the driver drops what the finished step no longer needs."""
    out = write_table(df, name)
    release(out)
    return out


def release(df: DataFrame) -> None:
    """Let the driver drop what finished steps no longer need: Spark deletes shuffle files once their owners are collected."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def blocks(batches: Iterator[pa.RecordBatch], text_at: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches with their texts ('' for null), each of about BLOCK_CHARS at most."""
    for batch in batches:
        start, size, texts = 0, 0, []
        column = batch.column(text_at)
        for row in range(batch.num_rows):
            text = column[row].as_py() or ""
            if texts and size + len(text) > BLOCK_CHARS:
                yield batch.slice(start, row - start), texts
                start, size, texts = row, 0, []
            texts.append(text)
            size += len(text)
        if texts:
            yield batch.slice(start), texts


def per_text(df: DataFrame, keep: list[str], text: str, schema: str, work: Callable[[list[str]], list[list]]) -> DataFrame:
    """Columns `keep` of df beside the columns of `schema` that `work` gives for each block of texts.

    A null text is worked on as the empty one; `work` gets a list of texts and returns one list a column.
    """
    source = df.select(*keep, F.col(text).alias("__text"))
    fields = [source.schema[k] for k in keep]
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = StructType([*fields, *StructType.fromDDL(schema).fields])
    arrow = to_arrow_schema(out)

    def run(batches):
        for part, texts in blocks(batches, len(keep)):
            columns = work(texts)
            made = [part.column(i).cast(arrow.field(i).type) for i in range(len(keep))]
            made += [pa.array(c, type=arrow.field(len(keep) + i).type) for i, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays(made, schema=arrow)

    return source.mapInArrow(run, out)


def free_name(columns: list[str], name: str) -> str:
    """name, with underscores after it until no column is called so (case apart, as in Spark)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once a row (a lambda's variable), however often body mentions it."""
    return F.transform(F.array(value), body)[0]
