"""Mentions leave a task in batches of bounded size, whatever the size of the batches that come in."""

import pyarrow as pa

from ferrograph.operators import mentions


class Docs:
    """Stands in for a table of texts and keeps the function that would run in its tasks."""

    def __init__(self, df):
        self.sparkSession, self.schema = df.sparkSession, df.schema

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        self.run = run
        return self

    def withColumnRenamed(self, old, new):
        return self


def test_mentions_leave_in_batches_of_bounded_size(spark):
    df = spark.createDataFrame([(0, "")], "doc_id bigint, text string")
    lexicon = spark.createDataFrame([("w", "water", "water", "solvent")], "entry string, name string, alias string, category string")
    texts = [None, "", "x", *["water, warm Water"] * (3 * mentions.HELD), "none"]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(first, first + len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"]) for first in (0, 100_000)]
    got = list(mentions.lexicon_mentions(Docs(df), "doc_id", "text", lexicon).run(iter(batches)))
    assert max(b.num_rows for b in got) <= mentions.HELD + 2
    rows = [(r["key"], r["start"], r["end"], r["mention"]) for b in got for r in b.to_pylist()]
    wanted = [(first + i, *span) for first in (0, 100_000) for i, t in enumerate(texts) if t and "water" in t for span in ((0, 5, "water"), (12, 17, "Water"))]
    assert rows == wanted
