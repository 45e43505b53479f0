"""References in texts: field lines and @ tokens outside quotes, with line and column ranges, read in one pass."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fields whose values are references.
FIELDS = frozenset("ref reaction product molecule source prev next reactant reac prod reactants products".split())
FIELD = re.compile(r"[ \t]*([A-Za-z][A-Za-z0-9_-]*)[ \t]*:[ \t]*")
TARGET = re.compile(r"[A-Za-z0-9_.-]+(?:#[A-Za-z0-9_.-]+)?")
#: A quoted stretch, which a quote of its kind ends that no backslash stands before, or the line; or a token.
QUOTED_OR_TOKEN = re.compile(r"""(?<!\\)(["'])(?:(?!(?<!\\)\1).)*(?:\1|$)|@[A-Za-z0-9_.#-]*""")
TOKENS = "line int, column int, end_column int, field string, raw string, target string, alias string, local_id string"


def target_of(raw: str) -> tuple[str, str | None, str] | None:
    """What a token means: its text without @ and semicolons, the document's alias before #, and the name in it; null if it is none."""
    said = raw.strip().removeprefix("@").rstrip(";")
    if not TARGET.fullmatch(said):
        return None
    alias, _, name = said.rpartition("#")
    return said, alias or None, name


def references(text: str) -> list[tuple]:
    """Rows of TOKENS in order: of each line first the values of a reference field, then @ tokens; a place and target once. Lines and columns count from 1."""
    found, seen = [], set()
    for number, line in enumerate(text.split("\n"), 1):
        line = line.removesuffix("\r")
        here = []
        if (field := FIELD.match(line)) and field[1] in FIELDS:
            at = field.end()
            for token in re.split(r"[|,\[\]]", line[at:]):
                here.append((field[1], token.strip(), at + len(token) - len(token.lstrip())))
                at += len(token) + 1
        if "@" in line:
            here += [("@", m[0], m.start()) for m in QUOTED_OR_TOKEN.finditer(line) if m[0][0] == "@"]
        for name, raw, start in here:
            known = target_of(raw)
            if known and (number, start, known[0]) not in seen:
                seen.add((number, start, known[0]))
                found.append((number, start + 1, start + 1 + len(raw), name, raw, *known))
    return found


def reference_tokens(docs: DataFrame, key: str, text: str) -> DataFrame:
    """References of each text: key and TOKENS. Null texts have none; nothing is shuffled."""
    types = [pa.int32()] * 3 + [pa.string()] * 5
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = [(i, r) for i, t in enumerate(batch.column(1)) if t.is_valid for r in references(t.as_py())]
            keys = batch.column(0).take(pa.array([i for i, _ in rows], pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, *(pa.array([r[k] for _, r in rows], t) for k, t in enumerate(types))], ["key", *(f.split()[0] for f in TOKENS.split(", "))])

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"key {kind}, {TOKENS}").withColumnRenamed("key", key)
