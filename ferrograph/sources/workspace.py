"""Documents of a workspace as a data source: a partition a folder, filters pushed into the listing, pages by cursor."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, In, InputPartition, StringStartsWith

SCHEMA = "path string, folder string, name string, kind string, size bigint, modified timestamp, text string"
# What documents are called by the end of their name, and folders that hold none.
KINDS = {".md": "markdown", ".txt": "text", ".json": "json", ".rec": "record", ".csv": "table"}
SKIPPED = frozenset([".git", "node_modules", "target", "dist"])


@dataclass
class Folder(InputPartition):
    """One folder, as a path from the root."""

    path: str


def kind_of(name: str) -> str | None:
    return KINDS.get(os.path.splitext(name)[1].lower())


class WorkspaceReader(DataSourceReader):
    """Lists folders on the driver, files where they are read; a file is opened only if its path and kind pass all pushed filters."""

    def __init__(self, root: str, text: bool):
        self.root, self.text = root, text
        self.kinds: set[str] | None = None
        self.folders: set[str] | None = None
        self.begin: list[str] = []
        self.after: str | None = None
        self.paths: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column, both = f.attribute, lambda old, new: set(new) if old is None else old & set(new)
            if isinstance(f, EqualTo | In) and column in (("kind",), ("folder",), ("path",)):
                values = [f.value] if isinstance(f, EqualTo) else list(f.value)
                name = {"kind": "kinds", "folder": "folders", "path": "paths"}[column[0]]
                setattr(self, name, both(getattr(self, name), values))
            elif isinstance(f, StringStartsWith) and column == ("path",):
                self.begin.append(f.value)
            elif isinstance(f, GreaterThan) and column == ("path",):
                self.after = max(self.after or "", f.value)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        found = []
        for top, folders, names in os.walk(self.root):
            folders[:] = sorted(x for x in folders if x not in SKIPPED)
            at = os.path.relpath(top, self.root).replace(os.sep, "/")
            at = "" if at == "." else at
            under = f"{at}/" if at else ""
            near = all(under.startswith(b) or b.startswith(under) for b in self.begin)
            late = self.after is None or under >= self.after[: len(under)]
            if names and near and late and (self.folders is None or at in self.folders) and (self.paths is None or any(os.path.dirname(p) == at for p in self.paths)):
                found.append(Folder(at))
        return found or [Folder("\0")]  # a scan has a partition at least; this one is no folder

    def wanted(self, path: str, kind: str | None) -> bool:
        return (
            kind is not None and (self.kinds is None or kind in self.kinds) and (self.paths is None or path in self.paths)
            and (self.after is None or path > self.after) and all(path.startswith(b) for b in self.begin)
        )

    def read(self, partition: Folder) -> Iterator[tuple]:
        from datetime import datetime

        if partition.path == "\0":
            return
        top = os.path.join(self.root, partition.path)
        for name in sorted(os.listdir(top)):
            path, kind = f"{partition.path}/{name}" if partition.path else name, kind_of(name)
            whole = os.path.join(top, name)
            if not self.wanted(path, kind) or os.path.isdir(whole):
                continue
            about = os.stat(whole)
            text = None
            if self.text:
                with open(whole, encoding="utf-8", errors="replace") as file:
                    text = file.read()
            yield path, partition.path, name, kind, about.st_size, datetime.fromtimestamp(about.st_mtime), text


class WorkspaceSource(DataSource):
    """Format "workspace": options path (a folder that driver and executors share) and text (false: texts are null and no file is opened)."""

    @classmethod
    def name(cls) -> str:
        return "workspace"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WorkspaceReader:
        return WorkspaceReader(self.options["path"], self.options.get("text", "true").lower() != "false")


def workspace(spark: SparkSession, root: str, text: bool = True) -> DataFrame:
    """A workspace's documents (SCHEMA): paths from the root, folders like .git left out. Conditions on kind, folder and path reach the listing."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WorkspaceSource)
    return spark.read.format("workspace").option("text", str(text).lower()).load(root)


def page(docs: DataFrame, size: int, after: str | None = None) -> DataFrame:
    """The next `size` documents by path behind the cursor `after` (the last path of the page before); folders before it are not listed."""
    rows = docs if after is None else docs.where(F.col("path") > after)
    return rows.orderBy("path").limit(size)
