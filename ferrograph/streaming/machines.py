"""The state machines of operators/machines.py over streams, with Spark's keyed map, list and value state."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..operators.machines import OUTCOME, Run, planned
from ..tables import shared_dir

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class RunMachine(StatefulProcessor):
    """A run's steps and controls in map state, its snapshots in list state, the rest in a value."""

    def __init__(self, key: str, plan: list):
        self.key, self.plan = key, plan

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.steps = handle.getMapState("steps", "name string", "place int, status string, needs array<string>, confirm boolean")
        self.controls = handle.getMapState("controls", "name string", "status string")
        self.snapshots = handle.getListState("snapshots", "steps map<string,string>, controls map<string,string>, status string, current string")
        self.rest = handle.getValueState("rest", "status string, current string, trace bigint, cursor int")

    def load(self) -> Run:
        if not self.rest.exists():
            return planned(self.plan)
        rest = self.rest.get()
        steps = sorted(((k[0], v) for k, v in self.steps.iterator()), key=lambda x: x[1][0])
        run = Run({k: [v[1], list(v[2] or ()), v[3]] for k, v in steps}, {k[0]: v[0] for k, v in self.controls.iterator()}, *rest[:3])
        run.snapshots, run.cursor = [(dict(s[0]), dict(s[1]), s[2], s[3]) for s in self.snapshots.get()], rest[3]
        return run

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        run = self.load()
        before, names = run.view(), ["seq", "action", "target", "needs", "confirm"]
        stack, known = list(run.snapshots), set(run.steps) if self.rest.exists() else set()
        for row in sorted(rows, key=lambda r: (r["seq"], r["action"] or "", r["target"] or "")):
            made = run.outcome(*(row[n] for n in names))
            yield Row(**dict(zip([self.key, *(f.split()[0] for f in OUTCOME.split(", "))], (key[0], *made), strict=True)))
        for place, (name, step) in enumerate(run.steps.items()):
            if name not in known or before[0].get(name) != step[0]:  # only what has changed is written
                self.steps.updateValue((name,), (place, step[0], step[1], step[2]))
        for name, status in run.controls.items():
            if not known or before[1].get(name) != status:
                self.controls.updateValue((name,), (status,))
        if run.snapshots != stack:
            if run.snapshots[: len(stack)] == stack:
                self.snapshots.appendList(run.snapshots[len(stack) :])
            else:
                self.snapshots.put(run.snapshots)
        self.rest.update((run.status, run.current, run.trace, run.cursor))

    def close(self) -> None:
        pass


def run_stream(actions: DataFrame, key: str, plan: list[tuple[str, list[str] | None, bool]] = ()) -> DataFrame:
    """Streaming outcomes of a stream of actions, as `run_actions` gives them for a table; actions of a run must come in order of seq from batch to batch."""
    kind = dict(actions.dtypes)[key]
    out = StructType.fromDDL(f"{key} {kind}, {OUTCOME}")
    rows = actions.where(actions[key].isNotNull()).select(key, "seq", "action", "target", "needs", "confirm")
    return rows.groupBy(key).transformWithState(RunMachine(key, list(plan)), out, "Append", "None")


def replay_actions(spark: SparkSession, actions: DataFrame, key: str, plan: list, at: str | None = None) -> DataFrame:
    """All of a stream's actions up to now through the machine: the table of outcomes.

    State and outcomes are in the folder `at` (a new one for each call if none is given); a call with the folder of one that
    stopped goes on from its state, and what it had delivered is not delivered again.
    """
    at = at or f"{shared_dir(spark)}/runs-{uuid.uuid4().hex}"
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, ROCKS)  # keyed state of several kinds needs this store
    try:
        stream = run_stream(actions, key, plan).writeStream.format("parquet").option("path", f"{at}/outcomes").option("checkpointLocation", f"{at}/checkpoint")
        stream.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(setting, before) if before else spark.conf.unset(setting)
    return spark.read.schema(StructType.fromDDL(f"{key} {dict(actions.dtypes)[key]}, {OUTCOME}")).parquet(f"{at}/outcomes")
