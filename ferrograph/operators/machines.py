"""State machines over feeds of actions: runs of steps and controls with a stack of snapshots, and status tables with an audit trail.

The rules are here once; `run_actions` and `audit_statuses` apply them to sorted rows in batches, streaming/machines.py to a stream
with Spark's keyed state. A refused action changes nothing and gives its reason.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

#: Columns of a feed of actions besides the run's key: its order, what is done, to what; needs and confirm come with add_step.
FEED = "seq bigint, action string, target string, needs array<string>, confirm boolean"
OUTCOME = "seq bigint, action string, target string, accepted boolean, code string, target_status string, run_status string, current string, n_trace bigint, n_snapshots int"
AUDIT = "seq bigint, event_id string, kind string, from_status string, to_status string, accepted boolean, code string, n_events bigint"
# Which status may follow which in the run of an agent, and the codes of refusals.
AGENT = {
    "created": ["running", "blocked", "failed", "canceled"],
    "running": ["waiting_for_approval", "applying_patch", "validating", "completed", "blocked", "failed", "canceled"],
    "waiting_for_approval": ["running", "applying_patch", "validating", "blocked", "failed", "canceled"],
    "applying_patch": ["validating", "completed", "blocked", "failed", "canceled"],
    "validating": ["running", "waiting_for_approval", "completed", "blocked", "failed", "canceled"],
    "blocked": ["running", "failed", "canceled"],
    "completed": [],
    "failed": [],
    "canceled": [],
}
STEP_REFUSED, CONTROL_REFUSED, STATUS_REFUSED, CLOSED = "E_RUNTIME_STEP_NOT_READY", "E_RUNTIME_CONTROL", "invalid_status_transition", "after_terminal_status"


@dataclass
class Run:
    """A run's state: steps by name as [status, needs, confirm], controls by name as status, the trace's length, and its snapshots up to the cursor and beyond."""

    steps: dict[str, list] = field(default_factory=dict)
    controls: dict[str, str] = field(default_factory=dict)
    status: str = "planned"
    current: str | None = None
    trace: int = 0
    snapshots: list[tuple] = field(default_factory=list)
    cursor: int = -1

    def view(self) -> tuple:
        return {k: s[0] for k, s in self.steps.items()}, dict(self.controls), self.status, self.current

    def show(self, view: tuple) -> None:
        """Put a snapshot's statuses back; steps and controls added since keep their own."""
        for k, status in view[0].items():
            self.steps[k][0] = status
        self.controls |= view[1]
        self.status, self.current = view[2:]

    def done(self, name: str) -> bool:
        return self.controls.get(name) == "completed" or (name in self.steps and self.steps[name][0] == "completed")

    def refresh(self) -> None:
        """Planned steps whose needs are all completed become ready, or wait for confirmation; the first open step is current."""
        for step in self.steps.values():
            if step[0] == "planned" and all(self.done(n) for n in step[1]):
                step[0] = "waiting_confirmation" if step[2] else "ready"
        self.status = "completed" if all(s[0] in ("completed", "skipped") for s in self.steps.values()) else "running"
        self.current = next((k for k, s in self.steps.items() if s[0] in ("running", "ready", "waiting_confirmation")), None)

    def act(self, action: str | None, target: str | None, needs: list[str] | None = None, confirm: bool | None = None) -> tuple[bool, str | None]:
        """Do what the action says, or refuse it: whether it was done, and the code of the refusal."""
        step, control = self.steps.get(target), self.controls.get(target)
        if action == "add_step":
            if target is None or step or control:
                return False, STEP_REFUSED
            self.steps[target] = ["planned" if needs else "waiting_confirmation" if confirm else "ready", list(needs or ()), bool(confirm)]
        elif action == "add_control":
            if target is None or step or control:
                return False, CONTROL_REFUSED
            self.controls[target] = "planned"
        elif action in ("start_step", "complete_step"):
            if not step or step[0] != ("ready" if action == "start_step" else "running"):
                self.trace += 1  # the refusal is a trace event of its own
                return False, STEP_REFUSED
            self.trace += 1
            if action == "start_step":
                step[0], self.status, self.current = "running", "running", target
            else:
                step[0] = "completed"
                self.refresh()
        elif action == "confirm_step":
            if not step or step[0] != "waiting_confirmation":
                return False, None
            step[0] = "ready"
            self.trace += 2  # what the operator did, and what it granted
        elif action == "fail_step":
            if step:
                step[0] = "failed"
            self.status = "failed"
            self.trace += 1
        elif action in ("enter_control", "complete_control", "block_control", "abort_control"):
            allowed = {"enter_control": control in ("planned", "waiting_adapter"), "complete_control": control == "running"}.get(action, control is not None)
            self.trace += 1
            if not allowed:
                return False, CONTROL_REFUSED
            self.controls[target] = {"enter_control": "running", "complete_control": "completed", "block_control": "blocked", "abort_control": "aborted"}[action]
            if action == "complete_control":
                self.refresh()
            else:
                self.status = {"enter_control": "running", "block_control": "paused", "abort_control": "aborted"}[action]
        elif action == "push":
            self.snapshots = [*self.snapshots[: self.cursor + 1], self.view()]  # what lies after the cursor is dropped
            self.cursor = len(self.snapshots) - 1
        elif action == "restore":
            at = int(target) if target is not None and target.isdecimal() else -1
            if not 0 <= at < len(self.snapshots):
                return False, "unknown_snapshot"
            self.cursor = at
            self.show(self.snapshots[at])
        else:
            return False, "unknown_action"
        return True, None

    def outcome(self, seq: int, action: str | None, target: str | None, needs=None, confirm=None) -> tuple:
        accepted, code = self.act(action, target, needs, confirm)
        of = self.steps[target][0] if target in self.steps else self.controls.get(target)
        return seq, action, target, accepted, code, of, self.status, self.current, self.trace, len(self.snapshots)


def planned(plan: list[tuple[str, list[str] | None, bool]]) -> Run:
    """A run with a plan: (name, needs, confirm) for steps, (name, None, False) for controls."""
    run = Run()
    for name, needs, confirm in plan:
        run.act("add_control" if needs is None else "add_step", name, needs, confirm)
    return run


@dataclass
class Status:
    """A status under a table of transitions, with the number of audit events so far."""

    status: str
    events: int = 0

    def outcome(self, key: object, seq: int, kind: str, to: str | None, table: dict[str, list[str]]) -> tuple:
        """A `transition` is done if it is in the table or changes nothing; other kinds only while the status has a way out, and they may bring a status too."""
        was = self.status
        if kind == "transition":
            done, code = (to in table and (to == was or to in table[was])), STATUS_REFUSED
        else:
            done, code = bool(table[was]), CLOSED
        if done:
            self.events += 1
            self.status = to if to in table else was
        return seq, f"{key}:event:{self.events}" if done else None, kind, was, self.status if done else to, done, None if done else code, self.events


def in_order(feed: DataFrame, key: str, fields: list[str], schema: str, begin: Callable[[], object], act: Callable[[object, object, tuple], tuple]) -> DataFrame:
    """What `act` makes of each row of a feed, key by key in order of seq: rows are sorted in Spark, and only one key's state is held at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        names = [key, *(f.split()[0] for f in schema.split(", "))]
        for pdf in batches:
            made = []
            for row in pdf.itertuples(index=False, name=None):
                if state is None or row[0] != now:
                    now, state = row[0], begin()
                made.append((now, *act(state, now, row[1:])))
            yield pd.DataFrame(made, columns=names, dtype=object)

    rows = feed.where(feed[key].isNotNull()).select(key, *fields).repartition(key).sortWithinPartitions(key, "seq", *[f for f in fields if f not in ("seq", "needs")])
    return rows.mapInPandas(run, f"{key} {dict(feed.dtypes)[key]}, {schema}")


def run_actions(feed: DataFrame, key: str, plan: list[tuple[str, list[str] | None, bool]] = ()) -> DataFrame:
    """Outcomes of a feed of actions (key and FEED), each run beginning with the plan: key and OUTCOME, one row an action.

    Rows without a key belong to no run. Equal seqs are taken in order of action and target. Null or unknown actions are refused.
    """
    begin = lambda: planned(plan)
    return in_order(feed, key, ["seq", "action", "target", "needs", "confirm"], OUTCOME, begin, lambda run, _, row: run.outcome(row[0], row[1], row[2], list(row[3]) if row[3] is not None else None, row[4]))


def audit_statuses(feed: DataFrame, key: str, table: dict[str, list[str]] = AGENT, first: str = "created") -> DataFrame:
    """The audit trail of a feed (key, seq, kind, to) under a table of transitions: key and AUDIT, refusals too."""
    return in_order(feed, key, ["seq", "kind", "to"], AUDIT, lambda: Status(first), lambda s, k, row: s.outcome(k, *row, table))
