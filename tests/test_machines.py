"""State machines: rules by hand, batch against stream, and a stream that stops and goes on."""

from ferrograph.operators.machines import FEED, audit_statuses, planned, run_actions
from ferrograph.streaming.machines import replay_actions

PLAN = [("a", [], False), ("b", ["a"], True), ("c", ["b", "gate"], False), ("gate", None, False)]


def test_steps_wait_for_what_they_need():
    run = planned(PLAN)
    assert run.view()[0] == {"a": "ready", "b": "planned", "c": "planned"}
    assert run.act("start_step", "b") == (False, "E_RUNTIME_STEP_NOT_READY") and run.trace == 1
    assert run.act("complete_step", "a")[0] is False and run.act("start_step", "none") == (False, "E_RUNTIME_STEP_NOT_READY")
    assert run.act("start_step", "a") == (True, None) and run.current == "a" and run.act("complete_step", "a") == (True, None)
    assert run.view()[0]["b"] == "waiting_confirmation" and run.current == "b"
    assert run.act("start_step", "b")[0] is False and run.act("confirm_step", "b") == (True, None) and run.act("confirm_step", "b") == (False, None)
    assert run.act("start_step", "b")[0] and run.act("complete_step", "b")[0] and run.view()[0]["c"] == "planned"
    assert run.act("complete_control", "gate") == (False, "E_RUNTIME_CONTROL") and run.act("enter_control", "gate")[0]
    assert run.act("enter_control", "gate")[0] is False and run.act("complete_control", "gate")[0] and run.view()[0]["c"] == "ready"
    assert run.act("start_step", "c")[0] and run.act("complete_step", "c")[0] and run.status == "completed"
    assert run.act("fail_step", "c")[0] and run.status == "failed" and run.act(None, None) == (False, "unknown_action")


def test_a_push_drops_what_lies_after_the_cursor():
    run = planned(PLAN)
    run.act("push", None)
    run.act("start_step", "a")
    run.act("push", None)
    run.act("complete_step", "a")
    run.act("push", None)
    assert len(run.snapshots) == 3 and run.act("restore", "3") == (False, "unknown_snapshot") and run.act("restore", "x")[0] is False
    assert run.act("restore", "0")[0] and run.view()[0]["a"] == "ready" and run.act("restore", "2")[0] and run.view()[0]["b"] == "waiting_confirmation"
    assert run.act("restore", "1")[0] and run.view()[0]["a"] == "running" and run.status == "running"
    run.act("fail_step", "a")
    run.act("push", None)
    assert len(run.snapshots) == 3 and run.snapshots[2][0]["a"] == "failed" and run.cursor == 2


def feed(n, runs=(1, 2, 3)):
    kinds = ["start_step", "complete_step", "push", "confirm_step", "start_step", "complete_step", "enter_control", "restore", "complete_control", "push", "fail_step", None]
    return [(r, i, kinds[(i * (r + 1)) % 12], {"restore": str(i % 3), "enter_control": "gate", "complete_control": "gate"}.get(kinds[(i * (r + 1)) % 12], "abc"[(i // 3 + r) % 3]), None, None) for r in runs for i in range(n)]


def by_hand(rows):
    runs, out = {}, []
    for r, seq, action, target, needs, confirm in sorted(rows, key=lambda x: (x[0], x[1])):
        out.append((r, *runs.setdefault(r, planned(PLAN)).outcome(seq, action, target, needs, confirm)))
    return sorted(map(str, out))


def test_batch_and_stream_give_one_table_and_a_stream_goes_on(spark, tmp_path):
    schema = f"run bigint, {FEED}"
    rows = feed(40) + [(9, 0, "add_step", "x", ["a"], True), (9, 1, "add_step", "x", None, None), (9, 2, "add_control", "y", None, None), (9, 50, "start_step", "x", None, None)]
    table = spark.createDataFrame(rows, schema)
    wanted = by_hand(rows)
    assert sorted(str(tuple(x)) for x in run_actions(table.repartition(3), "run", PLAN).collect()) == wanted
    folder, at = f"{tmp_path}/in", f"{tmp_path}/at"
    source = lambda: spark.readStream.schema(schema).parquet(folder)
    table.where("seq < 15").coalesce(1).write.parquet(folder)
    first = replay_actions(spark, source(), "run", PLAN, at).collect()
    assert len(first) == 15 * 3 + 3
    again = replay_actions(spark, source(), "run", PLAN, at).collect()  # nothing new: nothing is delivered twice
    assert len(again) == len(first)
    table.where("seq >= 15").coalesce(1).write.mode("append").parquet(folder)
    assert sorted(str(tuple(x)) for x in replay_actions(spark, source(), "run", PLAN, at).collect()) == wanted


def test_empty_feed(spark):
    assert run_actions(spark.createDataFrame([(None, 1, "push", None, None, None)], f"run bigint, {FEED}"), "run").count() == 0


def test_audit_of_statuses(spark):
    rows = [("r", 1, "transition", "running"), ("r", 2, "transition", "created"), ("r", 3, "patch_proposed", "waiting_for_approval"), ("r", 4, "tool_call", None), ("r", 5, "transition", "failed"), ("r", 6, "tool_call", None), ("r", 7, "transition", "failed"), ("r", 8, "transition", None)]
    got = [(x["seq"], x["event_id"], x["from_status"], x["accepted"], x["code"]) for x in audit_statuses(spark.createDataFrame(rows, "run string, seq bigint, kind string, to string"), "run").orderBy("seq").collect()]
    assert got == [
        (1, "r:event:1", "created", True, None), (2, None, "running", False, "invalid_status_transition"), (3, "r:event:2", "running", True, None), (4, "r:event:3", "waiting_for_approval", True, None),
        (5, "r:event:4", "waiting_for_approval", True, None), (6, None, "failed", False, "after_terminal_status"), (7, "r:event:5", "failed", True, None), (8, None, "failed", False, "invalid_status_transition"),
    ]
