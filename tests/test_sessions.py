"""The session state machine: guards, timers, and the same answer however the steps come in."""

import datetime as dt

from sentilake.functions import fixed_values as V
from sentilake.streaming import events, sessions

KINDS = "session string, at timestamp, seq long, action string"
START = dt.datetime(2024, 1, 1)


def test_guards():
    assert [sessions.step(s, "", "start") is not None for s in (V.IDLE, V.FAILED, V.COMPLETED, V.WAITING, *V.PHASES)] == [True] * 3 + [False] * 6
    status = V.PHASES[0]
    for after in (*V.PHASES[1:], V.COMPLETED):
        status, _ = sessions.step(status, "", "advance")
        assert status == after
    assert sessions.step(V.COMPLETED, "", "advance") is None and sessions.step(V.IDLE, "", "fail") is None and sessions.step(V.IDLE, "", "no such") is None
    assert sessions.step("cleaning", "", "ask") == (V.WAITING, "cleaning") and sessions.step(V.WAITING, "cleaning", "answer") == ("cleaning", "")
    assert sessions.step(V.WAITING, "cleaning", "ask") is None and sessions.step(V.WAITING, "cleaning", "fail") == (V.FAILED, "")


def run(spark, path, rows, lots):
    for i in range(lots):
        spark.createDataFrame(rows[i::lots], KINDS).coalesce(1).write.mode("append").parquet(path)
    out = sessions.replayed(spark, events.parquet_stream(spark, path)).collect()
    return sorted((r.session, r.at, r.seq or 0, r.action, r.before, r.after, r.accepted) for r in out)


def test_steps_are_taken_in_order_and_timers_fire(spark, tmp_path):
    at = lambda hours: START + dt.timedelta(hours=hours)
    rows = [("a", at(0), 1, "start"), ("a", at(1), 2, "advance"), ("a", at(1), 3, "ask"), ("a", at(1), 4, "advance"), ("a", at(2), 5, "answer"), ("a", at(30), 6, "advance"), ("a", at(31), 7, "start"), ("b", at(1), 8, "advance"), ("c", at(5), 9, "start"), (None, at(1), 10, "start"), ("d", None, 11, "start"), ("e", at(90), 12, "start")]
    got = run(spark, str(tmp_path / "in"), rows[::-1], 3)
    a = [(s, b, z, ok) for k, _, _, s, b, z, ok in got if k == "a"]
    assert a == [
        ("start", "idle", "planning", True), ("advance", "planning", "searching", True), ("ask", "searching", V.WAITING, True), ("advance", V.WAITING, V.WAITING, False), ("answer", V.WAITING, "searching", True),
        ("timeout", "searching", V.FAILED, True), ("advance", V.FAILED, V.FAILED, False), ("start", V.FAILED, "planning", True), ("timeout", "planning", V.FAILED, True),
    ]
    assert [(k, t, s) for k, t, _, s, *_ in got if k in ("b", "c", "d", "e")] == [("b", at(1), "advance"), ("c", at(5), "start"), ("c", at(29), "timeout"), ("e", at(90), "start")]


def test_no_steps(spark, tmp_path):
    assert run(spark, str(tmp_path / "in"), [("a", None, 1, "start")], 1) == []

