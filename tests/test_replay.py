"""Replays equal a plain loop over the sorted log, also where a case is cut into many pieces and levels."""

import random

import pytest
from pyspark.sql import functions as F

from postmill.operators import replay as R

MACHINE = R.Machine(("new", "open", "held", "done"), {"go": {"new": "open", "held": "open"}, "hold": {"open": "held"}, "end": {"open": "done", "held": "done"}, "undo": {"done": "open"}})
NAMES = {"key": "case_id", "at": "at", "id": "id", "event": "what"}
SCHEMA = "case_id long, at long, id long, what string, before string, k int"


def looped(rows):
    """(case, step, at, id, event, before, after) in order; rows of one case, time and id are one, the lowest event counts."""
    events = {}
    for case, at, id, what, *_ in rows:
        if case is not None:
            events.setdefault((case, at, id), []).append(what)
    first = lambda x: (x is not None, x or 0)
    out, state, step = [], {}, {}
    for (case, at, id), names in sorted(events.items(), key=lambda e: (e[0][0], first(e[0][1]), first(e[0][2]))):
        what = min((n for n in names if n is not None), default=None)
        before = state.get(case, "new")
        state[case] = MACHINE.moves.get(what, {}).get(before, before)
        step[case] = step.get(case, 0) + 1
        out.append((case, step[case], at, id, what, before, state[case]))
    return out


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(3)
    # a third of all events are of case 1; times tie, some are null, rows repeat, some events are unknown
    found = [(1 if draw.random() < 0.33 else draw.randrange(2, 60), draw.choice([None, *range(200)]), draw.choice([None, *range(30)]), draw.choice(["go", "hold", "end", "undo", "else", None]), "x", 0) for _ in range(2500)]
    return found + found[:50] + [(None, 1, 1, "go", "x", 0), (99, None, None, None, None, None)]


@pytest.mark.parametrize("fan", [3, 256])
def test_replay_and_trace_equal_a_loop(spark, rows, tmp_path, monkeypatch, fan):
    monkeypatch.setattr(R, "FAN", fan)
    log = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = looped(rows)
    got = R.trace(log, MACHINE, str(tmp_path / "trace"), **NAMES).collect()
    assert sorted(map(tuple, got), key=lambda r: r[:2]) == want
    last = {}
    for case, step, at, _, _, _, after in want:
        last[case] = (after, step, max([x for x in (at, last.get(case, (0, 0, None))[2]) if x is not None], default=None))
    assert {r.case_id: (r.state, r.n_events, r.last_at) for r in R.replay(log, MACHINE, str(tmp_path / "replay"), **NAMES).collect()} == last


def test_a_large_case_is_cut(spark, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(R, "FAN", 8)
    log = spark.createDataFrame(rows, SCHEMA)
    blocks = R._blocks(R._log(log, **NAMES), MACHINE, str(tmp_path))
    sizes = {r.key: (r.blocks, r.most, r.n) for r in blocks.groupBy("key").agg(F.count("*").alias("blocks"), F.max(F.size("events")).alias("most"), F.sum("n").alias("n")).collect()}
    assert all(most <= 8 and count == -(-n // 8) for count, most, n in sizes.values()) and sizes[1][0] > 60
    levels = R._levels(blocks, MACHINE, str(tmp_path))
    assert len(levels) >= 3 and {r.key for r in levels[-1].collect()} == {1}
    assert all(level.select(F.max(F.size("children"))).first()[0] <= 8 for level in levels[1:])


def test_state_at_any_time(spark, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(R, "FAN", 5)
    asked = [(case, at) for case in (1, 2, 7, 1000) for at in (-1, 0, 50, 50, 199, 500)] + [(None, 3), (1, None)]
    log, moments = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(asked, "case_id int, moment long")
    want = {}
    for case, at in asked:
        if case is not None and at is not None:
            seen = [r[6] for r in looped(rows) if r[0] == case and (r[2] is None or r[2] <= at)]
            want[case, at] = seen[-1] if seen else "new"
    got = R.as_of(log, moments, MACHINE, str(tmp_path), **NAMES).collect()
    assert {(r.case_id, r.moment): r.state for r in got} == want and len(got) == len(want)


def test_empty_log_and_timeline(spark, rows, tmp_path):
    log = spark.createDataFrame(rows, SCHEMA)
    for run in (R.replay, R.trace):
        assert run(log.limit(0), MACHINE, str(tmp_path / run.__name__), **NAMES).count() == 0
    steps = spark.createDataFrame([(1, 5, "new", "open"), (1, 6, "open", "open"), (1, 7, "open", "held"), (1, 9, "held", "open"), (2, 1, "new", "new")], "case_id long, at long, before string, after string")
    got = {(r.case_id, r.stage): (r.entered_at, r.left_at, r.times) for r in R.timeline(steps, "case_id", "at").collect()}
    assert got == {(1, "new"): (None, 5, 0), (1, "open"): (5, 7, 2), (1, "held"): (7, 9, 1)}
