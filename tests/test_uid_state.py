"""States of fetches from logs of several batches, in any order."""

import datetime
import random
from functools import partial

import pandas as pd

from postmill.plans import streams
from postmill.streaming import flows


class Held:
    """A state of one uid, as the streaming operator has it."""

    exists = False

    def update(self, value):
        self.get, self.exists = value, True


def replayed(rows):
    out = set()
    for uid in {r[0] for r in rows}:
        part = pd.DataFrame([r[1:] for r in sorted(rows) if r[0] == uid], columns=["event_id", "outcome"])
        out |= {tuple(r) for frame in flows._advance((uid,), iter([part]), Held()) for r in frame.itertuples(index=False)}
    return out


def test_states_of_a_log_equal_its_replay(spark):
    rng = random.Random(7)
    rows = [(0 if rng.random() < 0.3 else rng.randrange(60), k, rng.choices(["fail", "retry", "skip", "ok"], [8, 4, 1, 1])[0]) for k in range(3000)]
    want = replayed(rows)
    assert {r[2] for r in want} == {"failed", "quarantined", "dead", "retry_pending", "skipped", "fetched"}
    rng.shuffle(rows)
    got = flows.states_of(spark.createDataFrame(rows + rows[:500], "uid long, event_id long, outcome string")).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_every_batch_counts(spark, tmp_path, monkeypatch):
    start = datetime.datetime(2024, 1, 1)
    kinds = {"fail": "view", "retry": "click", "ok": "purchase"}
    files = [[(1, 5, "fail"), (2, 6, "fail")], [(1, 1, "ok"), (1, 2, "fail"), (3, 3, "ok")], [(1, 4, "fail"), (4, 7, "retry"), (1, 8, "retry")]]
    for rows in files:
        spark.createDataFrame([(e, start, u, kinds[o]) for u, e, o in rows], "event_id long, ts timestamp_ntz, user_id long, event_type string").coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(flows, "stream", partial(flows.stream, files_per_batch=1))
    got = streams.uid_state(spark, str(tmp_path))
    assert got.columns == ["uid", "attempts", "status", "last_event"]
    assert {tuple(r) for r in got.collect()} == replayed([r for rows in files for r in rows])
