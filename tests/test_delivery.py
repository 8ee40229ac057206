"""Deliveries are tried again by timers until they succeed or are given up, whatever repeats."""

import datetime

from pyspark.sql import functions as F

from postmill.streaming import delivery

START = datetime.datetime(2024, 5, 1)
LIMITS = {"most": 3, "first": 60, "longest": 100, "keep": 600}


def minutes(*at):
    return [START + datetime.timedelta(minutes=m) for m in at]


def test_every_failed_key_is_tried_again(spark, tmp_path):
    folder = str(tmp_path)
    keys = spark.createDataFrame([("a1",), ("b2",), ("c3",), ("d9",), ("a1",), (None,)], "event_key string")  # the digit is the attempt that succeeds
    delivery.queue(keys, folder, START)
    asked = []

    def send(due):
        asked.extend(sorted(map(tuple, due.collect())))
        return due.withColumn("ok", F.col("attempt") >= F.substring("event_key", 2, 1).cast("int"))

    got = delivery.deliver_in_rounds(spark, folder, send, minutes(0.1), **LIMITS)
    assert sorted(map(tuple, got.collect())) == [(k, "due", 1) for k in ("a1", "b2", "c3", "d9")]
    delivery.deliver_in_rounds(spark, folder, send, minutes(0.5), **LIMITS)  # nothing is due yet
    assert len(asked) == 4
    delivery.queue(keys, folder, minutes(0.6)[0])  # queued again
    got = delivery.deliver_in_rounds(spark, folder, send, minutes(2, 2.2, 4, 4.2), **LIMITS)
    rows = sorted(map(tuple, got.collect()))
    assert asked[4:] == [("b2", 2), ("c3", 2), ("d9", 2), ("c3", 3), ("d9", 3)]
    assert rows == sorted(
        [("a1", "due", 1), ("a1", "sent", 1), ("b2", "due", 1), ("b2", "due", 2), ("b2", "sent", 2)]
        + [(k, "due", n) for k in ("c3", "d9") for n in (1, 2, 3)] + [("c3", "sent", 3), ("d9", "gave_up", 3)]
    )


def test_state_is_dropped_after_success(spark, tmp_path):
    folder = str(tmp_path)
    delivery.queue(spark.createDataFrame([("x",), ("y",)], "event_key string"), folder, START)
    rounds = minutes(0.1, 0.2, 20, 20.1)
    delivery.deliver_in_rounds(spark, folder, lambda due: due.withColumn("ok", F.lit(True)), rounds, **LIMITS)
    left = spark.read.format("statestore").option("stateVarName", "seen").load(f"{folder}/checkpoint")
    assert left.count() == 0


def test_keys_of_a_shard_wake_up_each_at_its_own_time(spark, tmp_path):
    folder, calls = str(tmp_path), []
    names = [f"k{n}" for n in range(40)]
    delivery.queue(spark.createDataFrame([(n,) for n in names[:20]], "event_key string"), folder, START)

    def send(due):
        calls.append(sorted(map(tuple, due.collect())))
        return due.withColumn("ok", F.col("attempt") > 1)

    delivery.deliver_in_rounds(spark, folder, send, minutes(0.1), shards=1, **LIMITS)
    delivery.queue(spark.createDataFrame([(n,) for n in names[20:]], "event_key string"), folder, minutes(0.9)[0])
    got = delivery.deliver_in_rounds(spark, folder, send, minutes(1, 1.3, 1.5, 2.2, 2.4), shards=1, **LIMITS)
    assert [c for c in calls if c] == [sorted((n, 1) for n in names[:20]), sorted((n, 1) for n in names[20:]), sorted((n, 2) for n in names[:20]), sorted((n, 2) for n in names[20:])]
    assert sorted(r.event_key for r in got.where("action = 'sent' and attempt = 2").collect()) == sorted(names)
    state = spark.read.format("statestore").option("stateVarName", "seen").load(f"{folder}/checkpoint")
    assert state.count() == 1
