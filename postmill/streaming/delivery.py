"""Delivery with retries as a stream: what was queued is due at once, what failed wakes up by a timer, what went out leaves no state."""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LOG = "event_key string, at timestamp, attempt int, ok boolean"
ACTIONS = "event_key string, action string, attempt int"


#: Groups of keys by hash; a group's keys share one row of state, one timer and one call a batch.
SHARDS = 256


def _actions(out: list[tuple[str, str, int]]) -> pd.DataFrame:
    keys, actions, attempts = zip(*out) if out else ((), (), ())
    return pd.DataFrame({"event_key": pd.Series(keys, dtype=object), "action": pd.Series(actions, dtype=object), "attempt": pd.Series(attempts, dtype="int32")})


class Retries(StatefulProcessor):
    """The state of a key is its number of attempts, whether it is done, and when it wakes up; it goes once ``keep`` seconds have passed since.

    The group is a shard of keys: its state is one row of lists, and its timer stands at the earliest time that a key of it
    wakes up, so that a batch costs a call a shard and not a call a key.
    """

    def __init__(self, most: int, first: float, longest: float, keep: float):
        self.most, self.first, self.longest, self.keep = most, first, longest, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "event_key array<string>, tries array<int>, done array<boolean>, wake array<long>")

    def _load(self) -> dict[str, tuple[int, bool, int]]:
        state = self.seen.get()
        return {k: (n, done, wake) for k, n, done, wake in zip(*state)} if state else {}

    def _save(self, keys: dict[str, tuple[int, bool, int]]) -> None:
        """Keep the keys and set the timer; timers set before are not looked up but find nothing that is due."""
        if not keys:
            self.seen.clear()
            return
        tries, done, wake = zip(*keys.values())
        self.seen.update((list(keys), list(tries), list(done), list(wake)))
        self.handle.registerTimer(min(wake))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        log = pd.concat(list(rows))
        log = log[log["event_key"] != ""].sort_values(["attempt", "ok"], ascending=[True, False])  # what only tells the time is no event
        out: list[tuple[str, str, int]] = []
        keys = self._load() if len(log) else {}
        changed = False
        for k, at, attempt, ok in zip(log["event_key"].tolist(), log["at_ms"].tolist(), log["attempt"].tolist(), log["ok"].tolist()):
            tries, done, _ = keys.get(k, (0, False, 0))
            if done or (attempt and attempt <= tries) or (attempt == 0 and k in keys):
                continue  # a repeated row
            if attempt == 0:
                out.append((k, "due", 1))
            elif ok:
                tries, done = int(attempt), True
                out.append((k, "sent", tries))
            else:
                tries, done = int(attempt), attempt >= self.most
                if done:
                    out.append((k, "gave_up", tries))
            seconds = self.keep if done or not tries else min(self.longest, self.first * 2 ** (tries - 1))
            keys[k], changed = (tries, bool(done), int(at + seconds * 1000)), True
        if changed:
            self._save(keys)
        yield _actions(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        keys, out, changed = self._load(), [], False
        for k in [k for k, (_, _, wake) in keys.items() if wake <= now]:
            tries, done, wake = keys[k]
            if done:
                del keys[k]
            else:  # also what was due and never came back is due again
                keys[k] = (tries, done, int(wake + self.keep * 1000))
                out.append((k, "due", tries + 1))
            changed = True
        if changed:
            self._save(keys)
        if out:
            yield _actions(out)

    def close(self) -> None:
        pass


def retries(log: DataFrame, most: int = 8, first: float = 60, longest: float = 3600, keep: float = 86400, late: str = "1 second", shards: int = SHARDS) -> DataFrame:
    """(event_key, action, attempt) from a stream of (event_key, at, attempt, ok): attempt 0 is queued, later ones are results.

    Actions: ``due`` (send it as this attempt), ``sent``, ``gave_up`` after ``most`` attempts. A failure is due again after
    ``first`` seconds, doubled by each further one up to ``longest``; a key whose result never comes is due again after
    ``keep`` seconds, and what is done is forgotten after as many. ``at`` is when a row comes into the log, and time is the
    latest of all rows: rows without a key do nothing else but tell the time. Repeated rows change nothing; of two results
    of one attempt, success counts. A null ok is a failure. A task holds the open keys of one shard at a time, so ``shards``
    grows with them; it stays as it is for one checkpoint. The session needs the RocksDB state store (``deliver_in_rounds``).
    """
    rows = log.withWatermark("at", late).withColumn("ok", F.coalesce("ok", F.lit(False))).where("event_key is not null or attempt is null")
    keyed = rows.withColumn("event_key", F.coalesce("event_key", F.lit(""))).withColumn("attempt", F.coalesce("attempt", F.lit(-1)))
    keyed = keyed.withColumn("shard", F.pmod(F.xxhash64("event_key"), F.lit(shards))).withColumn("at_ms", F.unix_millis("at"))
    return keyed.groupBy("shard").transformWithStateInPandas(Retries(most, first, longest, keep), outputStructType=ACTIONS, outputMode="append", timeMode="EventTime")


def queue(outbox: DataFrame, folder: str, at: datetime.datetime) -> None:
    """Put the keys of ``outbox`` into the log in ``folder``, as of ``at``."""
    rows = outbox.select(F.col("event_key").cast("string").alias("event_key"), F.lit(at).cast("timestamp").alias("at"), F.lit(0).alias("attempt"), F.lit(None).cast("boolean").alias("ok"))
    rows.where("event_key <> ''").write.mode("append").parquet(f"{folder}/log")


def deliver_in_rounds(spark: SparkSession, folder: str, send: Callable[[DataFrame], DataFrame], times: Iterable[datetime.datetime], **limits) -> DataFrame:
    """Deliver what ``queue`` put into ``folder``: at each of ``times`` all that is due is sent, and results go back into the log.

    ``send`` takes (event_key, attempt) and gives (event_key, ok) besides. Gives (event_key, action, attempt), all actions so
    far. A batch that is run again replaces its actions; its results repeat in the log, which changes nothing. Sending is
    at least once: the receiver knows a repeated key.
    """
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, ROCKSDB)
    try:
        for now in times:
            tick = spark.createDataFrame([(None, None, None)], "event_key string, attempt int, ok boolean").withColumn("at", F.lit(now).cast("timestamp"))
            tick.select("event_key", "at", "attempt", "ok").write.mode("append").parquet(f"{folder}/log")

            def batch(actions: DataFrame, number: int, now=now) -> None:
                path = f"{folder}/actions/batch={number}"
                actions.write.mode("overwrite").parquet(path)
                done = actions.sparkSession.read.schema(ACTIONS).parquet(path)
                results = send(done.where("action = 'due'").select("event_key", "attempt"))
                results.select("event_key", F.lit(now).cast("timestamp").alias("at"), "attempt", "ok").write.mode("append").parquet(f"{folder}/log")

            log = spark.readStream.schema(LOG).parquet(f"{folder}/log")
            stream = retries(log, **limits).writeStream.foreachBatch(batch).outputMode("append").option("checkpointLocation", f"{folder}/checkpoint")
            stream.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(setting, before)
    return spark.read.schema(ACTIONS).parquet(f"{folder}/actions/batch=*")
