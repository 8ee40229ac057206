"""Structured Streaming: ingest with dedup, tumbling counts, and the state machine of failed fetches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Attempts from which a fetch is quarantined, and from which it is given up.
QUARANTINE, DEAD = 3, 5


def stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream over the Parquet files of a folder, or of one file, with the schema that they have."""
    schema = spark.read.parquet(path).schema
    pattern = path if any(c in path for c in "*?[{") else f"{path[:-1]}[{path[-1]}]"  # as a pattern, the path may name a file
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(pattern)


def tumbling(events: DataFrame, every: str, late: str = "1 day", keys: tuple[str, ...] = ()) -> DataFrame:
    """Counts and sums of ``value`` in windows of ``every``; rows later than ``late`` are left out of closed windows."""
    g = events.withWatermark("at", late).groupBy(F.window("at", every), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("window.start").alias("start"), *keys, "n", "total")


def trailing(events: DataFrame, span: str = "1 hour", step: str = "15 minutes", late: str = "1 day") -> DataFrame:
    g = events.withWatermark("at", late).groupBy(F.window("at", span, step)).agg(F.count("*").alias("n"))
    return g.select(F.col("window.end").alias("until"), "n")


def sessions(events: DataFrame, key: str, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    g = events.withWatermark("at", late).groupBy(key, F.session_window("at", gap)).agg(F.count("*").alias("n"))
    return g.select(key, F.col("session_window.start").alias("start"), "n")


def dedup(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """The first row of each key; state is dropped once the watermark has passed a row's time by ``late``."""
    return events.withWatermark("at", late).dropDuplicatesWithinWatermark(keys)


def fetch_status(attempts: int) -> str:
    return "dead" if attempts >= DEAD else "quarantined" if attempts >= QUARANTINE else "failed"


def _advance(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    attempts, status, last = state.get if state.exists else (0, "new", -1)
    rows = pd.concat(list(parts)).sort_values("event_id")
    rows = rows[rows["event_id"] > last]  # a replayed row changes nothing
    for event, at in zip(rows["outcome"], rows["event_id"]):
        last = int(at)
        if event == "fail":
            attempts += 1
            status = fetch_status(attempts)
        elif event == "retry" and status == "quarantined":
            status = "retry_pending"
        elif event == "skip":
            status = "skipped"
        elif event == "ok":
            attempts, status = 0, "fetched"
    state.update((attempts, status, last))
    yield pd.DataFrame({"uid": [key[0]], "attempts": [attempts], "status": [status], "last_event": [last]})


def fetch_states(log: DataFrame) -> DataFrame:
    """(uid, attempts, status, last_event) after each batch from a log of (uid, event_id, outcome): fail, retry, skip or ok.

    The events of one uid in one batch are its retries since the last trigger, a handful; they are replayed in order, and
    event_id rises from batch to batch: a lower one is a replay. For logs in any order and of any length: ``states_of``.
    """
    return log.groupBy("uid").applyInPandasWithState(_advance, "uid long, attempts long, status string, last_event long", "attempts long, status string, last long", "update", GroupStateTimeout.NoTimeout)


def states_of(log: DataFrame) -> DataFrame:
    """(uid, attempts, status, last_event) after a whole log of (uid, event_id, outcome), whatever the order of its rows.

    Rows that repeat a uid and event_id are one event; of several outcomes the lowest counts. Events without an id change
    nothing. The log is cut into even ranges of event_id, so that no task has all events of a frequent uid; a uid has one
    row a range after that.
    """
    parts = int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at, out = F.col("event_id"), F.col("outcome")
    log = log.groupBy("uid", "event_id").agg(F.min("outcome").alias("outcome")).repartitionByRange(parts, "event_id").withColumn("range", F.spark_partition_id())
    log = log.withColumn("ok", F.max(F.when(out == "ok", at)).over(Window.partitionBy("uid", "range")))
    ranges = log.groupBy("uid", "range").agg(
        F.count_if((out == "fail") & at.isNotNull() & (F.col("ok").isNull() | (at > F.col("ok")))).alias("fails"), F.max("ok").alias("ok"), F.max(at).alias("last"),
        F.max(F.when(out.isin("fail", "skip", "ok") & at.isNotNull(), F.struct(at.alias("at"), out.alias("to")))).alias("set"), F.max(F.when(out == "retry", at)).alias("retry"),
    )
    ends = ranges.groupBy("uid").agg(F.collect_list(F.struct("range", "fails")).alias("fails"), F.max(F.when(F.col("ok").isNotNull(), F.col("range"))).alias("since"), F.max("last").alias("last"), F.max("set").alias("set"), F.max("retry").alias("retry"))
    attempts = F.aggregate(F.filter("fails", lambda r: r["range"] >= F.coalesce("since", F.lit(-1))), F.lit(0).cast("long"), lambda n, r: n + r["fails"])
    n, to = F.col("attempts"), F.col("set.to")
    status = F.when(to.isNull(), "new").when(to == "ok", "fetched").when(to == "skip", "skipped").when(n >= DEAD, "dead").when(n < QUARANTINE, "failed")
    status = status.when(F.col("retry") > F.col("set.at"), "retry_pending").otherwise("quarantined")
    return ends.withColumn("attempts", attempts).select(F.col("uid").cast("long").alias("uid"), "attempts", status.alias("status"), F.coalesce("last", F.lit(-1)).cast("long").alias("last_event"))


def late_links(notices: DataFrame, returns: DataFrame, key: str, before: str = "30 days", after: str = "30 days", late: str = "1 day") -> DataFrame:
    """(key, notice_id, return_id, notice_at, return_at): notices and returns of one key, whichever comes first, within a time of each other.

    ``notices`` has (key, notice_id, notice_at), ``returns`` (key, return_id, return_at). A return may be ``before`` earlier
    or ``after`` later than the notice. State of either side is dropped once the watermark is past what it can meet.
    """
    n = notices.withWatermark("notice_at", late).withColumnRenamed(key, "k1")
    r = returns.withWatermark("return_at", late).withColumnRenamed(key, "k2")
    near = F.expr(f"k1 = k2 and return_at >= notice_at - interval {before} and return_at <= notice_at + interval {after}")
    return n.join(r, near, "inner").select(F.col("k1").alias(key), "notice_id", "return_id", "notice_at", "return_at")


def run_once(rows: DataFrame, checkpoint: str, sink, mode: str = "append") -> None:
    """Run a stream over all that is there now; ``sink`` gets each batch and its number, and must be idempotent by number."""
    rows.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def to_parquet(rows: DataFrame, out: str, checkpoint: str) -> None:
    """Append a stream to Parquet, exactly once by the sink's own log."""
    rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def closed_windows(events: DataFrame, windows: Callable[[DataFrame], DataFrame], folder: str, flush: bool = False) -> DataFrame:
    """Append the windows that the watermark has closed to ``folder``/out, each once, and drop their state; gives all so far.

    ``windows`` makes windows of a stream of ``events``, which has its time in ``at``. With ``flush``, all that has arrived
    is read first, and then one row of the year 2200 that closes the windows still open: a stream that is flushed has ended,
    and rows that come after that are late. That row's own window is never closed.
    """
    spark = events.sparkSession
    spark.createDataFrame([], events.schema).write.mode("append").parquet(f"{folder}/clock")
    rows = windows(events.unionByName(spark.readStream.schema(events.schema).parquet(f"{folder}/clock")))
    to_parquet(rows, f"{folder}/out", f"{folder}/checkpoint")
    if flush:
        end = [F.lit("2200-01-01").cast(f.dataType).alias(f.name) if f.name == "at" else F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema]
        spark.range(1).select(*end).write.mode("append").parquet(f"{folder}/clock")
        to_parquet(rows, f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.schema(rows.schema).parquet(f"{folder}/out")


def corrections(events: DataFrame, every: str, keys: tuple[str, ...], folder: str) -> None:
    """Counts and sums of ``value`` by window and keys as changes: what a batch says of a window that was reported before takes the old figures back.

    Each batch appends (start, keys, old_n, n, old_total, total) to ``folder``/day=.../batch=...: old figures are null where
    the window is new. There is no state but these rows, of which a batch reads the days that it has rows for; late rows of
    any age correct their window. Rows without a time are left out; a null value counts and adds nothing. A batch that is
    run again replaces its rows.
    """
    keys = ["start", *keys]

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        fresh = df.where("at is not null").groupBy(F.window("at", every).getField("start").alias("start"), *keys[1:]).agg(F.count("*").alias("more"), F.coalesce(F.sum("value"), F.lit(0.0)).alias("plus"))
        fresh = fresh.withColumn("day", F.to_date("start"))
        days = fresh.select("day").distinct()
        schema = fresh.select(*keys, F.lit(0).cast("long").alias("old_n"), F.col("more").alias("n"), F.lit(0.0).alias("old_total"), F.col("plus").alias("total"), "day").schema
        before = spark.createDataFrame([], schema.add("batch", "long"))
        if _exists(spark, folder):
            known = spark.read.schema(schema.add("batch", "long")).option("basePath", folder).parquet(folder)
            before = known.where(F.col("batch") < number).join(F.broadcast(days), "day", "left_semi")  # one row a day
        latest = before.groupBy(*keys).agg(F.max_by(F.struct("n", "total"), "batch").alias("was"))
        left, right = fresh.alias("f"), latest.alias("w")
        same = [F.col(f"f.{k}").eqNullSafe(F.col(f"w.{k}")) for k in keys]
        n, total = F.col("w.was.n"), F.col("w.was.total")
        changes = left.join(right, same, "left").select(
            *[F.col(f"f.{k}") for k in keys], n.alias("old_n"), (F.coalesce(n, F.lit(0)) + F.col("more")).alias("n"), total.alias("old_total"),
            (F.coalesce(total, F.lit(0.0)) + F.col("plus")).alias("total"), F.col("f.day").alias("day"), F.lit(number).cast("long").alias("batch"),
        )
        changes.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("day", "batch").parquet(folder)

    run_once(events, f"{folder}-checkpoint", batch)


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def ingest(rows: DataFrame, target: str, checkpoint: str, keys: list[str]) -> None:
    """Append rows whose key the target does not have, of equal keys in a batch the lowest row; each batch writes its own folder, so a repeated batch overwrites itself."""

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        rest = [c for c in df.columns if c not in keys]
        lowest = df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("row")) if rest else df.distinct()
        fresh = lowest.select(*[F.col(f"row.{c}").alias(c) if c in rest else F.col(c) for c in df.columns])
        if _exists(spark, target):
            known = spark.read.option("basePath", target).parquet(target).where(F.col("batch") != number).select(*keys)
            fresh = fresh.join(known, keys, "left_anti")
        fresh.write.mode("overwrite").parquet(f"{target}/batch={number}")

    run_once(rows, checkpoint, batch)


def work_folder(spark: SparkSession) -> str:
    """A new folder in spark.checkpoint.dir, or under the warehouse where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"
