"""The work cycle as a stream: new mail is decided, events are queued and delivered in micro-batches, and reports follow."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.functions.text import event_hash
from postmill.operators.cases import append_new
from postmill.streaming.flows import _exists, run_once


def _earlier(spark: SparkSession, table: str, number: int, schema) -> DataFrame:
    """What the other batches wrote; a repeated batch does not see itself."""
    if not _exists(spark, table):
        return spark.createDataFrame([], schema)
    return spark.read.option("basePath", table).parquet(table).where(F.col("batch") != number).drop("batch")


def queue_events(decided: DataFrame, ready: Column, event_type: Column) -> DataFrame:
    """(case_id, event_type, event_key, status) for each decided case that is ready; the key is a hash of case and type."""
    rows = decided.where(ready).select("case_id", event_type.alias("event_type"))
    return rows.withColumn("event_key", F.concat_ws(":", "event_type", event_hash(F.struct("case_id", "event_type")))).withColumn("status", F.lit("new"))


def work_cycle(mail: DataFrame, decide: Callable[[DataFrame], DataFrame], ready: Column, event_type: Column, out: str, checkpoint: str) -> None:
    """Run all mail that has arrived: ``decide`` turns a batch into cases, which are written, and their events are queued once.

    Each batch replaces its own folders in ``out``/cases and ``out``/outbox, so a batch that is run again changes nothing.
    """

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        decide(df).write.mode("overwrite").parquet(f"{out}/cases/batch={number}")
        cases = spark.read.parquet(f"{out}/cases/batch={number}")
        events = queue_events(cases, ready, event_type)
        append_new(events, _earlier(spark, f"{out}/outbox", number, events.schema)).write.mode("overwrite").parquet(f"{out}/outbox/batch={number}")

    run_once(mail, checkpoint, batch)


def deliveries(outbox: DataFrame, attempts: DataFrame, most: int = 8) -> DataFrame:
    """The outbox with attempts (event_key, at, ok) applied: sent, failed with a count and last error time, or new."""
    tries = attempts.groupBy("event_key").agg(F.count("*").alias("tries"), F.bool_or("ok").alias("sent"), F.max("at").alias("last_at"))
    joined = outbox.join(tries, "event_key", "left")
    status = F.when(F.col("sent"), "sent").when(F.col("tries") >= most, "error").when(F.col("tries") > 0, "retry").otherwise(F.col("status"))
    return joined.withColumns({"status": status, "attempts": F.coalesce("tries", F.lit(0))}).drop("tries", "sent")


def deliver(outbox: DataFrame, send: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> None:
    """Deliver a stream of outbox rows: ``send`` gives (event_key, at, ok) of a batch, which is kept as attempts; sent keys are not sent again.

    An outbox row is sent once a time that it comes by; what fails comes again in ``delivery.deliver_in_rounds``.
    """

    def batch(df: DataFrame, number: int) -> None:
        done = _earlier(df.sparkSession, out, number, "event_key string, at timestamp, ok boolean").where("ok")
        send(append_new(df, done)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    run_once(outbox, checkpoint, batch)


def append_lines(rows: DataFrame, path: str, batch: int | None = None) -> None:
    """Append a log as JSON lines: ledgers of costs, traces of answers, artefacts of quality checks.

    With the number of a stream's ``batch`` the rows go to a folder of that batch, which a repeated batch replaces.
    """
    if batch is None:
        rows.write.mode("append").json(path)
    else:
        rows.write.mode("overwrite").json(f"{path}/batch={batch}")


def ledger_entry(calls: DataFrame, price_in: Column, price_out: Column, price_image: Column, per: float = 1000.0) -> DataFrame:
    """Calls (input_tokens, output_tokens, image_count) with their costs; unknown where a price is null."""
    cost = lambda n, price, each: F.round(F.coalesce(F.col(n), F.lit(0)) / F.lit(each) * price, 6)
    out = calls.withColumns({"input_cost": cost("input_tokens", price_in, per), "output_cost": cost("output_tokens", price_out, per), "vision_cost": cost("image_count", price_image, 1.0)})
    return out.withColumns({"unknown_cost": price_in.isNull() | price_out.isNull(), "total_cost": F.round(F.coalesce("input_cost", F.lit(0.0)) + F.coalesce("output_cost", F.lit(0.0)) + F.coalesce("vision_cost", F.lit(0.0)), 6)})


def comparison_export(mail: DataFrame, cases: DataFrame, attachments: DataFrame, outbox: DataFrame, path: str) -> DataFrame:
    """Write the four tables as JSON lines, mail with its cases nested, and a manifest of counts; gives the manifest."""
    per = cases.groupBy("mail_id").agg(F.sort_array(F.collect_list(F.struct(*[c for c in cases.columns if c != "mail_id"]))).alias("cases"))
    nested = mail.join(per, F.col("id") == F.col("mail_id"), "left").drop("mail_id")
    parts = {"mail": nested, "cases": cases, "attachments": attachments, "outbox": outbox}
    for name, rows in parts.items():
        rows.write.mode("overwrite").json(f"{path}/{name}")
    spark = mail.sparkSession
    counts = [spark.read.text(f"{path}/{name}").agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n") for name in parts]
    manifest = counts[0].union(counts[1]).union(counts[2]).union(counts[3])
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return spark.read.schema("part string, n long").json(f"{path}/manifest")


def text_report(summary: DataFrame, name: str, count: str, path: str) -> None:
    """A report of counts as lines of text, largest first, with a total; the summary is a row a bucket."""
    lines = summary.select(F.col(count).alias("n"), F.format_string("%-40s %10d", F.col(name), F.col(count)).alias("value"))
    total = summary.agg(F.sum(count).alias("t")).select(F.lit(-1).cast("long").alias("n"), F.format_string("%-40s %10d", F.lit("total"), "t").alias("value"))
    lines.union(total).coalesce(1).sortWithinPartitions(F.desc("n"), "value").select("value").write.mode("overwrite").text(path)


def period_report(events: DataFrame, every: str, keys: list[str], out: str, checkpoint: str, late: str = "1 hour") -> None:
    """Hourly or daily counts of a stream, written when a window is closed; each window is reported once."""
    g = events.withWatermark("at", late).groupBy(F.window("at", every), *keys).agg(F.count("*").alias("n"))
    rows = g.select(F.col("window.start").alias("start"), *keys, "n")
    rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
