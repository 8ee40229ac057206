"""Streaming queries, run over all files that are there."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from postmill.streaming import delivery, flows

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _events(spark, sf_dir):
    return flows.stream(spark, f"{sf_dir}/events.parquet").withColumn("at", F.col("ts").cast("timestamp"))


def _closed(spark, sf_dir, windows):
    """All windows of the events, each appended once when it is closed."""
    return flows.closed_windows(_events(spark, sf_dir), windows, flows.work_folder(spark), flush=True)


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark, sf_dir):
    out = _closed(spark, sf_dir, lambda e: flows.tumbling(e, "1 day", keys=("event_type",)))
    return out.select(F.col("start").cast("string").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT user_id, event_type, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, min(event_id) AS event_id FROM events GROUP BY ALL")
def stream_dedup(spark, sf_dir):
    rows = _events(spark, sf_dir).withColumn("day", F.date_trunc("day", "at"))
    folder = flows.work_folder(spark)
    flows.ingest(rows.select("user_id", "event_type", "day", "event_id"), f"{folder}/out", f"{folder}/checkpoint", ["user_id", "event_type", "day"])
    return spark.read.parquet(f"{folder}/out").select("user_id", "event_type", F.date_format("day", "yyyy-MM-dd").alias("day"), "event_id")


@query("""WITH l AS (SELECT user_id AS uid, event_id, CASE event_type WHEN 'purchase' THEN 'ok' WHEN 'click' THEN 'retry' ELSE 'fail' END AS o FROM events), k AS (SELECT uid, max(event_id) AS last_event, coalesce(max(event_id) FILTER (o = 'ok'), -1) AS ok_at, max(event_id) FILTER (o <> 'retry') AS set_at, coalesce(max(event_id) FILTER (o = 'retry'), -1) AS retry_at FROM l GROUP BY 1)
, n AS (SELECT k.*, (SELECT count(*) FROM l WHERE l.uid = k.uid AND o = 'fail' AND event_id > ok_at) AS attempts FROM k)
SELECT uid, attempts, CASE WHEN set_at IS NULL THEN 'new' WHEN set_at = ok_at THEN 'fetched' WHEN attempts >= 5 THEN 'dead' WHEN attempts < 3 THEN 'failed' WHEN retry_at > set_at THEN 'retry_pending' ELSE 'quarantined' END AS status, last_event FROM n""")
def uid_state(spark, sf_dir):
    outcome = F.when(F.col("event_type") == "purchase", "ok").when(F.col("event_type") == "click", "retry").otherwise("fail")
    log = _events(spark, sf_dir).select(F.col("user_id").alias("uid"), "event_id", outcome.alias("outcome"))
    folder = flows.work_folder(spark)
    flows.ingest(log, f"{folder}/out", f"{folder}/checkpoint", ["uid", "event_id", "outcome"])
    return flows.states_of(spark.read.parquet(f"{folder}/out").drop("batch"))


@query("""WITH g AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 6 HOUR, true)::INT AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts)::VARCHAR AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_sessions(spark, sf_dir):
    out = _closed(spark, sf_dir, lambda e: flows.sessions(e, "user_id", "6 hours"))
    return out.withColumn("start", F.col("start").cast("string"))


@query("""WITH w AS (SELECT unnest(range(0, 24)) AS k), e AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR * (k + 1) AS until FROM events, w)
SELECT strftime(until, '%Y-%m-%d %H:%M:%S') AS until, count(*) AS n FROM e GROUP BY 1""")
def stream_trailing(spark, sf_dir):
    out = _closed(spark, sf_dir, lambda e: flows.trailing(e, "24 hours", "1 hour"))
    return out.select(F.col("until").cast("string").alias("until"), "n")


@query("""WITH e AS (SELECT date_trunc('day', ts) AS start, event_type, value, CASE WHEN event_id % 10 < 7 THEN 0 ELSE 1 END AS part FROM events), g AS (SELECT start, event_type, part, count(*) AS more, sum(value) AS plus FROM e GROUP BY ALL)
, c AS (SELECT *, sum(more) OVER w AS n, sum(plus) OVER w AS total, lag(1) OVER w AS seen FROM g WINDOW w AS (PARTITION BY start, event_type ORDER BY part))
SELECT strftime(start, '%Y-%m-%d') AS start, event_type, part AS batch, CASE WHEN seen = 1 THEN n - more END::BIGINT AS old_n, n::BIGINT AS n, round(CASE WHEN seen = 1 THEN total - plus END, 4) AS old_total, round(total, 4) AS total FROM c""")
def stream_corrections(spark, sf_dir):
    """Three in ten events come late, in a second batch, and correct the days that the first one reported."""
    folder = flows.work_folder(spark)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("at", F.col("ts").cast("timestamp"))
    late = F.col("event_id") % 10 >= 7
    for part in (events.where(~late), events.where(late)):
        part.write.mode("append").parquet(f"{folder}/in")
        flows.corrections(flows.stream(spark, f"{folder}/in"), "1 day", ("event_type",), f"{folder}/changes")
    out = spark.read.parquet(f"{folder}/changes")
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("start"), "event_type", F.col("batch").cast("long").alias("batch"), "old_n", "n", F.round("old_total", 4).alias("old_total"), F.round("total", 4).alias("total"))


@query("""SELECT c_custkey::VARCHAR AS event_key, CASE WHEN c_custkey % 5 > 3 THEN 'gave_up' ELSE 'sent' END AS status, least(3, greatest(1, c_custkey % 5)) AS attempts FROM customer""")
def delivery_retries(spark, sf_dir):
    """A notice to each customer, whose post takes the attempt of the last digit's rest by five; three attempts are made."""
    folder, start = flows.work_folder(spark), datetime.datetime(2024, 1, 1)
    delivery.queue(spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("event_key")), folder, start)
    times = [start + datetime.timedelta(minutes=m) for m in (1, 4, 8, 16)]
    done = delivery.deliver_in_rounds(spark, folder, lambda due: due.withColumn("ok", F.col("attempt") >= F.col("event_key").cast("long") % 5), times, most=3)
    return done.where("action <> 'due'").select("event_key", F.col("action").alias("status"), F.col("attempt").cast("long").alias("attempts"))
