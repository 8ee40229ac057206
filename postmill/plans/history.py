"""Queries over the history of cases: their state after all events, the steps that led there, their stages, and their state at a time."""

from __future__ import annotations

from pyspark.sql import functions as F

from postmill.operators import replay as R
from postmill.plans.relational import read
from postmill.streaming.flows import work_folder

QUERIES, SQL = {}, {}

#: What the events of a customer do to the case.
LIFE = R.Machine(
    ("new", "review", "ready", "sent", "closed"),
    {"view": {"new": "review"}, "click": {"review": "ready"}, "signup": {"ready": "sent"}, "purchase": {"sent": "closed"}, "error": {"ready": "review", "sent": "ready", "closed": "review"}},
)
_STEP = """CASE WHEN {s} = 'new' AND {e} = 'view' THEN 'review' WHEN {s} = 'review' AND {e} = 'click' THEN 'ready' WHEN {s} = 'ready' AND {e} = 'signup' THEN 'sent'
 WHEN {s} = 'sent' AND {e} = 'purchase' THEN 'closed' WHEN {s} IN ('ready', 'closed') AND {e} = 'error' THEN 'review' WHEN {s} = 'sent' AND {e} = 'error' THEN 'ready' ELSE {s} END"""
_TRACE = f"""WITH RECURSIVE o AS (SELECT user_id, event_id, ts, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM events)
, t AS (SELECT user_id, step, event_id, ts, event_type, 'new' AS before, {_STEP.format(s="'new'", e="event_type")} AS after FROM o WHERE step = 1
 UNION ALL SELECT o.user_id, o.step, o.event_id, o.ts, o.event_type, t.after, {_STEP.format(s="t.after", e="o.event_type")} FROM t JOIN o ON o.user_id = t.user_id AND o.step = t.step + 1)
"""


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _names():
    return {"key": "user_id", "at": "ts", "id": "event_id", "event": "event_type"}


@query(f"""SELECT user_id, list_reduce(list_prepend('new', list(event_type ORDER BY ts, event_id)), lambda s, e: {_STEP.format(s="s", e="e")}) AS state, count(*) AS n_events, max(ts)::VARCHAR AS last_at
FROM events GROUP BY user_id""")
def state_replay(spark, sf_dir):
    out = R.replay(read(spark, sf_dir, "events"), LIFE, work_folder(spark), **_names())
    return out.withColumn("last_at", F.col("last_at").cast("string"))


@query(_TRACE + "SELECT user_id, step, event_id, event_type, before, after FROM t")
def case_trace(spark, sf_dir):
    return R.trace(read(spark, sf_dir, "events"), LIFE, work_folder(spark), **_names()).drop("ts")


@query(_TRACE + """, m AS (SELECT user_id, after AS stage, ts AS came, NULL::TIMESTAMP AS went FROM t WHERE before <> after UNION ALL SELECT user_id, before, NULL, ts FROM t WHERE before <> after)
SELECT user_id, stage, min(came)::VARCHAR AS entered_at, max(went)::VARCHAR AS left_at, count(came) AS times FROM m GROUP BY ALL""")
def case_timeline(spark, sf_dir):
    steps = R.trace(read(spark, sf_dir, "events"), LIFE, work_folder(spark), **_names())
    return R.timeline(steps, "user_id", "ts").withColumns({c: F.col(c).cast("string") for c in ("entered_at", "left_at")})


@query(_TRACE + """, d AS (SELECT u.user_id, x.day FROM (SELECT DISTINCT user_id FROM events) u, (SELECT DISTINCT date_trunc('week', ts)::TIMESTAMP AS day FROM events) x)
SELECT d.user_id, strftime(d.day, '%Y-%m-%d') AS moment, coalesce(max_by(t.after, t.step), 'new') AS state FROM d LEFT JOIN t ON t.user_id = d.user_id AND t.ts <= d.day GROUP BY ALL""")
def state_as_of(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    weeks = F.sequence(F.date_trunc("week", "first"), F.date_trunc("week", "last"), F.expr("interval 7 days"))
    span = events.agg(F.min("ts").alias("first"), F.max("ts").alias("last")).where("first is not null").select(F.explode(weeks).alias("week"))
    held = events.select(F.date_trunc("week", "ts").alias("week")).distinct()
    moments = events.select("user_id").distinct().crossJoin(F.broadcast(span.join(held, "week", "left_semi"))).withColumnRenamed("week", "moment")  # one row a week
    out = R.as_of(events, moments, LIFE, work_folder(spark), **_names())
    return out.withColumn("moment", F.date_format("moment", "yyyy-MM-dd"))
