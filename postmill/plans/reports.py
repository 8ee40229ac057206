"""Usage, costs, accounting, deadlines and state changes."""

from __future__ import annotations

from pyspark.sql import functions as F


from postmill.functions import dates as D
from postmill.functions import numbers as N
from postmill.operators import cases as C
from postmill.operators import tables as T
from postmill.plans import routing as R
from postmill.plans.relational import RANKS, read

QUERIES, SQL = {}, {}
#: The moment that the queries take as now.
NOW = "2001-06-01 00:00:00"
#: Rubles for a million tokens, in and out, by kind of call; calls of other kinds cost the default.
PRICES = {"click": (9.0, 73.0), "view": (12.0, 48.0), "purchase": (20.0, 80.0)}
DEFAULT_PRICE = (30.0, 120.0)
#: Colours, as buckets to fill with zeros, of the order accounting.
ORDER_BUCKETS = ["ready", "overdue", "urgent", "review", "archived", "other", "unused"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _timeline(kind, form):
    def run(spark, sf_dir):
        e = read(spark, sf_dir, "events")
        return e.groupBy(D.period(F.col("ts"), kind).alias("period"), "event_type", (F.col("user_id") % 2).alias("mode")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))

    run.__name__ = f"usage_timeline_{kind}"
    return query(f"SELECT strftime(ts, '{form}') AS period, event_type, user_id % 2 AS mode, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")(run)


usage_timeline_day, usage_timeline_week, usage_timeline_month = _timeline("day", "%Y-%m-%d"), _timeline("week", "%Y-W%W"), _timeline("month", "%Y-%m")


@query("SELECT event_type, count(*) FILTER (user_id % 3 = 0) AS pattern, count(*) FILTER (user_id % 3 = 1) AS text, count(*) FILTER (user_id % 3 = 2) AS vision FROM events GROUP BY 1")
def usage_pivot(spark, sf_dir):
    mode = F.element_at(F.array(*map(F.lit, ("pattern", "text", "vision"))), (F.col("user_id") % 3 + 1).cast("int"))
    return read(spark, sf_dir, "events").withColumn("mode", mode).groupBy("event_type").pivot("mode", ["pattern", "text", "vision"]).count().na.fill(0)


_IN = "CASE event_type " + " ".join(f"WHEN '{k}' THEN {v[0]}" for k, v in PRICES.items()) + f" ELSE {DEFAULT_PRICE[0]} END"
_OUT = "CASE event_type " + " ".join(f"WHEN '{k}' THEN {v[1]}" for k, v in PRICES.items()) + f" ELSE {DEFAULT_PRICE[1]} END"


@query(f"""WITH e AS (SELECT *, floor(value * 100)::BIGINT AS p, coalesce(nullif(json_extract(props, '$.k')::BIGINT, 0), floor(value * 7 / 3.3)::BIGINT) AS c FROM events)
SELECT event_type, count(*) AS calls, count(DISTINCT user_id) AS users, sum(p)::BIGINT AS prompt, sum(c)::BIGINT AS completion, round(sum((p * {_IN} + c * {_OUT}) / 1e6), 4)::DOUBLE AS rub, round(sum((p * {_IN} + c * {_OUT}) / 1e6) / count(DISTINCT user_id), 4)::DOUBLE AS rub_per_user FROM e GROUP BY 1""")
def token_cost_report(spark, sf_dir):
    prices = spark.createDataFrame([(k, *v) for k, v in PRICES.items()], "event_type string, price_in double, price_out double")
    e = read(spark, sf_dir, "events").withColumn("p", F.floor(F.col("value") * 100))
    e = e.withColumn("c", N.tokens_or_estimate(F.get_json_object("props", "$.k").try_cast("bigint"), F.col("value") * 7))
    e = e.join(F.broadcast(prices), "event_type", "left")  # a fixed price table
    rub = N.cost(F.col("p"), F.col("c"), F.coalesce("price_in", F.lit(DEFAULT_PRICE[0])), F.coalesce("price_out", F.lit(DEFAULT_PRICE[1])))
    g = e.groupBy("event_type").agg(F.count("*").alias("calls"), F.count_distinct("user_id").alias("users"), F.sum("p").alias("prompt"), F.sum("c").alias("completion"), F.sum(rub).alias("r"))
    return g.select("event_type", "calls", "users", "prompt", "completion", F.round("r", 4).alias("rub"), F.round(N.ratio(F.col("r"), F.col("users")), 4).alias("rub_per_user"))


@query("SELECT event_type AS task, strftime(ts, '%Y-%m-%d') AS day, count(*) AS records, round(sum(value), 4) AS cost, sum((event_id % 3 = 0)::INT)::BIGINT AS found, sum((event_id % 6 = 0)::INT)::BIGINT AS accepted, CASE WHEN sum((event_id % 3 = 0)::INT) > 0 THEN round(sum((event_id % 6 = 0)::INT) / sum((event_id % 3 = 0)::INT), 4) END AS rate FROM events GROUP BY ALL")
def cost_ledger_rollup(spark, sf_dir):
    g = read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("task"), D.period(F.col("ts"), "day").alias("day"))
    g = g.agg(F.count("*").alias("records"), F.round(F.sum("value"), 4).alias("cost"), F.count_if(F.col("event_id") % 3 == 0).alias("found"), F.count_if(F.col("event_id") % 6 == 0).alias("accepted"))
    return g.withColumn("rate", F.round(N.ratio(F.col("accepted"), F.col("found")), 4))


def _order_bucket():
    status, received = F.col("o_orderstatus"), F.col("o_orderdate")
    return R.decide(
        [
            (received < "1995-06-01", "archived", "age"),
            ((status == "F") & (F.col("o_totalprice") > 50000), "ready", "final"),
            ((status == "O") & (received < "1998-01-01"), "overdue", "deadline"),
            (F.col("o_orderpriority") == "1-URGENT", "urgent", "priority"),
            (status == "O", "review", "open"),
            (status == "P", "review", "partial"),
        ],
        ("other", "no_rule"),
    )


_BUCKET = """CASE WHEN o_orderdate < TIMESTAMP '1995-06-01' THEN 'archived:age' WHEN o_orderstatus = 'F' AND o_totalprice > 50000 THEN 'ready:final' WHEN o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '1998-01-01' THEN 'overdue:deadline'
WHEN o_orderpriority = '1-URGENT' THEN 'urgent:priority' WHEN o_orderstatus = 'O' THEN 'review:open' WHEN o_orderstatus = 'P' THEN 'review:partial' ELSE 'other:no_rule' END"""
_LABELLED = f"WITH b AS (SELECT *, split_part({_BUCKET}, ':', 1) AS bucket, split_part({_BUCKET}, ':', 2) AS reason FROM orders)"


def _labelled(spark, sf_dir):
    o = read(spark, sf_dir, "orders").withColumn("b", _order_bucket())
    return o.withColumn("bucket", F.col("b.value")).withColumn("reason", F.col("b.reason"))


@query(_LABELLED + f", k AS (SELECT unnest({ORDER_BUCKETS}) AS bucket) SELECT k.bucket, count(b.bucket) AS n FROM k LEFT JOIN b USING (bucket) GROUP BY 1")
def bucket_accounting(spark, sf_dir):
    return T.zero_filled(T.count_by(_labelled(spark, sf_dir), "bucket"), "bucket", ORDER_BUCKETS).select("bucket", "n")


@query(_LABELLED + " SELECT bucket, reason, count(*) AS n, (2 - grouping(bucket) - grouping(reason))::INTEGER AS level FROM b GROUP BY ROLLUP (bucket, reason)")
def route_rollup(spark, sf_dir):
    return R.rollup(_labelled(spark, sf_dir), "bucket", "reason")


@query(_LABELLED + f" SELECT count(*) AS total, count(*) FILTER (bucket IN {tuple(ORDER_BUCKETS)}) AS counted, count(*) - count(*) FILTER (bucket IN {tuple(ORDER_BUCKETS)}) AS unaccounted FROM b")
def completeness_check(spark, sf_dir):
    return R.completeness(_labelled(spark, sf_dir), "bucket", ORDER_BUCKETS)


@query(_LABELLED + " SELECT bucket, reason, count(*) AS n, count(*) FILTER (o_totalprice > 150000) AS requires_action FROM b WHERE bucket IN ('archived', 'other', 'review') GROUP BY ALL")
def hidden_groups(spark, sf_dir):
    rows = _labelled(spark, sf_dir).where(F.col("bucket").isin("archived", "other", "review"))
    return rows.groupBy("bucket", "reason").agg(F.count("*").alias("n"), F.count_if(F.col("o_totalprice") > 150000).alias("requires_action"))


@query("SELECT user_id, sum(used)::BIGINT AS use_count, max(last)::VARCHAR AS last_used FROM (SELECT user_id, count(*) AS used, max(ts) AS last FROM events GROUP BY 1) GROUP BY 1")
def upsert_counter(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    counts = lambda rows: rows.groupBy("user_id").agg(F.count("*").alias("use_count"), F.max("ts").alias("last_used"))
    old, new = counts(e.where("event_id % 2 = 0")), counts(e.where("event_id % 2 = 1"))
    merged = T.upsert(old, new, ["user_id"], {"use_count": F.coalesce("old.use_count", F.lit(0)) + F.coalesce("new.use_count", F.lit(0)), "last_used": F.greatest("old.last_used", "new.last_used")})
    return merged.withColumn("last_used", F.col("last_used").cast("string"))


@query("SELECT user_id, round(least(0.7, 0.18 + 0.07 * count(*) FILTER (event_type = 'view') + 0.08 * count(*) FILTER (event_type = 'click') + 0.05 * count(*) FILTER (event_type = 'purchase')), 6)::DOUBLE AS confidence FROM events GROUP BY 1")
def profile_confidence(spark, sf_dir):
    g = read(spark, sf_dir, "events").groupBy("user_id").agg(*[F.count_if(F.col("event_type") == k).alias(k) for k in ("view", "click", "purchase")])
    return g.select("user_id", F.round(N.profile_confidence(F.col("view"), F.col("click"), F.col("purchase")), 6).alias("confidence"))


@query("SELECT o_orderkey, CASE WHEN NOT o_orderdate < TIMESTAMP '2001-06-01' - INTERVAL 1000 DAY THEN o_orderpriority END AS body, CASE WHEN NOT o_orderdate < TIMESTAMP '2001-06-01' - INTERVAL 400 DAY THEN o_totalprice END AS attachment FROM orders")
def archive_ageing(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", F.col("o_orderpriority").alias("body"), F.col("o_totalprice").alias("attachment"))
    return C.age_out(o, F.col("o_orderdate"), F.lit(NOW).cast("timestamp_ntz"), 1000, 400, "body", "attachment").drop("o_orderdate")


@query("SELECT o_orderkey FROM orders WHERE NOT (o_orderdate::DATE < DATE '1996-01-01' OR o_orderdate::DATE > DATE '1999-12-31')")
def purge_outside_period(spark, sf_dir):
    return read(spark, sf_dir, "orders").where(~C.outside_period(F.col("o_orderdate"), "1996-01-01", "1999-12-31")).select("o_orderkey")


_KIND = "CASE o_orderstatus WHEN 'F' THEN 'defect' WHEN 'O' THEN 'shortage' ELSE 'none' END"


@query(f"SELECT o_orderkey, (CASE WHEN o_orderpriority = '5-LOW' THEN NULL WHEN o_orderpriority = '1-URGENT' THEN TIMESTAMP '{NOW}' + INTERVAL 4 HOUR ELSE o_orderdate + INTERVAL 1 DAY * CASE {_KIND} WHEN 'defect' THEN 10 WHEN 'shortage' THEN 3 ELSE 7 END END)::VARCHAR AS deadline FROM orders")
def sla_deadline(spark, sf_dir):
    kind = F.when(F.col("o_orderstatus") == "F", "defect").when(F.col("o_orderstatus") == "O", "shortage").otherwise("none")
    event = F.when(F.col("o_orderpriority") == "5-LOW", "internal").when(F.col("o_orderpriority") == "1-URGENT", "reminder").otherwise("new_return")
    at = D.deadline(kind, event, F.col("o_orderdate").cast("timestamp"), F.lit(NOW).cast("timestamp"))
    return read(spark, sf_dir, "orders").select("o_orderkey", at.cast("string").alias("deadline"))


@query(f"""WITH h AS (SELECT o_orderkey, o_orderpriority, (epoch(o_orderdate + INTERVAL 10 DAY) - epoch(TIMESTAMP '{NOW}')) / 3600.0 AS h FROM orders)
SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' OR h <= 4 THEN 'critical' WHEN h <= 24 THEN 'high' WHEN o_orderpriority = '2-HIGH' OR h <= 72 THEN 'medium' ELSE 'normal' END AS priority FROM h""")
def priority_by_hours(spark, sf_dir):
    left = D.hours_left(F.col("o_orderdate").cast("timestamp") + F.expr("interval 10 days"), F.lit(NOW).cast("timestamp"))
    p = F.col("o_orderpriority")
    return read(spark, sf_dir, "orders").select("o_orderkey", D.priority_by_hours(left, p == "1-URGENT", p == "2-HIGH").alias("priority"))


@query("SELECT l_orderkey, l_linenumber, least(300 * pow(2, greatest(l_quantity::INT - 1, 0)), 21600)::BIGINT AS wait FROM lineitem")
def retry_backoff(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", D.retry_seconds(F.col("l_quantity").cast("int")).alias("wait"))




@query(f"""WITH o AS (SELECT *, date_diff('day', DATE '2001-06-01', (o_orderdate + INTERVAL 10 DAY)::DATE) AS d FROM orders)
, x AS (SELECT o_orderkey, d, unnest(list_filter([CASE WHEN d < 0 THEN 'overdue' END, CASE WHEN d = 0 THEN 'today' END, CASE WHEN d BETWEEN 1 AND 3 THEN 'three_days' END, CASE WHEN d BETWEEN 4 AND 7 THEN 'week' END,
CASE WHEN o_custkey % 7 = 0 THEN 'no_owner' END, CASE WHEN o_orderpriority = '1-URGENT' THEN 'urgent' END, CASE WHEN o_orderstatus = 'P' THEN 'waiting' END], lambda v: v IS NOT NULL)) AS bucket FROM o)
SELECT bucket, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY d, o_orderkey) AS place FROM x) WHERE place <= 25""")
def due_buckets(spark, sf_dir):
    o = read(spark, sf_dir, "orders").withColumn("d", F.date_diff(F.date_add(F.to_date("o_orderdate"), 10), F.lit("2001-06-01").cast("date")))
    d = F.col("d")
    named = {"overdue": d < 0, "today": d == 0, "three_days": d.between(1, 3), "week": d.between(4, 7), "no_owner": F.col("o_custkey") % 7 == 0, "urgent": F.col("o_orderpriority") == "1-URGENT", "waiting": F.col("o_orderstatus") == "P"}
    rows = o.select("o_orderkey", "d", F.explode(F.array_compact(F.array(*[F.when(c, k) for k, c in named.items()]))).alias("bucket"))
    return T.first_per(rows, ["bucket"], [F.col("d"), F.col("o_orderkey")], 25).select("bucket", "o_orderkey")


@query("SELECT user_id, count(*) AS attempts, CASE WHEN count(*) >= 80 THEN 'dead' WHEN count(*) >= 60 THEN 'quarantined' ELSE 'failed' END AS status FROM events WHERE event_type <> 'purchase' GROUP BY 1")
def quarantine_summary(spark, sf_dir):
    g = read(spark, sf_dir, "events").where("event_type <> 'purchase'").groupBy("user_id").agg(F.count("*").alias("attempts"))
    return g.withColumn("status", F.when(F.col("attempts") >= 80, "dead").when(F.col("attempts") >= 60, "quarantined").otherwise("failed"))


@query("SELECT l_orderkey, l_linenumber, count(*) FILTER (l_discount = 0) OVER () AS missing_discount, l_quantity <= 1000 AND l_quantity > 0 AS quantity_ok FROM lineitem")
def outbox_validation(spark, sf_dir):
    l = read(spark, sf_dir, "lineitem")
    total = F.broadcast(l.agg(F.count_if(F.col("l_discount") == 0).alias("missing_discount")))  # one row
    ok = N.check_quantity(F.col("l_quantity").cast("string"))["error"].isNull()
    return l.join(total, F.lit(True)).select("l_orderkey", "l_linenumber", "missing_discount", ok.alias("quantity_ok"))


