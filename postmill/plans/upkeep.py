"""State changes, links, gates and reports that follow from them, over the case tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from postmill.functions import dates as D
from postmill.functions import numbers as N
from postmill.functions import text as X
from postmill.operators import cases as C
from postmill.operators import changes as G
from postmill.operators import tables as T
from postmill.plans import routing as R
from postmill.plans.relational import read

QUERIES, SQL = {}, {}
#: Buyers by domain, and rubles for a million tokens by name of model.
BUYERS = {"com": "general", "net": "network", "example.com": "sample", "org": "society"}
MODEL_PRICES = {"click": 9.0, "view": 12.0, "sign": 20.0}
WORDS = ["license", "garbage", "reserved", "contact", "password"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# links


@query("SELECT page_id, host, (SELECT arg_max(v, length(k)) FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in BUYERS.items()) + ") r(k, v) WHERE host = k OR ends_with(host, '.' || k)) AS buyer FROM (SELECT page_id, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host FROM pages)")
def buyer_by_domain(spark, sf_dir):
    rules = spark.createDataFrame(list(BUYERS.items()), "suffix string, buyer string")
    p = read(spark, sf_dir, "pages").select("page_id", F.lower(F.regexp_extract("url", "://([^/?#]*)", 1)).alias("host"))
    return G.match_domains(p, "host", rules, "buyer").select("page_id", "host", "buyer")


@query("SELECT doc_id, phrase FROM documents JOIN (SELECT unnest(" + str(WORDS) + ") AS phrase) ON contains(lower(text), phrase)")
def counterparties_in_text(spark, sf_dir):
    return G.phrases_found(read(spark, sf_dir, "documents"), "doc_id", F.col("text"), WORDS)


@query("""WITH n AS (SELECT * FROM orders WHERE o_orderstatus = 'P'), r AS (SELECT * FROM orders WHERE o_orderstatus = 'F')
, t AS (SELECT n.o_orderkey AS child, 1 AS tier, min(r.o_orderkey) AS parent FROM n JOIN r ON n.o_custkey = r.o_custkey AND n.o_orderpriority = r.o_orderpriority GROUP BY 1 UNION ALL SELECT n.o_orderkey, 2, min(r.o_orderkey) FROM n JOIN r ON n.o_custkey = r.o_custkey GROUP BY 1)
SELECT child, min(tier) AS tier, arg_min(parent, tier) AS parent FROM t GROUP BY 1""")
def notice_links(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus", F.concat_ws("|", "o_custkey", "o_orderpriority").alias("part"), F.col("o_custkey").alias("buyer"))
    return T.tiered_parent(o.where("o_orderstatus = 'P'"), o.where("o_orderstatus = 'F'"), ["part", "buyer"], "id", "id")


@query("SELECT d.doc_id, d.source, l.toxic FROM documents d JOIN labels l ON l.doc_id = d.doc_id AND l.quality = 1")
def accepted_suggestions(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", "source").join(read(spark, sf_dir, "labels").where("quality = 1"), "doc_id").select("doc_id", "source", "toxic")


@query("SELECT o_orderkey, o_orderstatus, n, last_flag FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, arg_max(l_returnflag, (l_linenumber, l_partkey, l_returnflag)) AS last_flag FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def cases_with_last_event(spark, sf_dir):
    last = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.max_by("l_returnflag", F.struct("l_linenumber", "l_partkey", "l_returnflag")).alias("last_flag"))
    return read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").join(last, "o_orderkey", "left").select("o_orderkey", "o_orderstatus", "n", "last_flag")


@query("""SELECT c_custkey, c_name, o_orderkey, o_orderstatus, lines
FROM customer JOIN orders ON o_custkey = c_custkey LEFT JOIN (SELECT l_orderkey, string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_linenumber) AS lines FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def id_trace(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_name")
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderstatus")
    lines = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_join(F.array_sort(F.collect_list("l_linenumber")).cast("array<string>"), ",").alias("lines"))
    return c.join(o.join(lines, "o_orderkey", "left"), "c_custkey").select("c_custkey", "c_name", "o_orderkey", "o_orderstatus", "lines")


@query("""WITH s AS (SELECT event_type, user_id, bool_or(event_id % 2 = 0) AS l, bool_or(event_id % 3 = 0) AS r FROM events GROUP BY ALL)
SELECT event_type, count(*) FILTER (l AND r) AS both, count(*) FILTER (l AND NOT r) AS left_only, count(*) FILTER (r AND NOT l) AS right_only FROM s GROUP BY 1""")
def folder_gaps(spark, sf_dir):
    return G.gaps(read(spark, sf_dir, "events"), "event_type", "user_id", F.col("event_id") % 2 == 0, F.col("event_id") % 3 == 0)


@query("SELECT n_name, coalesce(s, 0)::BIGINT AS suppliers, coalesce(c, 0)::BIGINT AS customers, CASE WHEN n_nationkey % 5 <> 0 THEN coalesce(c, 0) - coalesce(s, 0) END AS gap FROM nation LEFT JOIN (SELECT s_nationkey, count(*) AS s FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey LEFT JOIN (SELECT c_nationkey, count(*) AS c FROM customer GROUP BY 1) ON c_nationkey = n_nationkey")
def server_gap(spark, sf_dir):
    per = lambda t, k, n: read(spark, sf_dir, t).groupBy(F.col(k).alias("n_nationkey")).agg(F.count("*").alias(n))
    n = read(spark, sf_dir, "nation").join(per("supplier", "s_nationkey", "s"), "n_nationkey", "left").join(per("customer", "c_nationkey", "c"), "n_nationkey", "left")
    s, c = F.coalesce("s", F.lit(0)), F.coalesce("c", F.lit(0))
    return n.select("n_name", s.alias("suppliers"), c.alias("customers"), F.when(F.col("n_nationkey") % 5 != 0, c - s).alias("gap"))


# counts


@query("SELECT strftime(coalesce(CASE WHEN o_orderkey % 4 <> 0 THEN o_orderdate END, TIMESTAMP '1994-01-01'), '%Y-%m-%d') AS day, count(*) AS n FROM orders GROUP BY 1 ORDER BY day DESC LIMIT 30")
def mails_per_day(spark, sf_dir):
    at = F.coalesce(F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderdate")), F.lit("1994-01-01").cast("timestamp_ntz"))
    return T.count_by(read(spark, sf_dir, "orders"), D.period(at, "day").alias("day")).orderBy(F.desc("day")).limit(30)


_CODES = "list_filter([CASE WHEN l_discount = 0 THEN 'no_discount' END, CASE WHEN l_quantity > 45 THEN 'too_many' END, CASE WHEN l_tax = 0 THEN 'no_tax' END], lambda v: v IS NOT NULL)"


def _issues(l):
    return l.withColumn("codes", G.issue_codes(no_discount=F.col("l_discount") == 0, too_many=F.col("l_quantity") > 45, no_tax=F.col("l_tax") == 0))


@query(f"SELECT l_returnflag, code, count(*) AS n FROM (SELECT l_returnflag, unnest({_CODES}) AS code FROM lineitem) GROUP BY ALL")
def issue_counts(spark, sf_dir):
    return T.count_by(_issues(read(spark, sf_dir, "lineitem")).select("l_returnflag", F.explode("codes").alias("code")), "l_returnflag", "code")


@query(f"SELECT l_orderkey, l_linenumber, least(100, 18 * len(c) + l_linenumber + CASE WHEN l_returnflag = 'R' THEN 5 ELSE 0 END)::BIGINT AS risk FROM (SELECT *, {_CODES} AS c FROM lineitem) ORDER BY risk DESC, l_orderkey, l_linenumber LIMIT 20")
def risk_top20(spark, sf_dir):
    risk = F.least(F.lit(100), 18 * F.size("codes") + F.col("l_linenumber") + F.when(F.col("l_returnflag") == "R", 5).otherwise(0)).cast("long")
    rows = _issues(read(spark, sf_dir, "lineitem")).select("l_orderkey", "l_linenumber", risk.alias("risk"))
    return rows.orderBy(F.desc("risk"), "l_orderkey", "l_linenumber").limit(20)


@query(f"SELECT l_orderkey, l_linenumber, CASE WHEN len(c) >= 2 THEN 'blocked' WHEN list_contains(c, 'too_many') THEN 'needs_review' WHEN len(c) = 1 THEN 'warning' ELSE 'accepted' END AS status, CASE WHEN len(c) >= 2 THEN 'several' WHEN len(c) = 1 THEN c[1] ELSE 'clean' END AS reason FROM (SELECT *, {_CODES} AS c FROM lineitem)")
def quality_status(spark, sf_dir):
    n = F.size("codes")
    status = F.when(n >= 2, "blocked").when(F.array_contains("codes", "too_many"), "needs_review").when(n == 1, "warning").otherwise("accepted")
    reason = F.when(n >= 2, "several").when(n == 1, F.get("codes", F.lit(0))).otherwise("clean")
    return _issues(read(spark, sf_dir, "lineitem")).select("l_orderkey", "l_linenumber", status.alias("status"), reason.alias("reason"))


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(sum(value), 4) AS total FROM events WHERE ts > TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 24 HOUR AND ts <= TIMESTAMP '2024-01-15 12:00:00' GROUP BY 1")
def last_day_report(spark, sf_dir):
    now = F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")
    e = read(spark, sf_dir, "events").where((F.col("ts") > now - F.expr("interval 24 hours")) & (F.col("ts") <= now))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT coalesce(r, s) AS code, r IS NOT NULL AS listed, coalesce(n, 0)::BIGINT AS n FROM (SELECT n_nationkey AS r FROM nation WHERE n_nationkey < 20) FULL OUTER JOIN (SELECT c_nationkey AS s, count(*) AS n FROM customer WHERE c_nationkey > 3 GROUP BY 1) ON r = s")
def clients_and_rules(spark, sf_dir):
    rules = read(spark, sf_dir, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").alias("code"), F.lit(True).alias("rule"))
    stats = read(spark, sf_dir, "customer").where("c_nationkey > 3").groupBy(F.col("c_nationkey").alias("code")).agg(F.count("*").alias("n"))
    return rules.join(stats, "code", "full_outer").select("code", F.coalesce("rule", F.lit(False)).alias("listed"), F.coalesce("n", F.lit(0)).alias("n"))


@query("""WITH u AS (SELECT user_id, unnest(list_distinct(list(event_type))) AS folder FROM events GROUP BY 1)
SELECT folder, count(*) FILTER (user_id % 3 = 0) AS low, count(*) FILTER (user_id % 3 = 1) AS middle, count(*) FILTER (user_id % 3 = 2) AS high FROM u GROUP BY 1""")
def folder_bucket_matrix(spark, sf_dir):
    bucket = F.element_at(F.array(*map(F.lit, ("low", "middle", "high"))), (F.col("user_id") % 3 + 1).cast("int"))
    seen = read(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("folder")).distinct()
    return seen.withColumn("b", bucket).groupBy("folder").pivot("b", ["low", "middle", "high"]).count().na.fill(0)


@query("""SELECT unnest(['imported', 'with_case', 'final', 'valuable', 'exported']) AS stage, unnest([count(*), count(*) FILTER (n > 0), count(*) FILTER (n > 0 AND o_orderstatus = 'F'), count(*) FILTER (n > 0 AND o_orderstatus = 'F' AND o_totalprice > 50000),
count(*) FILTER (n > 0 AND o_orderstatus = 'F' AND o_totalprice > 50000 AND r > 0)]) AS n FROM (SELECT o.*, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS r FROM orders o)""")
def funnel(spark, sf_dir):
    per = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count_if(F.col("l_returnflag") == "R").alias("r"))
    o = read(spark, sf_dir, "orders").join(per, "o_orderkey", "left")
    case = F.col("r").isNotNull()
    final = case & (F.col("o_orderstatus") == "F")
    valuable = final & (F.col("o_totalprice") > 50000)
    named = {"imported": F.lit(True), "with_case": case, "final": final, "valuable": valuable, "exported": valuable & (F.col("r") > 0)}
    return T.facets(o, named).withColumnRenamed("facet", "stage")


@query("SELECT l_linestatus AS channel, l_returnflag AS status, count(*) AS n, count(*) FILTER (l_returnflag = 'R' AND l_shipdate <= TIMESTAMP '1998-01-01') AS due, count(*) FILTER (l_returnflag = 'N' AND l_shipdate < TIMESTAMP '1996-01-01') AS stuck, max(l_shipdate)::VARCHAR AS latest FROM lineitem GROUP BY ALL")
def outbox_dashboard(spark, sf_dir):
    due = (F.col("l_returnflag") == "R") & (F.col("l_shipdate") <= "1998-01-01")
    stuck = (F.col("l_returnflag") == "N") & (F.col("l_shipdate") < "1996-01-01")
    g = read(spark, sf_dir, "lineitem").groupBy(F.col("l_linestatus").alias("channel"), F.col("l_returnflag").alias("status"))
    return g.agg(F.count("*").alias("n"), F.count_if(due).alias("due"), F.count_if(stuck).alias("stuck"), F.max("l_shipdate").cast("string").alias("latest"))


@query("SELECT o_orderkey, coalesce(n, 0)::BIGINT AS attachments, coalesce(total, 0)::DOUBLE AS total, coalesce(flags, '') AS flags FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, round(sum(l_quantity), 2) AS total, array_to_string(list_sort(list_distinct(list(l_returnflag))), ',') AS flags FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def mail_metadata(spark, sf_dir):
    per = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("a"), F.round(F.sum("l_quantity"), 2).alias("t"), F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("f"))
    o = read(spark, sf_dir, "orders").select("o_orderkey").join(per, "o_orderkey", "left")
    return o.select("o_orderkey", F.coalesce("a", F.lit(0)).alias("attachments"), F.coalesce("t", F.lit(0.0)).alias("total"), F.coalesce("f", F.lit("")).alias("flags"))


# windows and order


@query("WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events) SELECT user_id, string_agg(event_id::VARCHAR, ',' ORDER BY place) AS last_five FROM r WHERE place <= 5 GROUP BY 1")
def last_samples(spark, sf_dir):
    e = T.first_per(read(spark, sf_dir, "events").select("user_id", "event_id", "ts"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 5)
    g = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("place", "event_id"))).alias("l"))
    return g.select("user_id", F.array_join(F.col("l.event_id").cast("array<string>"), ",").alias("last_five"))


@query("SELECT user_id, event_id, row_number() OVER w AS attempt, (ts + INTERVAL 1 SECOND * least(300 * pow(2, row_number() OVER w - 1), 21600))::VARCHAR AS next_at FROM events WHERE event_type = 'click' WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def delivery_attempts(spark, sf_dir):
    e = read(spark, sf_dir, "events").where("event_type = 'click'")
    e = e.withColumn("attempt", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")))
    return e.select("user_id", "event_id", F.col("attempt").cast("long").alias("attempt"), (F.col("ts") + F.make_dt_interval(secs=D.retry_seconds(F.col("attempt")).cast("decimal(18,6)"))).cast("string").alias("next_at"))


@query("SELECT l_orderkey, CASE WHEN n = 1 THEN line END AS best, n AS ties FROM (SELECT l_orderkey, count(*) AS n, min(l_linenumber) AS line FROM lineitem l WHERE l_quantity = (SELECT max(l_quantity) FROM lineitem m WHERE m.l_orderkey = l.l_orderkey) GROUP BY 1)")
def unique_candidate(spark, sf_dir):
    return G.unique_best(read(spark, sf_dir, "lineitem"), "l_orderkey", "l_quantity", "l_linenumber")


@query("SELECT o_orderkey, o_orderstatus FROM orders ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, coalesce(CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate + INTERVAL 10 DAY END, o_orderdate), o_orderkey DESC LIMIT 100")
def error_first_page(spark, sf_dir):
    at = F.coalesce(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderdate") + F.expr("interval 10 days")), F.col("o_orderdate"))
    o = read(spark, sf_dir, "orders")
    return o.orderBy(T.rank_of(F.col("o_orderstatus"), ["P", "O"]), at, F.desc("o_orderkey")).limit(100).select("o_orderkey", "o_orderstatus")


@query("SELECT event_id, user_id, event_type FROM events ORDER BY event_id DESC LIMIT 300")
def keep_newest_events(spark, sf_dir):
    return G.keep_newest(read(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), "event_id", 300)


# merges and clean-ups


@query("""WITH l AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS s FROM events WHERE event_type <> 'view' GROUP BY 1) SELECT o_orderkey, coalesce(s, o_orderstatus) AS state FROM orders LEFT JOIN l ON user_id = o_orderkey""")
def manual_patches(spark, sf_dir):
    log = read(spark, sf_dir, "events").where("event_type <> 'view'").select(F.col("user_id").alias("o_orderkey"), F.col("event_type").alias("state"), "ts", "event_id")
    return G.patched(read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("state")), log, "o_orderkey", "state", ["ts", "event_id"])


@query("""WITH x AS (SELECT user_id, event_id % 2 AS side, arg_max(event_type, event_id) AS message, count(*) AS attempts FROM events GROUP BY ALL), o AS (SELECT * FROM x WHERE side = 0), n AS (SELECT * FROM x WHERE side = 1)
SELECT coalesce(n.user_id, o.user_id) AS user_id, coalesce(nullif(n.message, 'view'), o.message) AS message, (coalesce(o.attempts, 0) + coalesce(n.attempts, 0))::BIGINT AS attempts FROM o FULL OUTER JOIN n ON o.user_id = n.user_id""")
def failure_upsert(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    side = lambda k: e.where(F.col("event_id") % 2 == k).groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("message"), F.count("*").alias("attempts"))
    rules = {"message": F.coalesce(F.nullif(F.col("new.message"), F.lit("view")), "old.message"), "attempts": F.coalesce("old.attempts", F.lit(0)) + F.coalesce("new.attempts", F.lit(0))}
    return T.upsert(side(0), side(1), ["user_id"], rules)


@query("SELECT c_mktsegment AS buyer, p_brand AS pattern, round(least(0.92, 0.2 + 0.15 * count(*)), 6)::DOUBLE AS confidence, min(l_shipdate)::VARCHAR AS first_seen FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN part ON p_partkey = l_partkey WHERE l_quantity > 49 GROUP BY ALL")
def pattern_candidates(spark, sf_dir):
    l = read(spark, sf_dir, "lineitem").where("l_quantity > 49").select("l_orderkey", "l_partkey", "l_shipdate")
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    c = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("buyer"))
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("pattern"))
    g = l.join(o, "l_orderkey").join(c, "c_custkey").join(p, "l_partkey").groupBy("buyer", "pattern")
    return g.agg(F.round(F.least(F.lit(0.92), 0.2 + 0.15 * F.count("*")), 6).alias("confidence"), F.min("l_shipdate").cast("string").alias("first_seen"))


@query("SELECT user_id, count(*) AS seen, count(*) FILTER (event_type = 'click') AS structured, 'trusted' AS status FROM events GROUP BY 1 HAVING count(*) >= 60 AND count(*) FILTER (event_type = 'click') >= 12")
def promoted_profiles(spark, sf_dir):
    g = read(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("seen"), F.count_if(F.col("event_type") == "click").alias("structured"))
    return g.where("seen >= 60 and structured >= 12").withColumn("status", F.lit("trusted"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderdate::DATE < DATE '1997-01-01' OR o_orderdate::DATE > DATE '1998-12-31')")
def cascade_purge(spark, sf_dir):
    gone = read(spark, sf_dir, "orders").where(C.outside_period(F.col("o_orderdate"), "1997-01-01", "1998-12-31")).select(F.col("o_orderkey").alias("l_orderkey"))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").join(gone, "l_orderkey", "left_anti")


@query("SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey WHERE NOT (l_returnflag = 'N' AND coalesce(o_orderstatus, 'none') <> 'F')")
def outbox_cleanup(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    l = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag").join(o, "l_orderkey", "left")
    return l.where(~((F.col("l_returnflag") == "N") & (F.coalesce("o_orderstatus", F.lit("none")) != "F"))).drop("o_orderstatus")


@query("WITH w AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' ORDER BY o_totalprice DESC, o_orderkey LIMIT 50) SELECT o_orderkey, CASE WHEN o_orderkey IN (SELECT o_orderkey FROM w) THEN 'new' ELSE o_orderstatus END AS status FROM orders")
def reset_errors(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    chosen = o.where("o_orderstatus = 'P'").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50).select("o_orderkey", F.lit("new").alias("fresh"))
    return o.join(F.broadcast(chosen), "o_orderkey", "left").select("o_orderkey", F.coalesce("fresh", "o_orderstatus").alias("status"))  # 50 rows


@query("""SELECT kind, value, count(*) AS seen, count(*) FILTER (ready) AS confirmed FROM (SELECT unnest([{'kind': 'mail', 'value': o_custkey::VARCHAR}, {'kind': 'domain', 'value': 'd' || (o_custkey % 20)}], recursive := true), o_orderstatus = 'F' AS ready FROM orders) GROUP BY ALL""")
def learned_identities(spark, sf_dir):
    buyer = F.col("o_custkey")
    both = F.array(F.struct(F.lit("mail").alias("kind"), buyer.cast("string").alias("value")), F.struct(F.lit("domain").alias("kind"), F.concat(F.lit("d"), (buyer % 20).cast("string")).alias("value")))
    rows = read(spark, sf_dir, "orders").select((F.col("o_orderstatus") == "F").alias("ready"), F.inline(both))
    return rows.groupBy("kind", "value").agg(F.count("*").alias("seen"), F.count_if("ready").alias("confirmed"))


@query("SELECT md5(event_type || ':' || (user_id % 40)) AS prompt, count(*) AS calls, min(event_id) AS first_call, count(*) - 1 AS hits FROM events GROUP BY 1")
def response_cache(spark, sf_dir):
    prompt = F.md5(F.concat_ws(":", "event_type", F.col("user_id") % 40))
    g = read(spark, sf_dir, "events").groupBy(prompt.alias("prompt")).agg(F.count("*").alias("calls"), F.min("event_id").alias("first_call"))
    return g.withColumn("hits", F.col("calls") - 1)


# row by row


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'email' WHEN p_partkey % 4 = 1 THEN 'numeric' WHEN p_partkey % 4 = 2 THEN 'part_number' ELSE 'text' END AS kind FROM part")
def search_query_types(spark, sf_dir):
    k = F.col("p_partkey")
    text = F.when(k % 4 == 0, F.concat(F.lit("p"), k.cast("string"), F.lit("@example.com"))).when(k % 4 == 1, k.cast("string")).when(k % 4 == 2, F.concat(F.lit("AB-"), k.cast("string"), F.lit("/00"))).otherwise(F.concat(F.lit("two words "), k.cast("string")))
    return read(spark, sf_dir, "part").select("p_partkey", X.query_type(text).alias("kind"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 > 1 THEN p_size * 10.5 END::DOUBLE AS price, CASE p_partkey % 5 WHEN 0 THEN 'has_letters' WHEN 1 THEN 'not_positive' END AS error FROM part")
def price_checks(spark, sf_dir):
    k = F.col("p_partkey") % 5
    text = F.when(k == 0, "по запросу").when(k == 1, "0").otherwise(F.concat(F.translate((F.col("p_size") * F.lit(10.5)).cast("decimal(10,2)").cast("string"), ".", ","), F.lit(" руб.")))
    return read(spark, sf_dir, "part").select("p_partkey", N.check_price(text).alias("c")).select("p_partkey", F.col("c.value").alias("price"), "c.error")


@query("SELECT o_orderkey, strftime(o_orderdate, '%d.%m.%Y') AS day FROM orders")
def dates_normalised(spark, sf_dir):
    at, k = F.col("o_orderdate"), F.col("o_orderkey") % 3
    month = F.element_at(F.array(*map(F.lit, D.MONTHS)), F.month(at))
    text = F.when(k == 0, F.date_format(at, "yyyy-MM-dd")).when(k == 1, F.date_format(at, "d.M.yyyy")).otherwise(F.concat_ws(" ", F.dayofmonth(at).cast("string"), month, F.year(at).cast("string")))
    return read(spark, sf_dir, "orders").select("o_orderkey", D.normal_date(text).alias("day"))


_PRICE = "CASE " + " ".join(f"WHEN event_type = '{k}' THEN {v}" for k, v in MODEL_PRICES.items()) + " " + " ".join(f"WHEN contains(event_type, '{k}') THEN {v}" for k, v in MODEL_PRICES.items()) + " ELSE 30.0 END"


@query(f"SELECT event_type, {_PRICE}::DOUBLE AS price, count(*) AS n FROM events GROUP BY ALL")
def model_prices(spark, sf_dir):
    return T.count_by(read(spark, sf_dir, "events"), "event_type", G.tiered_price(F.col("event_type"), MODEL_PRICES, 30.0).alias("price"))


@query("""WITH k AS (SELECT o_orderkey, CASE WHEN o_custkey % 9 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN 'b' || o_custkey || '|claim:c' || o_orderkey WHEN o_orderkey % 3 = 1 THEN 'b' || o_custkey || '|doc:d' || o_orderkey || '|part:p1' ELSE 'b' || o_custkey || '|doc:d' || o_orderkey END AS strong FROM orders)
SELECT o_orderkey, strong, coalesce(strong, CASE WHEN o_orderkey % 2 = 0 THEN 'ref-' || o_orderkey ELSE 'subject:' || substring(sha1('claim'), 1, 16) END) AS thread FROM k""")
def case_keys(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    text = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    strong = R.strong_key(F.when(c % 9 != 0, text("B", c)), F.when(k % 3 == 0, text("C", k)), text("D", k), F.when(k % 3 == 1, "P1"))
    thread = R.thread_key(F.col("strong"), F.when(k % 2 == 0, F.array(text("ref-", k))), F.lit(" "), F.lit("claim"))
    return read(spark, sf_dir, "orders").withColumn("strong", strong).select("o_orderkey", "strong", thread.alias("thread"))


_GATE = "[CASE WHEN l_quantity <= 5 THEN 'quantity:missing' END, CASE WHEN l_discount = 0 THEN 'document:conflict' END]"


@query(f"""WITH g AS (SELECT *, list_filter({_GATE}, lambda v: v IS NOT NULL) AS b, (l_quantity > 5)::INT + (l_discount > 0.05)::INT AS found FROM lineitem)
SELECT l_orderkey, l_linenumber, len(b) = 0 AS passed, array_to_string(b, ',') AS blocking, CASE found WHEN 2 THEN 'strong' WHEN 1 THEN 'medium' ELSE 'none' END AS strength FROM g""")
def evidence_gates(spark, sf_dir):
    quantity = F.when(F.col("l_quantity") > 5, "found").otherwise("missing")
    document = F.when(F.col("l_discount") > 0.05, "found").when(F.col("l_discount") == 0, "conflict").otherwise("weak")
    gate = R.evidence_gate(F.create_map(F.lit("quantity"), quantity, F.lit("document"), document), ["quantity", "document"])
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", gate.alias("g")).select("l_orderkey", "l_linenumber", "g.passed", F.array_join("g.blocking", ",").alias("blocking"), "g.strength")


@query("""SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'outgoing' WHEN page_id % 4 = 1 THEN 'internal' WHEN page_id % 4 = 2 THEN 'forwarded' ELSE 'incoming' END AS direction FROM pages""")
def mail_directions(spark, sf_dir):
    k = F.col("page_id") % 4
    sender = F.when(k == 3, "buyer.example").otherwise("own.example")
    to = F.when(k == 1, "shop.own.example").otherwise("buyer.example")
    d = R.direction(sender, to, ["own.example"], F.when(k == 0, "Sent").otherwise("INBOX"), F.when(k == 2, "Fwd: claim").otherwise("claim"))
    return read(spark, sf_dir, "pages").select("page_id", d["value"].alias("direction"))


@query("""WITH o AS (SELECT *, date_diff('day', DATE '2001-06-01', (o_orderdate + INTERVAL 10 DAY)::DATE) AS d FROM orders)
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'closed' WHEN d < -900 THEN 'escalated' WHEN d < 0 THEN 'overdue' ELSE 'in_time' END AS status, CASE WHEN o_orderstatus = 'F' THEN 'none' WHEN d < -900 THEN 'call' WHEN d < 0 THEN 'remind' ELSE 'wait' END AS action FROM o""")
def control_ladder(spark, sf_dir):
    d = F.date_diff(F.date_add(F.to_date("o_orderdate"), 10), F.lit("2001-06-01").cast("date"))
    ladder = R.decide([(F.col("o_orderstatus") == "F", "closed", "none"), (d < -900, "escalated", "call"), (d < 0, "overdue", "remind")], ("in_time", "wait"))
    return read(spark, sf_dir, "orders").select("o_orderkey", ladder.alias("c")).select("o_orderkey", F.col("c.value").alias("status"), F.col("c.reason").alias("action"))
