"""Lists, joins, counts and pages over the case tables.

In these queries orders stand for cases, lineitem for positions and outbox rows, events for logs, documents for mail,
labels for accepted suggestions, customer for buyers and conversations for threads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from postmill.functions.numbers import percent, risk_bucket
from postmill.operators import tables as T

RANKS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    """Register a function as a query under its own name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("SELECT o_orderstatus AS state, count(*) AS n FROM orders GROUP BY 1")
def state_counts(spark, sf_dir):
    return T.count_by(read(spark, sf_dir, "orders"), F.col("o_orderstatus").alias("state")).orderBy(F.desc("n"), "state")


@query("SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 100")
def priority_rank_top(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    return o.orderBy(T.rank_of(F.col("o_orderpriority"), RANKS), F.desc("o_totalprice"), "o_orderkey").limit(100).select("o_orderkey", "o_orderpriority", "o_totalprice")


@query("SELECT o_orderkey, o_orderdate::VARCHAR AS received, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS total FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50 OFFSET 100")
def page_with_total(spark, sf_dir):
    o = read(spark, sf_dir, "orders").where("o_orderstatus = 'O'")
    rows = T.page(o, [F.desc("o_orderdate"), F.desc("o_orderkey")], 3, 50).select("o_orderkey", F.col("o_orderdate").cast("string").alias("received"))
    return T.with_total(rows, o)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 1000 ORDER BY o_orderkey LIMIT 200")
def keyset_page(spark, sf_dir):
    return T.after(read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 1000, 200)


@query("SELECT doc_id, lang, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def docs_without_label(spark, sf_dir):
    return read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id", "lang", "source")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')")
def customers_no_urgent_final(spark, sf_dir):
    done = read(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT' and o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return read(spark, sf_dir, "customer").join(done, "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def docs_with_label(spark, sf_dir):
    return read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels").where("quality = 1"), "doc_id", "left_semi").select("doc_id", "n_chars")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus <> 'F')")
def only_info_owners(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus")
    c = read(spark, sf_dir, "customer").select("c_custkey")
    return c.join(o.where("o_orderstatus = 'F'"), "c_custkey", "left_semi").join(o.where("o_orderstatus <> 'F'"), "c_custkey", "left_anti")


@query("SELECT d.doc_id, d.lang, coalesce(CASE quality WHEN 1 THEN 'accepted' WHEN 0 THEN 'rejected' END, 'none') AS state FROM documents d LEFT JOIN labels l USING (doc_id)")
def list_left_join(spark, sf_dir):
    state = F.coalesce(F.when(F.col("quality") == 1, "accepted").when(F.col("quality") == 0, "rejected"), F.lit("none"))
    return read(spark, sf_dir, "documents").select("doc_id", "lang").join(read(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", "lang", state.alias("state"))


@query("SELECT o_orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS attachments, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS returned FROM orders")
def attachment_counts(spark, sf_dir):
    per = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("a"), F.count_if(F.col("l_returnflag") == "R").alias("r"))
    o = read(spark, sf_dir, "orders").select("o_orderkey").join(per, "o_orderkey", "left")
    return o.select("o_orderkey", F.coalesce("a", F.lit(0)).alias("attachments"), F.coalesce("r", F.lit(0)).alias("returned"))


@query("SELECT l_orderkey, l_linenumber, o_orderstatus, c_name FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey LEFT JOIN customer ON c_custkey = o_custkey WHERE l_returnflag = 'R'")
def three_way_join(spark, sf_dir):
    l = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber")
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderstatus")
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return l.join(o, "l_orderkey", "left").join(c, "o_custkey", "left").select("l_orderkey", "l_linenumber", "o_orderstatus", "c_name")


@query("""WITH p AS (SELECT a.o_orderkey AS id, b.o_orderkey AS other, row_number() OVER (PARTITION BY a.o_orderkey ORDER BY b.o_orderkey) AS place
FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey <> b.o_orderkey) SELECT * FROM p WHERE place <= 20""")
def related_first20(spark, sf_dir):
    return T.related(read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey", 20)


@query("""WITH o AS (SELECT o_orderkey AS id, CASE WHEN o_totalprice > 100000 THEN o_custkey || ':' || strftime(o_orderdate, '%Y-%m') END AS strong, o_custkey || ':' || o_orderpriority AS thread FROM orders)
, f AS (SELECT a.id, 1 AS tier, min(b.id) AS parent FROM o a JOIN o b ON a.strong = b.strong AND a.id <> b.id GROUP BY a.id UNION ALL SELECT a.id, 2, min(b.id) FROM o a JOIN o b ON a.thread = b.thread AND a.id <> b.id GROUP BY a.id)
SELECT id AS child, min(tier) AS tier, arg_min(parent, tier) AS parent FROM f GROUP BY id""")
def tiered_parent_link(spark, sf_dir):
    strong = F.when(F.col("o_totalprice") > 100000, F.concat_ws(":", "o_custkey", F.date_format("o_orderdate", "yyyy-MM")))
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), strong.alias("strong"), F.concat_ws(":", "o_custkey", "o_orderpriority").alias("thread"))
    return T.tiered_parent(o, o, ["strong", "thread"], "id", "id")


@query("""SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN d.doc_id IS NULL THEN 'missing_left' WHEN l.doc_id IS NULL THEN 'missing_right' ELSE 'both' END AS status
FROM (SELECT doc_id FROM documents WHERE lang <> 'de') d FULL OUTER JOIN labels l ON d.doc_id = l.doc_id""")
def full_outer_reconcile(spark, sf_dir):
    d = read(spark, sf_dir, "documents").where("lang <> 'de'").select("doc_id", F.col("doc_id").alias("server"))
    l = read(spark, sf_dir, "labels").select("doc_id", F.col("doc_id").alias("local"))
    return T.reconcile(d, l, ["doc_id"], "server", "local").select("doc_id", "status")


@query("""SELECT user_id, 'server_only' AS side FROM (SELECT user_id FROM events WHERE event_type = 'click' EXCEPT SELECT user_id FROM events WHERE event_type = 'purchase')
UNION ALL SELECT user_id, 'local_only' FROM (SELECT user_id FROM events WHERE event_type = 'purchase' EXCEPT SELECT user_id FROM events WHERE event_type = 'click')
UNION ALL SELECT user_id, 'both' FROM (SELECT user_id FROM events WHERE event_type = 'purchase' INTERSECT SELECT user_id FROM events WHERE event_type = 'click')""")
def uid_set_difference(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    server, local = (e.where(F.col("event_type") == k).select("user_id") for k in ("click", "purchase"))
    sides = {"server_only": server.subtract(local), "local_only": local.subtract(server), "both": server.intersect(local)}
    one, two, three = (df.withColumn("side", F.lit(k)) for k, df in sides.items())
    return one.unionByName(two).unionByName(three)


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL")
def group2(spark, sf_dir):
    return T.count_by(read(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus")


@query("SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL")
def group3(spark, sf_dir):
    return T.count_by(read(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus", "l_linenumber")


@query("SELECT event_type, user_id % 5 AS a, event_id % 3 AS b, user_id % 2 AS c, count(*) AS n, round(sum(value), 4) AS total, max(ts)::VARCHAR AS latest FROM events GROUP BY ALL")
def group4_sum_max(spark, sf_dir):
    keys = ["event_type", (F.col("user_id") % 5).alias("a"), (F.col("event_id") % 3).alias("b"), (F.col("user_id") % 2).alias("c")]
    return read(spark, sf_dir, "events").groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.max("ts").cast("string").alias("latest"))


@query("SELECT o_custkey, count(*) AS total, sum((o_orderstatus = 'F')::INT)::BIGINT AS ready, sum((o_orderstatus = 'O')::INT)::BIGINT AS review, sum((o_orderstatus = 'P')::INT)::BIGINT AS done FROM orders GROUP BY 1")
def conditional_sums(spark, sf_dir):
    states = {"ready": "F", "review": "O", "done": "P"}
    return read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("total"), *[F.count_if(F.col("o_orderstatus") == v).alias(k) for k, v in states.items()])


@query("SELECT event_type, count(DISTINCT user_id) AS users FROM events WHERE user_id IS NOT NULL GROUP BY 1")
def count_distinct_nonnull(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"))


@query("""SELECT unnest(['all', 'open', 'final', 'urgent', 'expensive', 'old', 'urgent_open']) AS facet, unnest([count(*), count(*) FILTER (o_orderstatus = 'O'), count(*) FILTER (o_orderstatus = 'F'), count(*) FILTER (o_orderpriority = '1-URGENT'),
count(*) FILTER (o_totalprice > 200000), count(*) FILTER (o_orderdate < TIMESTAMP '1996-01-01'), count(*) FILTER (o_orderpriority = '1-URGENT' AND o_orderstatus = 'O')]) AS n FROM orders""")
def facet_counts_one_pass(spark, sf_dir):
    status, urgent = F.col("o_orderstatus"), F.col("o_orderpriority") == "1-URGENT"
    named = {"all": F.lit(True), "open": status == "O", "final": status == "F", "urgent": urgent, "expensive": F.col("o_totalprice") > 200000, "old": F.col("o_orderdate") < "1996-01-01", "urgent_open": urgent & (status == "O")}
    return T.facets(read(spark, sf_dir, "orders"), named)


@query("SELECT n_name, c_mktsegment AS segment, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS ready, round(100.0 * count(*) FILTER (o_orderstatus = 'F') / count(*), 2)::DOUBLE AS auto_percent FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL")
def supplier_metrics(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus")
    c = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"), F.col("c_mktsegment").alias("segment"))
    n = F.broadcast(read(spark, sf_dir, "nation").select("n_nationkey", "n_name"))  # a fixed dimension of nations
    g = o.join(c, "c_custkey").join(n, "n_nationkey").groupBy("n_name", "segment").agg(F.count("*").alias("total"), F.count_if(F.col("o_orderstatus") == "F").alias("ready"))
    return g.withColumn("auto_percent", percent(F.col("ready"), F.col("total")))


@query("SELECT source, sum(strlen(coalesce(text, '')))::BIGINT AS bytes, round(sum(strlen(coalesce(text, ''))) / 1048576.0, 3)::DOUBLE AS mb, count(*) AS n FROM documents GROUP BY 1")
def traffic_bytes(spark, sf_dir):
    g = read(spark, sf_dir, "documents").groupBy("source").agg(F.sum(F.octet_length(F.coalesce("text", F.lit("")))).alias("bytes"), F.count("*").alias("n"))
    return g.select("source", "bytes", F.round(F.col("bytes") / 1048576.0, 3).alias("mb"), "n")


@query("SELECT o_orderstatus, min(o_orderdate)::VARCHAR AS oldest, max(o_orderdate)::VARCHAR AS newest, max(o_orderkey) AS watermark FROM orders GROUP BY 1")
def min_max_range(spark, sf_dir):
    return read(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.min("o_orderdate").cast("string").alias("oldest"), F.max("o_orderdate").cast("string").alias("newest"), F.max("o_orderkey").alias("watermark"))


@query("WITH l AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) SELECT user_id, event_type, event_id, value FROM l WHERE r = 1")
def latest_per_key(spark, sf_dir):
    e = read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "event_id", "value")).alias("m"))
    return e.select("user_id", "event_type", "m.event_id", "m.value")


@query("SELECT conv_id, min(turn) AS first_turn, arg_min(role, turn) AS first_role, count(*) AS turns FROM conversations GROUP BY 1")
def first_per_thread(spark, sf_dir):
    return read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min("turn").alias("first_turn"), F.min_by("role", "turn").alias("first_role"), F.count("*").alias("turns"))


@query("SELECT conv_id, turn, role, lag(role) OVER w AS before, sum(length(text)) OVER w AS so_far FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)".replace("sum(length(text)) OVER w", "(sum(length(text)) OVER w)::BIGINT"))
def thread_timeline(spark, sf_dir):
    w = W.partitionBy("conv_id").orderBy("turn")
    c = read(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", "role", F.lag("role").over(w).alias("before"), F.sum(F.length("text")).over(w.rowsBetween(W.unboundedPreceding, 0)).alias("so_far"))


@query("SELECT event_id, user_id, event_type, count(*) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 0 AS first_contact FROM events")
def prior_contact(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    first = e.groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id"))["event_id"].alias("first_id"))
    return e.join(first, ["user_id", "event_type"]).select("event_id", "user_id", "event_type", (F.col("event_id") == F.col("first_id")).alias("first_contact"))


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS position, count(*) OVER (PARTITION BY l_orderkey) AS positions_total, l_partkey FROM lineitem")
def item_positions(spark, sf_dir):
    cases = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("items"))
    out = cases.select("l_orderkey", F.size("items").cast("long").alias("positions_total"), F.posexplode("items").alias("position", "item"))
    return out.select("l_orderkey", "item.l_linenumber", F.col("position").cast("long").alias("position"), "positions_total", "item.l_partkey")


@query("SELECT l_orderkey, l_linenumber, l_partkey, count(*) OVER (PARTITION BY l_partkey) >= 5 AS frequent FROM lineitem")
def frequent_reason(spark, sf_dir):
    l = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    often = T.count_by(l, "l_partkey").select("l_partkey", (F.col("n") >= 5).alias("frequent"))
    return l.join(often, "l_partkey").select("l_orderkey", "l_linenumber", "l_partkey", "frequent")


@query("SELECT CASE WHEN s <= 20 THEN '0-20' WHEN s <= 50 THEN '21-50' WHEN s <= 80 THEN '51-80' ELSE '81-100' END AS bucket, count(*) AS n FROM (SELECT least(100, floor(o_totalprice / 4000)) AS s FROM orders) GROUP BY 1")
def risk_histogram(spark, sf_dir):
    return T.count_by(read(spark, sf_dir, "orders"), risk_bucket(F.least(F.lit(100), F.floor(F.col("o_totalprice") / 4000))).alias("bucket"))


@query("SELECT l_suppkey, count(*) FILTER (l_returnflag = 'A') AS A, count(*) FILTER (l_returnflag = 'N') AS N, count(*) FILTER (l_returnflag = 'R') AS R FROM lineitem GROUP BY 1")
def supplier_pivot(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").groupBy("l_suppkey").pivot("l_returnflag", ["A", "N", "R"]).count().na.fill(0)


@query("SELECT DISTINCT c_mktsegment AS code, n_name AS name FROM customer JOIN nation ON n_nationkey = c_nationkey")
def distinct_pairs(spark, sf_dir):
    n = F.broadcast(read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("name")))
    return read(spark, sf_dir, "customer").join(n, "c_nationkey").select(F.col("c_mktsegment").alias("code"), "name").distinct()


@query("WITH r AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders) SELECT * FROM r WHERE place <= 10")
def top_per_section(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return T.first_per(o, ["o_orderpriority"], [F.desc("o_totalprice"), F.col("o_orderkey")], 10).drop("o_totalprice")


@query("SELECT c_custkey, c_name, coalesce(n, 0)::BIGINT AS n, coalesce(total, 0)::DOUBLE AS total FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def client_list(spark, sf_dir):
    stats = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_name").join(stats, "c_custkey", "left")
    return c.select("c_custkey", "c_name", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("total", F.lit(0.0)).alias("total"))


@query("SELECT DISTINCT user_id FROM (SELECT user_id FROM events WHERE event_type = 'click' UNION SELECT user_id FROM events WHERE event_type = 'purchase' UNION SELECT user_id FROM events WHERE value > 90)")
def known_union(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.where(F.col("event_type").isin("click", "purchase") | (F.col("value") > 90)).select("user_id").distinct()
