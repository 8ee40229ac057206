"""Queries over tables that are kept: versions and their differences, gated saves, the outbox, the index of identifiers, threads."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from postmill.operators import index as I
from postmill.operators.threads import Threads
from postmill.plans.relational import read
from postmill.sources import versions as V
from postmill.streaming import flows
from postmill.streaming.flows import work_folder

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# versions


def _orders(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


_RETURNED = "SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1 HAVING count(*) >= 3"


@query(f"""WITH back AS ({_RETURNED}), poor AS (SELECT c_custkey FROM customer WHERE c_acctbal < 0)
SELECT o_orderkey, CASE WHEN o_custkey IN (SELECT * FROM poor) THEN 'removed' ELSE 'changed' END AS change FROM orders WHERE o_custkey IN (SELECT * FROM poor) OR (o_orderkey IN (SELECT * FROM back) AND o_orderstatus <> 'R')
UNION ALL SELECT -1 - l_orderkey, 'added' FROM back""")
def snapshot_diff(spark, sf_dir):
    table = V.VersionedTable(spark, work_folder(spark), ["o_orderkey"], 32)
    o = _orders(spark, sf_dir)
    table.upsert(o)
    back = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy("l_orderkey").count().where("count >= 3")
    poor = read(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    good = o.join(poor, "o_custkey", "left_anti")
    changed = good.join(back, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").withColumn("o_orderstatus", F.lit("R")).select(o.columns)
    new = back.select((-1 - F.col("l_orderkey")).alias("o_orderkey"), F.lit(0).cast("long").alias("o_custkey"), F.lit("R").alias("o_orderstatus"), F.lit(0.0).alias("o_totalprice"))
    table.upsert(changed.unionByName(new), o.join(poor, "o_custkey", "left_semi"))
    return V.difference(table, table, 1, 2)


def save_gated(table: V.VersionedTable, cases, passed, repairs, ready: str = "ready_to_1c", review: str = "needs_review"):
    """Save cases by key: those that do not pass are repaired and asked again; who still fails loses the ready state. Gives the new version.

    ``passed`` is a condition, ``repairs`` has a column for each field that may be put right; both see the row before the
    repair. A repair that is null leaves its field. Adds gate_passed and repaired (array of names) to the row.
    """
    fails = ~F.coalesce(passed, F.lit(False))
    new = {f: F.when(fails & c.isNotNull(), c).otherwise(F.col(f)) for f, c in repairs.items()}
    done = F.array_compact(F.array(*[F.when(fails & c.isNotNull() & ~F.col(f).eqNullSafe(c), F.lit(f)) for f, c in repairs.items()]))
    rows = cases.withColumn("repaired", done).select(*[c for c in cases.columns if c not in new], "repaired", *[c.alias(f) for f, c in new.items()])
    ok = F.coalesce(passed, F.lit(False))
    rows = rows.withColumn("gate_passed", ok).withColumn("state", F.when(~ok & (F.col("state") == ready), review).otherwise(F.col("state")))
    return table.upsert(rows.select(*cases.columns, "repaired", "gate_passed"))


_GATE = "WITH l AS (SELECT l_orderkey, min(l_shipdate) AS ship FROM lineitem GROUP BY 1), c AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN 'ready_to_1c' ELSE 'open' END AS state, CASE WHEN o_orderkey % 7 > 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day, CASE WHEN o_orderkey % 5 > 0 THEN 'AB-' || o_custkey END AS part, strftime(ship, '%Y-%m-%d') AS ship, o_totalprice FROM orders LEFT JOIN l ON l_orderkey = o_orderkey)"


@query(_GATE + """, r AS (SELECT *, part IS NOT NULL AND day IS NOT NULL AS ok, coalesce(day, ship) AS new_day FROM c)
SELECT o_orderkey, new_day AS day, part, CASE WHEN state = 'ready_to_1c' AND (part IS NULL OR new_day IS NULL) THEN 'needs_review' ELSE state END AS state, part IS NOT NULL AND new_day IS NOT NULL AS gate_passed, CASE WHEN day IS NULL AND ship IS NOT NULL THEN 'day' ELSE '' END AS repaired FROM r""")
def gated_save(spark, sf_dir):
    ship = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.date_format(F.min("l_shipdate"), "yyyy-MM-dd").alias("ship"))
    k = F.col("o_orderkey")
    cases = read(spark, sf_dir, "orders").join(ship, "o_orderkey", "left").select(
        k, F.when(F.col("o_orderstatus") != "P", "ready_to_1c").otherwise("open").alias("state"), F.when(k % 7 > 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day"), F.when(k % 5 > 0, F.concat(F.lit("AB-"), F.col("o_custkey").cast("string"))).alias("part"), "ship",
    )
    table = V.VersionedTable(spark, work_folder(spark), ["o_orderkey"], 32)
    save_gated(table, cases, F.col("part").isNotNull() & F.col("day").isNotNull(), {"day": F.coalesce("day", "ship")})
    return table.read().select("o_orderkey", "day", "part", "state", "gate_passed", F.array_join("repaired", ",").alias("repaired"))


def reconcile_outbox(outbox: V.VersionedTable, events) -> dict[str, int]:
    """Queue each event whose key the outbox does not have; keys that are there keep their status. Gives the number of rows before and after."""
    m = outbox.manifest()
    before = sum(x["rows"] for x in m["buckets"].values())
    rows = events.withColumn("status", F.lit("new"))
    outbox.upsert(rows.join(outbox.read().select(*outbox.key), outbox.key, "left_anti") if before else rows)
    return {"before": before, "after": sum(x["rows"] for x in outbox.manifest()["buckets"].values())}


@query("SELECT status, count(*) AS n FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_linestatus = 'F' AND max(l_linestatus) = min(l_linestatus) THEN 'sent' ELSE 'new' END AS status FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_linestatus FROM lineitem) GROUP BY l_orderkey, l_linenumber, l_linestatus QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_linestatus) = 1) GROUP BY 1")
def outbox_reconciled(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("event_key"), "l_linestatus")
    outbox = V.VersionedTable(spark, work_folder(spark), ["event_key"], 32)
    outbox.upsert(rows.where("l_linestatus = 'F'").select("event_key", F.lit("sent").alias("status")))
    for _ in range(2):  # asking twice queues nothing twice
        reconcile_outbox(outbox, rows.select("event_key").distinct())
    return outbox.read().groupBy("status").agg(F.count("*").alias("n"))


# identifiers


def identifiers(spark, sf_dir) -> I.IdentifierIndex:
    """An index of orders, customers, parts and suppliers, in two segments, merged."""
    index = I.IdentifierIndex(spark, work_folder(spark))
    key = lambda c: F.col(c).cast("string")
    index.append(
        I.postings(read(spark, sf_dir, "orders"), "case", "o_orderkey", {"case_id": key("o_orderkey"), "buyer": key("o_custkey"), "export_id": F.concat(F.lit("EX-"), key("o_orderkey"), F.lit("/"), key("o_custkey"))}),
        I.postings(read(spark, sf_dir, "part"), "part", "p_partkey", {"part_number": key("p_partkey"), "name": F.col("p_name"), "brand": F.col("p_brand")}),
    )
    index.append(
        I.postings(read(spark, sf_dir, "customer"), "buyer", "c_custkey", {"buyer": key("c_custkey"), "name": F.col("c_name"), "segment": F.col("c_mktsegment")}),
        I.postings(read(spark, sf_dir, "supplier"), "supplier", "s_suppkey", {"name": F.col("s_name")}),
    )
    index.merge()
    return index


@query("""WITH w AS (SELECT s_suppkey, s_suppkey::VARCHAR AS t FROM supplier), f AS (SELECT s_suppkey, t, 'case' AS entity, o_orderkey AS id, 'case_id' AS field FROM w JOIN orders ON o_orderkey::VARCHAR = t UNION ALL SELECT s_suppkey, t, 'case', o_orderkey, 'buyer' FROM w JOIN orders ON o_custkey::VARCHAR = t
UNION ALL SELECT s_suppkey, t, 'part', p_partkey, 'part_number' FROM w JOIN part ON p_partkey::VARCHAR = t UNION ALL SELECT s_suppkey, t, 'buyer', c_custkey, 'buyer' FROM w JOIN customer ON c_custkey::VARCHAR = t)
SELECT s_suppkey, entity, id::VARCHAR AS id, field FROM f""")
def ids_found(spark, sf_dir):
    asked = read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_suppkey").cast("string").alias("ask"))
    return identifiers(spark, sf_dir).lookup_many(asked, "ask").select("s_suppkey", "entity", F.col("found_id").alias("id"), "field")


@query("""SELECT 'part' AS entity, p_partkey::VARCHAR AS id, CASE WHEN p_name = 'small ring' THEN 100 ELSE 60 END AS score FROM part WHERE contains(p_name, 'all ri')
UNION ALL SELECT 'case', o_orderkey::VARCHAR, 60 FROM orders WHERE contains('ex' || o_orderkey || o_custkey, 'allri')""")
def text_found(spark, sf_dir):
    found = identifiers(spark, sf_dir).lookup("ALL Ri", limit=None)
    return found.select("entity", "id", F.when(F.col("value") == "smallring", 100).otherwise(F.col("score")).alias("score"))


# threads


@query("""WITH o AS (SELECT o_orderkey, o_custkey, coalesce(o_orderkey - lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) > 900, true)::INT AS fresh FROM orders), s AS (SELECT *, sum(fresh) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM o)
SELECT o_orderkey, min(o_orderkey) OVER (PARTITION BY o_custkey, k) AS thread FROM s""")
def thread_groups(spark, sf_dir):
    before = F.lag("o_orderkey").over(W.partitionBy("o_custkey").orderBy("o_orderkey"))
    o = read(spark, sf_dir, "orders").select("o_orderkey", before.alias("before"))
    answers = F.when(F.col("o_orderkey") - F.col("before") <= 900, F.col("before"))
    edges = o.select(F.col("o_orderkey").alias("a"), F.coalesce(answers, "o_orderkey").alias("b"))
    threads = Threads(spark, work_folder(spark))
    for k in range(2):  # replies come before what they answer as often as after
        threads.extend(edges.where(F.pmod(F.xxhash64("a"), F.lit(2)) == k))
    return threads.read().select(F.col("node").alias("o_orderkey"), F.col("component").alias("thread"))


@query("SELECT n.user_id, n.event_id AS notice_id, r.event_id AS return_id FROM events n JOIN events r ON n.user_id = r.user_id AND r.ts >= n.ts - INTERVAL 20 MINUTE AND r.ts <= n.ts + INTERVAL 2 HOUR WHERE n.event_type = 'error' AND r.event_type = 'purchase'")
def stream_late_links(spark, sf_dir):
    e = lambda kind, name: flows.stream(spark, f"{sf_dir}/events.parquet").where(F.col("event_type") == kind).select("user_id", F.col("event_id").alias(f"{name}_id"), F.col("ts").cast("timestamp").alias(f"{name}_at"))
    folder = work_folder(spark)
    flows.to_parquet(flows.late_links(e("error", "notice"), e("purchase", "return"), "user_id", "20 minutes", "2 hours"), f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/out").select("user_id", "notice_id", "return_id")
