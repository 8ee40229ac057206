"""Text, HTML and JSON functions over mail, and the flow from mail to outbox."""

from __future__ import annotations

from pyspark.sql import functions as F

from postmill.functions import dates as D
from postmill.functions import markup as M
from postmill.functions import text as X
from postmill.operators import cases as C
from postmill.operators import tables as T
from postmill.plans import routing as R
from postmill.plans.relational import read

QUERIES, SQL = {}, {}
#: Neutral phrases for the invented text of the test tables, by kind.
PHRASES = {"defect": ["idiot", "licensed under", "garbage"], "shortage": ["reserved", "trash", "loser"], "damage": ["license", "pathetic"]}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _docs(spark, sf_dir):
    return read(spark, sf_dir, "documents")


@query(r"SELECT doc_id, md5(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS norm, CASE WHEN length(trim(regexp_replace(text, '\s+', ' ', 'g'))) > 80 THEN rtrim(trim(regexp_replace(text, '\s+', ' ', 'g'))[1:79]) || '…' ELSE trim(regexp_replace(text, '\s+', ' ', 'g')) END AS short FROM documents")
def normalize_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(X.clean_ws(X.norm(F.col("text")))).alias("norm"), X.clean_ws(F.col("text"), 80).alias("short"))


@query(r"""WITH s AS (SELECT doc_id, lower(text) AS t FROM documents), w AS (SELECT doc_id, string_split(trim(regexp_replace(regexp_replace(regexp_replace(t, '^(\s*(re|fw|fwd|отв|пер)\s*:)+', ' '), '[0-9]{5,12}', ' ', 'g'), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w FROM s)
SELECT doc_id, array_to_string(list_filter(w, lambda x: length(x) > 2 AND x NOT IN ('для', 'по', 'от', 'на', 'the', 'and', 'for', 'of', 'with'))[1:8], ' ') AS template FROM w""")
def subject_template(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.subject_template(F.col("text")).alias("template"))


@query("""WITH v AS (SELECT doc_id, contains(lower(text), 'idiot')::INT + contains(lower(text), 'licensed under')::INT + contains(lower(text), 'garbage')::INT AS defect, contains(lower(text), 'reserved')::INT + contains(lower(text), 'trash')::INT + contains(lower(text), 'loser')::INT AS shortage, contains(lower(text), 'license')::INT + contains(lower(text), 'pathetic')::INT AS damage FROM documents)
SELECT doc_id, CASE WHEN greatest(defect, shortage, damage) = 0 THEN NULL WHEN damage = greatest(defect, shortage, damage) THEN 'damage' WHEN shortage = greatest(defect, shortage, damage) THEN 'shortage' ELSE 'defect' END AS kind FROM v""")
def phrase_vote(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", R.kind_vote(F.col("text"), PHRASES).alias("kind"))


@query(r"""SELECT doc_id, CASE WHEN regexp_matches(text, '[\w.+-]+@[\w-]+\.\w+') THEN 'has_mail' WHEN contains(text, ' | ') THEN 'table' WHEN contains(lower(text), 'license') THEN 'legal' WHEN n_chars < 200 THEN 'short' ELSE 'other' END AS bucket FROM documents""")
def first_match_rules(spark, sf_dir):
    t = F.col("text")
    rules = [(t.rlike(r"[\w.+-]+@[\w-]+\.\w+"), "has_mail", "pattern"), (t.contains(" | "), "table", "bars"), (F.lower(t).contains("license"), "legal", "word"), (F.col("n_chars") < 200, "short", "size")]
    return _docs(spark, sf_dir).select("doc_id", R.decide(rules, ("other", "no_rule"))["value"].alias("bucket"))


@query(r"""SELECT page_id, list_distinct(regexp_extract_all(concat(url, ' ', html), 'https?://[^\s"''<>]+')) AS l FROM pages""".replace("list_distinct(", "len(list_distinct(").replace(") AS l", ")) AS n_links"))
def links_extract(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.size(M.links(F.concat_ws(" ", "url", "html"), None)).cast("long").alias("n_links"))


@query(r"""WITH a AS (SELECT page_id, regexp_replace(coalesce(html, ''), '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<head\b.*?</head\s*>|<!--.*?-->', ' ', 'g') AS t FROM pages)
, b AS (SELECT page_id, regexp_replace(regexp_replace(t, '[\r\n\t ]+', ' ', 'g'), '(?i)</t[dh]\s*>\s*<t[dh]\b[^>]*>', ' | ', 'g') AS t FROM a)
, c AS (SELECT page_id, regexp_replace(regexp_replace(t, '(?i)<br\b[^>]*>|</(p|div|tr|li|h[1-6]|table|ul|ol)\s*>', chr(10), 'g'), '<[^>]*>', '', 'g') AS t FROM b)
, d AS (SELECT page_id, trim(regexp_replace(t, ' *\n[ \n]*', chr(10), 'g'), ' ' || chr(10)) AS t FROM c)
, e AS (SELECT page_id, replace(replace(replace(replace(t, '&nbsp;', chr(160)), '&lt;', '<'), '&gt;', '>'), '&#39;', '''') AS t FROM d)
SELECT page_id, regexp_replace(replace(replace(replace(t, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;?', '&', 'g') AS text FROM e""")
def html_to_text(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", M.html_to_text(F.col("html")).alias("text"))


@query("SELECT p_partkey, 'P-' || p_partkey AS part_number, p_name AS product_name, p_size::VARCHAR AS quantity FROM part")
def html_table_items(spark, sf_dir):
    made = F.concat(F.lit("<table><tr><th>Part number</th><th>Name</th><th>Qty</th></tr><tr><td>P-"), F.col("p_partkey").cast("string"), F.lit("</td><td>"), F.col("p_name"), F.lit("</td><td><b>"), F.col("p_size").cast("string"), F.lit("</b></td></tr></table>"))
    # few narrow rows take long, so they are dealt out first, however few row groups the file has
    parts = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
    items = parts.select("p_partkey", F.explode(M.product_items(M.table_rows(made))).alias("item"))
    return items.select("p_partkey", *[F.try_element_at("item", F.lit(k)).alias(k) for k in ("part_number", "product_name", "quantity")])


@query("SELECT lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host, count(*) AS n FROM pages GROUP BY 1")
def email_domain_hist(spark, sf_dir):
    return T.count_by(read(spark, sf_dir, "pages"), F.lower(F.regexp_extract("url", "://([^/?#]*)", 1)).alias("host"))


@query(r"SELECT doc_id, len(list_distinct(regexp_extract_all(text, '\b\d{1,2}[./]\d{1,2}[./]\d{4}\b|\b\d{4}-\d{2}-\d{2}\b'))) AS n_dates FROM documents")
def dates_in_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.size(D.dates_in(F.col("text"))).cast("long").alias("n_dates"))


@query("SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events WHERE json_extract(props, '$.k')::BIGINT > 50")
def json_path_filter(spark, sf_dir):
    k = M.field_at(F.col("props"), "k").try_cast("bigint")
    return read(spark, sf_dir, "events").select("event_id", k.alias("k")).where("k > 50")


@query("""SELECT l_orderkey, l_linenumber, x.field AS field, x.old AS before, x.new AS proposed, x.new = x.fin AS accepted FROM (SELECT l_orderkey, l_linenumber, unnest([{'field': 'flag', 'old': l_returnflag, 'new': CASE WHEN l_linestatus = 'O' THEN 'N' ELSE l_returnflag END, 'fin': 'N'},
{'field': 'status', 'old': l_linestatus, 'new': CASE WHEN l_linenumber > 3 THEN 'F' ELSE l_linestatus END, 'fin': l_linestatus}]) AS x FROM lineitem) WHERE x.old <> x.new""")
def field_diff(spark, sf_dir):
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    new_flag, new_status = F.when(status == "O", "N").otherwise(flag), F.when(F.col("l_linenumber") > 3, "F").otherwise(status)
    fields = {k: (a, b, c) for k, a, b, c in (("flag", flag, new_flag, F.lit("N")), ("status", status, new_status, status))}
    rows = read(spark, sf_dir, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", F.inline(T.changed_columns(fields)))


@query("SELECT sha256(text) AS content, min(doc_id) AS first_id, count(*) AS n, array_to_string(list_sort(list_distinct(list(source))), ',') AS folders FROM documents GROUP BY 1")
def exact_duplicates(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", "source", F.sha2("text", 256).alias("content"))
    return C.exact_duplicates(d, ["content"], "doc_id", "source").withColumn("folders", F.array_join("folders", ","))


@query(r"""WITH k AS (SELECT doc_id, sha256(lower(trim(string_split(text, chr(10))[1]))) AS key, sha256(text) AS content FROM documents WHERE text IS NOT NULL), o AS (SELECT key, content, min(doc_id) AS id FROM k GROUP BY ALL)
SELECT id, min(id) OVER (PARTITION BY key) AS duplicate_of FROM o QUALIFY id <> duplicate_of""")
def semantic_duplicates(spark, sf_dir):
    key = F.sha2(F.lower(F.trim(F.get(F.split("text", "\n"), F.lit(0)))), 256)  # the whole first line stands for the message id
    d = _docs(spark, sf_dir).where("text is not null").select("doc_id", key.alias("key"), F.sha2("text", 256).alias("content"))
    return C.semantic_duplicates(d, "key", "content", "doc_id")


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'mid:' || lower(url) WHEN page_id % 3 = 1 THEN 'raw:' || sha256(html) ELSE 'uid:inbox:' || page_id END AS key FROM pages")
def canonical_key(spark, sf_dir):
    p = F.col("page_id")
    key = C.canonical_key(F.when(p % 3 == 0, F.col("url")), F.when(p % 3 == 1, F.sha2("html", 256)).otherwise(" "), F.lit("inbox"), p.cast("string"))
    return read(spark, sf_dir, "pages").select("page_id", key.alias("key"))


@query("SELECT user_id, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS folders FROM events GROUP BY 1")
def folder_union(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("folders"))


@query("""WITH h AS (SELECT 'mail' AS entity, doc_id::VARCHAR AS id, CASE WHEN lower(lang) = 'ste' THEN 100 WHEN contains(lower(lang), 'ste') THEN 60 ELSE 60 END AS score, CASE WHEN contains(lower(lang), 'ste') THEN 'lang' ELSE 'text' END AS matched FROM documents WHERE contains(lower(text), 'ste') OR contains(lower(lang), 'ste')
UNION ALL SELECT 'client', c_custkey::VARCHAR, 60, 'c_name' FROM customer WHERE contains(lower(c_name), 'ste') UNION ALL SELECT 'part', p_partkey::VARCHAR, CASE WHEN lower(p_name) = 'ste' OR lower(p_type) = 'ste' THEN 100 ELSE 60 END, CASE WHEN contains(lower(p_name), 'ste') THEN 'p_name' ELSE 'p_type' END FROM part WHERE contains(lower(p_name), 'ste') OR contains(lower(p_type), 'ste'))
SELECT entity, id, score, matched FROM h ORDER BY score DESC, entity, id LIMIT 50""")
def union_search(spark, sf_dir):
    tiers = [C.hits(_docs(spark, sf_dir), "mail", "doc_id", ["lang", "text"], "ste"), C.hits(read(spark, sf_dir, "customer"), "client", "c_custkey", ["c_name"], "ste"), C.hits(read(spark, sf_dir, "part"), "part", "p_partkey", ["p_name", "p_type"], "ste")]
    return C.search(tiers, 50)


@query("SELECT doc_id FROM documents WHERE text ILIKE '%license%' OR source ILIKE '%rc1'")
def like_search(spark, sf_dir):
    return _docs(spark, sf_dir).where(F.col("text").ilike("%license%") | F.col("source").ilike("%rc1")).select("doc_id")


def _cases(spark, sf_dir):
    l = read(spark, sf_dir, "lineitem")
    item = F.struct(F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_quantity").alias("quantity"), F.round(F.col("l_extendedprice"), 2).alias("amount"))
    return l.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("items"))


@query("SELECT l_orderkey, l_linenumber, substring(sha1('{\"case_id\":' || l_orderkey || ',\"line\":' || l_linenumber || ',\"part\":' || l_partkey || '}'), 1, 20) AS event_key FROM lineitem")
def event_fingerprint(spark, sf_dir):
    key = X.event_hash(F.struct(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part")))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", key.alias("event_key"))


@query("SELECT (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice FROM lineitem) WHERE l_orderkey % 2 = 1) AS appended, 0::BIGINT AS second_run")
def outbox_idempotent(spark, sf_dir):
    events = C.outbox_events(_cases(spark, sf_dir), "l_orderkey", "items", F.lit("return_ready"))
    first = C.append_new(events, events.where("case_id % 2 = 0"))
    every = events.where("case_id % 2 = 0").select("event_key").union(first.select("event_key"))
    return first.agg(F.count("*").alias("appended")).join(C.append_new(events, every).agg(F.count("*").alias("second_run")), F.lit(True))


@query("""SELECT o_orderkey AS case_id, to_json({'case_id': o_orderkey, 'source': {'customer': o_custkey, 'received': strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')}, 'items': items, 'totals': {'positions': len(items), 'amount': round(list_sum(list_transform(items, lambda x: x.amount)), 2)}, 'internal': {'state': o_orderstatus}})::VARCHAR AS document
FROM orders JOIN (SELECT l_orderkey, list({'line': l_linenumber, 'part': l_partkey, 'quantity': l_quantity, 'amount': round(l_extendedprice, 2)} ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice) AS items FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def export_document(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("customer"), F.col("o_orderdate").cast("string").alias("received"), F.col("o_orderstatus").alias("state"))
    cases = _cases(spark, sf_dir).join(o, F.col("o_orderkey") == F.col("l_orderkey")).withColumn("case_id", F.col("o_orderkey"))
    return C.export_document(cases, "items", "debug")


@query("SELECT role, count(*) AS n, count(*) FILTER (contains(text, '?')) AS questions, round(avg(length(text)), 4) AS mean_chars FROM conversations GROUP BY 1")
def thread_roles(spark, sf_dir):
    return read(spark, sf_dir, "conversations").groupBy("role").agg(F.count("*").alias("n"), F.count_if(F.col("text").contains("?")).alias("questions"), F.round(F.avg(F.length("text")), 4).alias("mean_chars"))


@query(r"SELECT doc_id, md5(regexp_replace(trim(regexp_replace(regexp_replace(replace(lower(text), 'ё', 'е'), '[№#]', 'n', 'g'), '\s+', ' ', 'g')), '[\s\-_/.,:;]', '', 'g')) AS identifier FROM documents")
def identifier_norm(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(X.identifier(F.col("text"))).alias("identifier"))
