"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm import bpe, decontaminate, embedding_join, html_text, impact_index, line_dedup, near_dup, periodic, quality, revisits, shards, suffix_dedup, url_filter
from postmill.llm.scratch import shared_dir


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    store = shards.shard_in_arrivals(spark, _read(spark, sf_dir, "documents"), root, "doc_id")
    return store.read().select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("text_md5"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_join.similar_embeddings(spark, _read(spark, sf_dir, "embeddings"), 0.98)


def crawl_records(pages: DataFrame) -> DataFrame:
    """Captures made from ``pages``: a full response of each page but every seventh, and a later not-modified revisit of each page.

    Every third revisit has another etag, every fifth has only a date, every eleventh has no validator.
    """
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_id") * 600)
    p, digest = F.col("page_id"), F.md5(F.coalesce("html", F.lit("")))
    day = F.concat(F.lit("day "), (p % 28).cast("string"))
    fixed = [F.lit("content-length"), F.length(F.coalesce("html", F.lit(""))).cast("string"), F.lit("server"), F.lit("one")]
    full = pages.where((p % 7 != 0) | p.isNull()).select((2 * p).alias("record_id"), F.lit("response").alias("type"), "url", at.alias("ts"), F.concat(F.lit('"'), digest, F.lit('"')).alias("etag"), day.alias("last_modified"), F.create_map(*fixed, F.lit("Cache-Control"), F.lit("no-cache")).alias("headers"), digest.alias("payload_digest"))
    etag = F.when((p % 5 == 0) | (p % 11 == 0), F.lit(None).cast("string")).when(p % 3 == 0, F.lit('"other"')).otherwise(F.concat(F.lit('W/"'), digest, F.lit('"')))
    late = pages.select((2 * p + 1).alias("record_id"), F.lit("revisit").alias("type"), F.concat("url", F.lit("#again")).alias("url"), (at + F.make_interval(hours=F.lit(30))).alias("ts"), etag.alias("etag"), F.when(p % 11 != 0, day).alias("last_modified"), F.create_map(F.lit("content-length"), F.lit("0"), F.lit("cache-control"), F.concat(F.lit("max-age="), p.cast("string"))).alias("headers"), F.lit(None).cast("string").alias("payload_digest"))
    return full.unionByName(late)


def header_lines(headers: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")


def op3_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = revisits.resolve_revisits(crawl_records(_read(spark, sf_dir, "pages")))
    return out.withColumn("headers", header_lines(F.col("headers")))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(spark, _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(spark, _read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.md5("text").alias("text_md5"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(spark, _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.tokenize(spark, _read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(spark, _read(spark, sf_dir, "pages"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(spark, _read(spark, sf_dir, "documents"))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(spark, _read(spark, sf_dir, "pages"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact_index.ranked_search(spark, _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), 10)


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(spark, _read(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.periodic_runs(spark, _read(spark, sf_dir, "documents"), plant=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_shards, op2_embedding_near_dedup, op3_revisits, op4_quality, op5_line_dedup, op6_decontamination, op7_bpe, op8_url_filter, op9_near_dedup, op10_html, op11_ranked_search, op12_suffix_dedup, op13_periodic_runs)}

_REACH = """
, linked AS (SELECT x, y FROM pairs UNION ALL SELECT y, x FROM pairs)
, reach(id, r) AS (SELECT x, x FROM linked UNION SELECT reach.id, linked.y FROM reach JOIN linked ON linked.x = reach.r)
, top AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id)"""

ORACLE_SQL: dict[str, str] = {
    "op1_shards": "SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5 FROM documents",
    "op2_embedding_near_dedup": f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0)
, pairs AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98){_REACH}
SELECT e.vec_id, (SELECT count(*) FROM linked WHERE linked.x = e.vec_id)::BIGINT AS n_links, coalesce(t.component_id, e.vec_id) AS component_id, coalesce(t.component_id, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN top t ON t.id = e.vec_id""",
    "op3_revisits": r"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, md5(coalesce(html, '')) AS digest, 'day ' || (page_id % 28) AS day, 1700000000 + page_id * 600 AS sec FROM pages)
, rec AS (
  SELECT 2 * page_id AS record_id, 'response' AS type, url, sec, '"' || digest || '"' AS etag, day AS lm, length(html) AS size, digest, NULL AS age FROM p WHERE page_id % 7 <> 0
  UNION ALL
  SELECT 2 * page_id + 1, 'revisit', url || '#again', sec + 108000, CASE WHEN page_id % 5 = 0 OR page_id % 11 = 0 THEN NULL WHEN page_id % 3 = 0 THEN '"other"' ELSE '"' || digest || '"' END, CASE WHEN page_id % 11 <> 0 THEN day END, NULL, NULL, page_id FROM p)
, plain AS (SELECT *, regexp_replace(regexp_replace(url, '(?s)#.*$', ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://', '') AS u FROM rec)
, cut AS (SELECT *, lower(regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*)://', 1)) AS scheme, regexp_replace(lower(regexp_extract(u, '^[^/?]*')), '^[^@]*@', '') AS h, regexp_replace(regexp_extract(u, '(?s)^[^/?]*([^?]*)', 1), '/$', '') AS path, regexp_replace(u, '^[^?]*', '') AS query FROM plain)
, keyed AS (SELECT *, regexp_replace(CASE scheme WHEN 'http' THEN regexp_replace(h, ':80$', '') WHEN 'https' THEN regexp_replace(h, ':443$', '') ELSE h END, '^www\.', '') || path
  || regexp_replace(regexp_replace(regexp_replace(regexp_replace(query, '([?&])utm_[^&]*', '\1', 'g'), '&&+', '&', 'g'), '\?&+', '?', 'g'), '[?&]+$', '') AS url_key FROM cut)
, seen AS (SELECT *, last_value(CASE WHEN type = 'response' THEN {'id': record_id, 'etag': etag, 'lm': lm, 'size': size, 'digest': digest} END IGNORE NULLS) OVER (PARTITION BY url_key ORDER BY sec, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS was FROM keyed)
, judged AS (SELECT *, CASE WHEN was IS NULL THEN 'no_response' WHEN etag IS NOT NULL THEN CASE WHEN etag = was.etag THEN 'resolved' ELSE 'mismatch' END WHEN lm IS NOT NULL THEN CASE WHEN lm = was.lm THEN 'resolved' ELSE 'mismatch' END ELSE 'no_validator' END AS status FROM seen WHERE type = 'revisit')
SELECT record_id, url_key, status, was.id AS response_id, CASE WHEN status = 'resolved' THEN concat('cache-control: max-age=', age, chr(10), 'content-length: ', was.size, chr(10), 'server: one') END AS headers, CASE WHEN status = 'resolved' THEN was.digest END AS payload_digest FROM judged""",
    "op5_line_dedup": r"""
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents)
, f AS (SELECT doc_id, lines, list_filter(range(1, len(lines) + 1), lambda i: trim(lines[i]) <> '') AS full_lines FROM l)
, w AS (SELECT doc_id, unnest(list_transform(range(1, len(full_lines) - 1), lambda i: {'at': full_lines[i], 'cover': full_lines[i:i + 2], 'h': md5(concat(trim(lines[full_lines[i]]), chr(10), trim(lines[full_lines[i + 1]]), chr(10), trim(lines[full_lines[i + 2]])))})) AS x FROM f WHERE len(full_lines) >= 3)
, ranked AS (SELECT doc_id, x.cover AS cover, (doc_id, x.at) <> first_value((doc_id, x.at)) OVER (PARTITION BY x.h ORDER BY doc_id, x.at) AS later FROM w)
, cuts AS (SELECT doc_id, list_distinct(flatten(list(cover))) AS gone FROM ranked WHERE later GROUP BY doc_id)
SELECT l.doc_id, coalesce(len(lines), 0)::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_removed,
  md5(CASE WHEN gone IS NULL THEN text ELSE coalesce(array_to_string(list_transform(list_filter(range(1, len(lines) + 1), lambda i: NOT list_contains(gone, i)), lambda i: lines[i]), chr(10)), '') END) AS text_md5
FROM l LEFT JOIN cuts USING (doc_id)""",
    "op6_decontamination": r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents)
, b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark)
, items AS (SELECT item_id, least(len(w), 5) AS k, unnest(list_distinct(list_transform(range(1, len(w) - least(len(w), 5) + 2), lambda i: array_to_string(w[i:i + least(len(w), 5) - 1], ' ')))) AS g FROM b WHERE len(w) > 0)
, sizes AS (SELECT item_id, count(*) AS n FROM items GROUP BY item_id)
, grams AS (SELECT DISTINCT doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g FROM d, (SELECT DISTINCT k FROM items) WHERE len(w) >= k)
, found AS (SELECT doc_id, item_id FROM grams JOIN items USING (k, g) JOIN sizes USING (item_id) GROUP BY doc_id, item_id, n HAVING 100 * count(*) >= 75 * n)
, listed AS (SELECT doc_id, count(*) AS n, string_agg(item_id::VARCHAR, ',' ORDER BY item_id) AS ids FROM found GROUP BY doc_id)
SELECT doc_id, n IS NOT NULL AS contaminated, coalesce(n, 0)::BIGINT AS n_items, coalesce(ids, '') AS item_ids FROM documents LEFT JOIN listed USING (doc_id)""",
    "op9_near_dedup": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents)
, s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w)
, e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s)
, pairs AS (SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))){_REACH}
SELECT s.doc_id, len(s)::BIGINT AS n_shingles, coalesce(component_id, s.doc_id) AS component_id, coalesce(component_id, s.doc_id) = s.doc_id AS kept FROM s LEFT JOIN top ON top.id = s.doc_id""",
    "op11_ranked_search": r"""
WITH plain AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w, row_number() OVER () AS row FROM documents)
, all_docs AS (SELECT count(*)::BIGINT AS docs, sum(len(w))::BIGINT AS words FROM plain WHERE len(w) > 0)
, tf AS (SELECT row, doc_id, len(w)::BIGINT AS n, term, count(*)::BIGINT AS tf FROM (SELECT row, doc_id, w, unnest(w) AS term FROM plain) GROUP BY ALL)
, df AS (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term)
, asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark WHERE item_id IS NOT NULL)
, scored AS (SELECT item_id, row, doc_id, sum(floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * docs) // words)))))::BIGINT AS score
  FROM asked JOIN tf USING (term) JOIN df USING (term), all_docs WHERE doc_id IS NOT NULL GROUP BY item_id, row, doc_id)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0 QUALIFY rank <= 10""",
    "op12_suffix_dedup": r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, row_number() OVER () AS row FROM documents)
, pieces AS (SELECT row, doc_id, 256 * p AS base, substr(x, 512 * p + 1, 610) AS y FROM (SELECT row, doc_id, x, unnest(range(0, len(x) // 512 + 1)) AS p FROM d WHERE doc_id IS NOT NULL))
, windows AS (SELECT row, doc_id, base, y, unnest(range(0, least(256, len(y) // 2 - 49))) AS k FROM pieces WHERE len(y) >= 100)
, keyed AS (SELECT row, doc_id, base + k AS i, md5_number(substr(y, 2 * k + 1, 100)) AS s FROM windows)
, least_doc AS (SELECT s, min(doc_id) AS lo FROM keyed GROUP BY s HAVING min(doc_id) < max(doc_id))
, hits AS (SELECT row, i FROM keyed JOIN least_doc USING (s) WHERE lo < doc_id)
, marked AS (SELECT row, i, max(i + 50) OVER (PARTITION BY row ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM hits)
, numbered AS (SELECT row, i, count_if(before IS NULL OR i > before) OVER (PARTITION BY row ORDER BY i) AS span FROM marked)
, spans AS (SELECT row, span, min(i) AS a, max(i) + 50 AS b FROM numbered GROUP BY row, span)
, listed AS (SELECT row, count(*) AS n, sum(b - a) AS size, list(a ORDER BY a) AS starts, list(b ORDER BY a) AS ends FROM spans GROUP BY row)
, kept AS (SELECT doc_id, x, n, size, CASE WHEN n IS NULL THEN x ELSE array_to_string(list_transform(range(1, n + 2), lambda k: substr(x, 2 * (CASE WHEN k = 1 THEN 0 ELSE ends[k - 1] END) + 1, 2 * ((CASE WHEN k > n THEN len(x) // 2 ELSE starts[k] END) - (CASE WHEN k = 1 THEN 0 ELSE ends[k - 1] END)))), '') END AS rest FROM d LEFT JOIN listed USING (row))
SELECT doc_id, (len(x) // 2)::BIGINT AS n_bytes, coalesce(size, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans, sha256(unhex(rest)) AS kept_sha256 FROM kept""",
}
