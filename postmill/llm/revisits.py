"""Resolution of WARC not-modified revisits: an as-of join by canonical URL to the latest earlier full response."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from postmill.llm.scratch import materialize

#: Fields of a not-modified answer that never replace those of the stored response: they describe the body or the hop.
NOT_MERGED = ["connection", "content-encoding", "content-length", "content-md5", "content-range", "content-type", "keep-alive", "proxy-authenticate", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade"]


def canonical_url(url: Column) -> Column:
    """Host, path and query without scheme, user, www., the scheme's own port, fragment, utm_ parameters and a slash at the path's end; host in lower case."""
    scheme = F.lower(F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*)://", 1))
    plain = F.regexp_replace(F.regexp_replace(url, r"(?s)#.*$", ""), r"^[a-zA-Z][a-zA-Z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(plain, r"^[^/?]*", 0)), r"^[^@]*@", "")
    host = F.when(scheme == "http", F.regexp_replace(host, r":80$", "")).when(scheme == "https", F.regexp_replace(host, r":443$", "")).otherwise(host)
    path = F.regexp_extract(plain, r"(?s)^[^/?]*([^?]*)", 1)
    query = F.regexp_replace(F.regexp_replace(plain, r"^[^?]*", ""), r"([?&])utm_[^&]*", r"$1")
    query = F.regexp_replace(F.regexp_replace(query, r"&&+", "&"), r"\?&+", "?")
    return F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, r"/$", ""), F.regexp_replace(query, r"[?&]+$", ""))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """(record_id, url_key, status, response_id, headers, payload_digest) for each revisit of ``records``.

    ``records``: record_id long, type ('response' or 'revisit'; others are ignored), url string, ts timestamp, etag string,
    last_modified string, headers map<string, string>, payload_digest string; other columns are not read. The response is
    the last one of the same canonical URL before the revisit, by (ts, record_id); one equal in both counts as before, and
    of responses equal in both the greatest by (etag, last_modified, payload_digest, headers) is taken. Status: resolved if the strongest
    validator that the revisit has (etag compared weakly, else last_modified, else payload_digest) equals the response's;
    mismatch if not; no_validator if it has none; no_response without an earlier response, or with a null url or ts. Only
    resolved rows have headers and a digest: the response's headers (lower-case names), replaced or extended by the
    revisit's, but for NOT_MERGED. Repeated rows resolve alike; very long URLs are compared whole; a null header map is empty; an empty table gives none.

    Skew: captures are range-partitioned by (url_key, ts, record_id, type), so a URL with a third of all captures, be they of
    one day or one second, is cut into many blocks of even size. Windows run within a URL's block; the last response of
    each block is carried to later blocks over one small row a block. The blocks are written before use, so that both
    reads see the same cuts.
    """
    pairs = F.map_entries(F.coalesce("headers", F.expr("cast(map() as map<string,string>)")))
    last = F.filter(pairs, lambda e, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda f: F.lower(f["key"]) == F.lower(e["key"])))
    lower = F.map_from_entries(F.transform(last, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))))
    rows = records.where(F.col("type").isin("response", "revisit")).select("record_id", "type", canonical_url(F.col("url")).alias("url_key"), F.col("ts").cast("timestamp").alias("ts"), F.regexp_replace("etag", "^W/", "").alias("etag"), "last_modified", "payload_digest", lower.alias("headers"))
    full = F.when((F.col("type") == "response") & F.col("ts").isNotNull(), F.struct("ts", "record_id", "etag", "last_modified", "payload_digest", F.map_entries("headers").alias("headers")))
    usable = rows.where("url_key is not null and ts is not null").repartitionByRange("url_key", "ts", "record_id", "type").withColumn("block", F.spark_partition_id())
    usable = materialize(records.sparkSession, usable, "captures").withColumn("full", full)
    inside = W.partitionBy("url_key", "block").orderBy("ts", "record_id", "type", "full").rowsBetween(W.unboundedPreceding, 0)
    near = usable.withColumn("near", F.last("full", ignorenulls=True).over(inside)).where("type = 'revisit'")
    blocks = usable.groupBy("url_key", "block").agg(F.max("full").alias("full"))
    carried = blocks.withColumn("far", F.last("full", ignorenulls=True).over(W.partitionBy("url_key").orderBy("block").rowsBetween(W.unboundedPreceding, -1))).where("far is not null").select("url_key", "block", "far")
    found = near.join(carried, ["url_key", "block"], "left").withColumn("was", F.coalesce("near", "far"))
    rest = rows.where("type = 'revisit' and (url_key is null or ts is null)").select("record_id", "url_key", F.lit("no_response").alias("status"), F.lit(None).cast("long").alias("response_id"), F.lit(None).cast("map<string,string>").alias("headers"), F.lit(None).cast("string").alias("payload_digest"))
    same = F.when(F.col("etag").isNotNull(), F.coalesce(F.col("etag") == F.col("was.etag"), F.lit(False)))
    same = same.when(F.col("last_modified").isNotNull(), F.coalesce(F.col("last_modified") == F.col("was.last_modified"), F.lit(False)))
    same = same.when(F.col("payload_digest").isNotNull(), F.coalesce(F.col("payload_digest") == F.col("was.payload_digest"), F.lit(False)))
    status = F.when(F.col("was").isNull(), "no_response").when(same.isNull(), "no_validator").when(same, "resolved").otherwise("mismatch")
    permitted = F.map_filter("headers", lambda k, _: ~k.isin(NOT_MERGED))
    merged = F.map_zip_with(F.map_from_entries("was.headers"), permitted, lambda _, old, new: F.coalesce(new, old))
    ok = F.col("status") == "resolved"
    out = found.withColumn("status", status).select("record_id", "url_key", "status", F.col("was.record_id").alias("response_id"), F.when(ok, merged).alias("headers"), F.when(ok, F.col("was.payload_digest")).alias("payload_digest"))
    return out.unionByName(rest)
