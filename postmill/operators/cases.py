"""Deduplication, merges, outbox events and search over mail and cases."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions.text import event_hash


def canonical_key(message_id: Column, raw_hash: Column, mailbox: Column, uid: Column) -> Column:
    """The message id in lower case, else the hash of the raw mail, else mailbox and uid."""
    some = lambda x: F.nullif(F.trim(F.lower(x)), F.lit(""))
    return F.coalesce(F.concat(F.lit("mid:"), some(message_id)), F.concat(F.lit("raw:"), some(raw_hash)), F.concat_ws(":", F.lit("uid"), mailbox, uid))


def exact_duplicates(rows: DataFrame, key: Sequence[str], id_col: str, folder: str) -> DataFrame:
    """One row for each equal key: its lowest id, how many rows it has, and the sorted folders it was seen in."""
    return rows.groupBy(*key).agg(F.min(id_col).alias("first_id"), F.count("*").alias("n"), F.array_sort(F.collect_set(folder)).alias("folders"))


def semantic_duplicates(rows: DataFrame, key: str, content: str, id_col: str) -> DataFrame:
    """(id, duplicate_of): rows of a key whose content differs from its lowest id's row, linked to it.

    Rows with the same key and content are one mail, and only the lowest of them is looked at.
    """
    one = rows.groupBy(key, content).agg(F.min(id_col).alias("id"))
    lowest = one.groupBy(key).agg(F.min("id").alias("first"))
    return one.join(lowest, key).where("id <> first").select("id", F.col("first").alias("duplicate_of"))


def merge_folders(old: Column, mailbox: Column) -> Column:
    """The folders with one more, if it is not there yet; order kept."""
    return F.array_union(F.coalesce(old, F.array().cast("array<string>")), F.array(mailbox))


def outbox_events(cases: DataFrame, case_id: str, items: str, event_type: Column) -> DataFrame:
    """One event a position of a case, with an idempotent key: the hash of case, type, position and item."""
    out = cases.select(F.col(case_id).alias("case_id"), event_type.alias("event_type"), F.size(items).alias("positions_total"), F.posexplode(items).alias("position_index", "item"))
    key = event_hash(F.struct("case_id", "event_type", "position_index", "item"))
    return out.withColumn("event_key", F.concat_ws(":", "event_type", key))


def append_new(events: DataFrame, existing: DataFrame) -> DataFrame:
    """The events whose key the outbox does not have; a second run appends nothing."""
    return events.dropDuplicates(["event_key"]).join(existing.select("event_key"), "event_key", "left_anti")


def export_document(cases: DataFrame, items: str, profile: str = "standard") -> DataFrame:
    """(case_id, document): the export JSON; the minimal profile leaves totals out, debug adds the internal state."""
    fields = [F.col("case_id"), F.struct("customer", "received").alias("source"), F.col(items).alias("items")]
    if profile != "minimal":
        fields.append(F.struct(F.size(items).alias("positions"), F.round(F.aggregate(items, F.lit(0.0), lambda s, x: s + x["amount"]), 2).alias("amount")).alias("totals"))
    if profile == "debug":
        fields.append(F.struct("state").alias("internal"))
    return cases.select("case_id", F.to_json(F.struct(*fields)).alias("document"))


def search(tiers: Sequence[DataFrame], limit: int = 50) -> DataFrame:
    """(entity, id, score, matched): union of hit tables of that shape, each entity's best score, best first."""
    every = reduce(DataFrame.unionByName, tiers)
    best = every.groupBy("entity", "id").agg(F.max(F.struct("score", "matched")).alias("m")).select("entity", "id", "m.score", "m.matched")
    return best.orderBy(F.desc("score"), "entity", "id").limit(limit)


def hits(rows: DataFrame, entity: str, id_col: str, columns: Sequence[str], text: str, exact: int = 100, inside: int = 60) -> DataFrame:
    """Rows where a column equals (score ``exact``) or holds (``inside``) the text, case ignored; the earlier column wins."""
    low = text.lower()
    found = F.when(F.lit(False), F.struct(F.lit(0).alias("score"), F.lit("").alias("matched")))
    for c in columns:
        found = found.when(F.lower(F.col(c)) == low, F.struct(F.lit(exact).alias("score"), F.lit(c).alias("matched")))
    for c in columns:
        found = found.when(F.lower(F.col(c)).contains(low), F.struct(F.lit(inside).alias("score"), F.lit(c).alias("matched")))
    return rows.select(F.lit(entity).alias("entity"), F.col(id_col).cast("string").alias("id"), found.alias("m")).where("m is not null").select("entity", "id", "m.score", "m.matched")


def age_out(rows: DataFrame, received: Column, now: Column, body_days: int, attachment_days: int, body: str, attachments: str) -> DataFrame:
    """Bodies older than one age and attachments older than another become null; nulls of the time age nothing."""
    old = lambda days: received < now - F.make_dt_interval(days=F.lit(days))
    return rows.withColumn(body, F.when(~F.coalesce(old(body_days), F.lit(False)), F.col(body))).withColumn(attachments, F.when(~F.coalesce(old(attachment_days), F.lit(False)), F.col(attachments)))


def outside_period(received: Column, start: str, end: str) -> Column:
    """Before the start or after the end; a row without a date counts as before."""
    day = F.coalesce(F.to_date(received), F.lit("0001-01-01").cast("date"))
    return (day < F.lit(start).cast("date")) | (day > F.lit(end).cast("date"))
