"""Filters over nested records, items and fields of cases, reconciliation of mailboxes, and health of jobs."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions import text as X

# predicates


def glob_like(x: Column, pattern: str) -> Column:
    """Whether a text, in lower case, matches a GLOB pattern: * for any run, ? for one character, [...] for a set."""
    out = "".join({"*": ".*", "?": "."}.get(c, c if c in "[]-^" else re.escape(c)) for c in pattern.lower())
    return F.coalesce(F.lower(x).rlike(f"(?s)^{out}$"), F.lit(False))


def lacks(document: Column, word: str) -> Column:
    """JSON text that does not mention a word; null lacks it, too."""
    return ~F.contains(F.lower(F.coalesce(document, F.lit(""))), F.lit(word.lower()))


def where_all(wanted: dict[str, object], rules: dict[str, object]) -> Column:
    """The conjunction of the rules whose parameter is given: rules are functions of the parameter; None and "" are not given."""
    used = [rules[k](v) for k, v in wanted.items() if k in rules and v not in (None, "", [])]
    return reduce(lambda a, b: a & b, used, F.lit(True))


def equals_or_any(x: Column, wanted: str) -> Column:
    """A facet: the value itself, or everything for "all"; "none" is an empty value."""
    return F.lit(True) if wanted in ("", "all") else (F.coalesce(x, F.lit("")) == ("" if wanted == "none" else wanted))


def facet_values(rows: DataFrame, **columns: Column) -> DataFrame:
    """(facet, value, n): the distinct values of each named column with their counts, arrays by element, empty ones left out."""
    none = F.array().cast("array<string>")

    def tagged(name: str, column: Column) -> Column:
        several = rows.select(column.alias("x")).schema["x"].dataType.typeName() == "array"
        values = F.coalesce((column if several else F.array(column)).cast("array<string>"), none)
        return F.transform(values, lambda v: F.struct(F.lit(name).alias("facet"), v.alias("value")))

    named = F.flatten(F.array(*[tagged(k, c) for k, c in columns.items()]))
    return rows.select(F.inline(named)).where("value <> ''").groupBy("facet", "value").agg(F.count("*").alias("n"))


def ordered_by(rows: DataFrame, name: str, sorts: dict[str, Sequence[Column]], fallback: str) -> DataFrame:
    """``rows`` in one of the named orders; an unknown name takes the fallback."""
    return rows.orderBy(*sorts.get(name, sorts[fallback]))


def over_fetched(rows: DataFrame, order: Sequence[Column], size: int, keep: Column, factor: int = 4) -> DataFrame:
    """The first ``size`` rows that pass a costly test, of the first ``factor * size`` in order; fewer if those do not hold enough."""
    return rows.orderBy(*order).limit(size * factor).where(keep).orderBy(*order).limit(size)


def resolved(wanted: DataFrame, tiers: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """(id, entity, target) of each wanted id (a text): the first tier, in order, that knows it; tiers have (key, target)."""
    found = [t.select(F.col("key").cast("string").alias("id"), F.lit(k).alias("tier"), F.lit(name).alias("entity"), F.col("target").cast("string").alias("target")) for k, (name, t) in enumerate(tiers)]
    known = wanted.select(F.trim("id").alias("id")).distinct().join(reduce(DataFrame.unionByName, found), "id")
    return known.groupBy("id").agg(F.min(F.struct("tier", "target", "entity")).alias("m")).select("id", "m.entity", "m.target")


# items and fields


def distinct_items(items: Column, keys: Sequence[str]) -> Column:
    """The items of an array without later ones that equal an earlier one in all of ``keys`` (case and spaces ignored)."""
    key = lambda x: F.concat_ws("\u0001", *[X.identifier(F.coalesce(x[k].cast("string"), F.lit(""))) for k in keys])
    return F.filter(items, lambda x, i: ~F.exists(F.slice(items, 1, i), lambda y: key(y) == key(x)))


def first_filled(*records: Column) -> Column:
    """map<string,string> of several: each key from the first map whose value for it is not empty."""
    none = F.expr("cast(map() as map<string,string>)")
    some = [F.map_filter(F.coalesce(r, none), lambda _, v: F.length(F.trim(F.coalesce(v, F.lit("")))) > 0) for r in records]
    return reduce(lambda out, more: F.map_zip_with(out, more, lambda _, a, b: F.coalesce(a, b)), some)


def inherited(child: Column, parent: Column, fields: Sequence[str]) -> Column:
    """struct(fields, taken): the child's map with the parent's values for the listed fields that it lacks, and which those are."""
    full = first_filled(child, F.map_filter(F.coalesce(parent, F.expr("cast(map() as map<string,string>)")), lambda k, _: k.isin(*fields)))
    taken = F.array_sort(F.array_except(F.map_keys(full), F.map_keys(first_filled(child))))
    return F.struct(full.alias("fields"), taken.alias("taken"))


def ordered_distinct(*lists: Column) -> Column:
    """The distinct elements of several arrays, in order, without nulls and empty texts."""
    none = F.array().cast("array<string>")
    return F.filter(F.array_distinct(F.concat(*[F.coalesce(x, none) for x in lists])), lambda x: F.length(x) > 0)


def multi_item(items: Column) -> Column:
    """struct(n, multi, strategy) of a case's items."""
    n = F.greatest(F.size(F.coalesce(items, F.array())), F.lit(0))
    return F.struct(n.alias("n"), (n > 1).alias("multi"), F.when(n > 1, "pending").alias("strategy"))


def first_item(items: Column, field: str) -> Column:
    """A field of the first item; null without items."""
    return F.get(items, F.lit(0))[field]


def accepted_draft(draft: Column, statuses: Column, good: str = "confirmed") -> Column:
    """The draft's fields whose status confirms them; others are left for an operator."""
    return F.map_filter(draft, lambda k, _: F.coalesce(F.try_element_at(statuses, k).startswith(good), F.lit(False)))


def link_kinds(links: Column, portals: Sequence[str], noise: Sequence[str]) -> Column:
    """array<struct<link, kind>>: portal, file or page of each link, noise left out."""
    low = lambda x: F.lower(x)
    any_ = lambda x, words: reduce(lambda a, w: a | low(x).contains(w.lower()), words, F.lit(False))
    kind = lambda x: F.when(any_(x, portals), "portal").when(low(x).rlike(r"\.(pdf|xlsx?|docx?|zip|jpe?g|png)([?#]|$)"), "file").otherwise("page")
    return F.transform(F.filter(links, lambda x: ~any_(x, noise)), lambda x: F.struct(x.alias("link"), kind(x).alias("kind")))


def fresh(received: Column, now: Column, days: int = 2) -> Column:
    """Whether links of a mail may still open; without a date they may."""
    return F.coalesce(received >= now - F.make_dt_interval(days=F.lit(days)), F.lit(True))


def json_hits(document: Column, wanted: str, fields: dict[str, int], other: int = 30) -> Column:
    """struct(score, field): the best match of a text in JSON at any depth; 40 points more for an equal value; null without one.

    ``fields`` has the points of known keys. Arbitrary depth is the part that Spark has no function for.
    """
    low = wanted.lower()

    @F.pandas_udf("score long, field string")
    def found(texts: pd.Series) -> pd.DataFrame:
        def walk(value, key):
            if isinstance(value, dict):
                for k, v in value.items():
                    yield from walk(v, k)
            elif isinstance(value, list):
                for v in value:
                    yield from walk(v, key)
            elif value is not None and low in str(value).lower():
                yield fields.get(key, other) + 40 * (str(value).lower() == low), key

        def best(t):
            try:
                return max(walk(json.loads(t), ""), default=(None, None), key=lambda x: (x[0], x[1]))
            except (TypeError, ValueError):
                return None, None

        return pd.DataFrame([best(t) for t in texts], columns=["score", "field"]).astype({"score": "Int64"})

    return found(document)


#: Words that no field of a case holds, and labels that are no values.
JUNK = ["http", "www.", "cid:", "mailto", "font-", "style="]
LABELS = ["артикул", "номер", "дата", "количество", "документ", "наименование", "производитель"]


def bad_value(value: Column, field: str) -> Column:
    """Whether a value is no value of its field: markup, a label, a date as number, a telephone number as part, letters as quantity."""
    v = X.clean_ws(value)
    low = F.lower(v)
    own = {
        "document_number": v.rlike(r"^\d{1,2}[./-]\d{1,2}[./-]\d{2,4}$") | ~v.rlike(r"\d"),
        "part_number": v.contains("@") | v.rlike(r"^\+\d[\d\s().-]{8,}$") | v.rlike(r"^\d{1,2}[./-]\d{1,2}[./-]\d{2,4}$"),
        "quantity": ~v.rlike(r"^\d{1,4}([.,]\d+)?(\s*(шт|ед)\.?)?$"),
        "document_date": ~v.rlike(r"\d{4}|\d{1,2}[./-]\d{1,2}[./-]\d{2}"),
        "claim_number": ~v.rlike(r"\d"), "return_number": ~v.rlike(r"\d"), "client_request_number": ~v.rlike(r"\d"),
    }
    general = low.rlike("|".join(map(re.escape, JUNK))) | low.isin(*LABELS) | (F.length(v) > 120) | v.rlike(r"^[\W_]*$")
    return (F.length(v) > 0) & (general | own.get(field, F.lit(False)))


def sane(fields: dict[str, Column]) -> Column:
    """struct(cleaned, removed): the map of fields without bad values, and the names of those taken out."""
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), F.when(~bad_value(v, k), v).alias("value")) for k, v in fields.items()])
    removed = F.array_compact(F.array(*[F.when(bad_value(v, k), k) for k, v in fields.items()]))
    return F.struct(F.map_from_entries(F.filter(pairs, lambda p: F.length(F.trim(p["value"])) > 0)).alias("cleaned"), removed.alias("removed"))


# mailboxes


def reconciled(server: DataFrame, local: DataFrame, failures: DataFrame) -> DataFrame:
    """(side, folder, uid, status, reason) of every uid of the server and every local mail.

    ``server`` (folder, uid, message_id); ``local`` (folder, uid, message_id, duplicate_of); ``failures`` (folder, uid,
    failure). Message ids are compared without case. Keys are (folder, uid) and message ids, both reduced to one row each.
    """
    tidy = lambda c: F.nullif(F.lower(F.trim(c)), F.lit(""))
    s = server.select(F.col("folder"), F.col("uid").cast("string").alias("uid"), tidy(F.col("message_id")).alias("mid"))
    l = local.select(F.col("folder"), F.nullif(F.trim(F.col("uid").cast("string")), F.lit("")).alias("uid"), tidy(F.col("message_id")).alias("mid"), "duplicate_of")
    f = failures.select("folder", F.col("uid").cast("string").alias("uid"), "failure").groupBy("folder", "uid").agg(F.max("failure").alias("failure"))
    mine = l.where("uid is not null").groupBy("folder", "uid").agg(F.max(F.struct("mid", "duplicate_of")).alias("m")).select("folder", "uid", F.col("m.mid").alias("local_mid"), F.col("m.duplicate_of").alias("duplicate_of"), F.lit(True).alias("here"))
    known = l.where("mid is not null").select("mid").distinct().withColumn("known", F.lit(True))
    a = s.join(mine, ["folder", "uid"], "left").join(f, ["folder", "uid"], "left").join(known, "mid", "left")
    rules = [
        (F.col("here") & (F.col("mid") != F.col("local_mid")), "unknown", "uid_reused_suspected_message_id_mismatch"),
        (F.col("here") & F.col("duplicate_of").isNotNull(), "imported_duplicate_linked", "linked_to_original"),
        (F.col("here"), "imported_raw", "exact_folder_and_uid"),
        (F.col("failure").isin("skipped", "ignored"), "skipped_before_start", "recorded_import_skip"),
        (F.col("failure").isNotNull(), "fetch_failed", "recorded_import_failure"),
        (F.col("known"), "exact_duplicate_known", "same_message_id_elsewhere"),
    ]
    from postmill.plans.routing import decide

    verdict = decide(rules, ("missing_local", "no_local_mail_or_failure"))
    on_server = a.select(F.lit("server").alias("side"), "folder", "uid", verdict["value"].alias("status"), verdict["reason"].alias("reason"))
    there = s.groupBy("folder", "uid").agg(F.max("mid").alias("server_mid"), F.lit(True).alias("there"))
    theirs = s.where("mid is not null").select("mid").distinct().withColumn("known", F.lit(True))
    folders = s.select("folder").distinct().withColumn("scanned", F.lit(True))
    b = l.join(there, ["folder", "uid"], "left").join(theirs, "mid", "left").join(F.broadcast(folders), "folder", "left")  # a mailbox has few folders
    rules = [
        (F.col("uid").isNull(), "no_uid", "never_numbered"),
        (F.col("there") & (F.col("mid") != F.col("server_mid")), "uid_reused_suspected", "message_id_mismatch"),
        (F.col("there"), "exists_on_server", "exact_folder_and_uid"),
        (F.col("known"), "folder_mismatch", "message_id_in_other_folder"),
        (F.col("scanned").isNull(), "folder_mismatch", "folder_not_scanned"),
    ]
    verdict = decide(rules, ("deleted_or_moved_on_server", "not_on_server"))
    return on_server.unionByName(b.select(F.lit("local").alias("side"), "folder", "uid", verdict["value"].alias("status"), verdict["reason"].alias("reason")))


def leaf_folders(folders: DataFrame, name: str, separator: str = "/") -> DataFrame:
    """The folders that are no parent of another one, by an equi-join of names with the parents of all names."""
    parts = F.split(F.col(name), re.escape(separator))
    above = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), separator)))
    parents = folders.where(F.size(parts) > 1).select(above.alias("_parent")).distinct()
    return folders.join(parents, F.col(name) == F.col("_parent"), "left_anti")


def window_split(rows: DataFrame, at: Column, start: Column) -> DataFrame:
    """``rows`` with kept: not before ``start``; rows without a date are kept, and all are without a start."""
    return rows.withColumn("kept", F.coalesce(at >= start, F.lit(True)))


def job_health(jobs: DataFrame, now: Column, hang: int = 120, abandon: int = 600) -> DataFrame:
    """``jobs`` (status, last_heartbeat_at) with possible_hang, and status abandoned after ``abandon`` seconds without a heartbeat, to the microsecond."""
    age = (F.unix_micros(now) - F.unix_micros("last_heartbeat_at")) / 1_000_000
    running = F.col("status") == "running"
    return jobs.withColumns({"possible_hang": F.coalesce(running & (age > hang), F.lit(False)), "status": F.when(running & (age > abandon), "abandoned").otherwise(F.col("status"))})


def approved(outbox: DataFrame, chosen: DataFrame | None, key: str = "event_key") -> DataFrame:
    """The outbox with drafts turned into new: those of ``chosen`` (one key a row), or all of them."""
    draft = F.col("status") == "draft"
    if chosen is None:
        return outbox.withColumn("status", F.when(draft, "new").otherwise(F.col("status")))
    rows = outbox.join(chosen.select(key).distinct().withColumn("_chosen", F.lit(True)), key, "left")
    return rows.withColumn("status", F.when(draft & F.col("_chosen"), "new").otherwise(F.col("status"))).drop("_chosen")


def corrected(cases: DataFrame, corrections: DataFrame, key: str, fields: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(cases, events): cases with an operator's corrections (key, ts, field, value; the latest counts), and a learning event for each value changed."""
    last = corrections.where(F.col("field").isin(*fields)).groupBy(key, "field").agg(F.max_by("value", F.struct("ts", "value")).alias("value"))
    wide = last.groupBy(key).pivot("field", list(fields)).agg(F.first("value"))
    joined = cases.alias("c").join(wide.alias("n"), key, "left")
    new = [F.coalesce(f"n.{c}", f"c.{c}").alias(c) if c in fields else F.col(key) if c == key else F.col(f"c.{c}") for c in cases.columns]
    changes = F.array_compact(F.array(*[F.when(F.col(f"n.{f}").isNotNull() & ~F.col(f"n.{f}").eqNullSafe(F.col(f"c.{f}")), F.struct(F.lit(f).alias("field"), F.col(f"c.{f}").alias("old"), F.col(f"n.{f}").alias("new"))) for f in fields]))
    return joined.select(*new), joined.select(key, F.inline(changes))


def without_junk(attachments: DataFrame, cases: DataFrame, junk: Sequence[str]) -> DataFrame:
    """Attachments but those of mails all of whose cases are junk events; mails without a case keep theirs."""
    useful = cases.groupBy("mail_id").agg(F.bool_and(F.col("event_type").isin(*junk)).alias("junk")).where("junk").select("mail_id")
    return attachments.join(useful, "mail_id", "left_anti")
