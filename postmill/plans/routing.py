"""Every mail in exactly one bucket, folder and route, with a check that nothing is left over.

The rules are ordered decision lists over named conditions; each list is one ``when`` chain with a reason beside it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions.text import contains_any, phrase_score

#: Phrases of kinds of claim, by kind, as data that may be exchanged.
KIND_PHRASES = {
    "shortage": ["недостача", "недовоз", "недопоставка", "не хватает", "shortage", "missing items"],
    "defect": ["брак", "дефект", "неисправ", "не работает", "defect", "faulty"],
    "damage": ["поврежд", "бой", "разбит", "мятая упаковка", "damaged", "broken"],
    "wrong_item": ["пересорт", "не тот товар", "не соответствует заказу", "wrong item", "mismatch"],
    "surplus": ["излиш", "лишний товар", "surplus", "too many"],
}
#: Buckets of mail, in order of decision.
BUCKETS = ["duplicate", "report", "no_case", "follow_up", "refusal", "ready", "needs_link", "needs_ai", "needs_review", "exported", "error", "other"]
#: Phrases of the inbox sorter, by bucket, in order of decision.
INBOX_RULES = [
    ("delivery_failure", ["mailer-daemon", "undelivered", "не доставлено"]),
    ("auto_reply", ["автоответ", "auto-reply", "out of office"]),
    ("report", ["отчет", "отчёт", "ежедневная сводка", "daily report"]),
    ("reconciliation", ["акт сверки", "reconciliation"]),
    ("invoice", ["счет на оплату", "счёт на оплату", "invoice"]),
    ("price_list", ["прайс", "price list"]),
    ("refusal", ["отказ от поставки", "отмена заказа", "cancel order"]),
    ("reminder", ["напоминаем", "повторно", "reminder"]),
    ("return", ["возврат", "претензия", "рекламация", "return request", "claim"]),
]


def decide(rules: Sequence[tuple[Column, str, str]], otherwise: tuple[str, str]) -> Column:
    """struct(value, reason) of the first rule that holds; a rule whose condition is null does not hold."""
    pair = lambda v, r: F.struct(F.lit(v).alias("value"), F.lit(r).alias("reason"))
    out = None
    for condition, value, reason in rules:
        out = F.when(condition, pair(value, reason)) if out is None else out.when(condition, pair(value, reason))
    return out.otherwise(pair(*otherwise))


def kind_vote(text: Column, phrases: dict[str, list[str]] = KIND_PHRASES, scores: Mapping[str, Column] | None = None) -> Column:
    """The kind with most phrases in the text; in a tie defect comes last and then the name decides; null without any. ``scores``: of the kinds, if they are known."""
    votes = F.array(*[F.struct((-(phrase_score(text, words) if scores is None else scores[kind])).alias("less"), F.lit(int(kind == "defect")).alias("last"), F.lit(kind).alias("kind")) for kind, words in phrases.items()])
    best = F.array_min(votes)
    return F.when(best["less"] < 0, best["kind"])


def inbox_bucket(subject: Column, body: Column) -> Column:
    """struct(value, reason): the first rule with a phrase in the subject, else in the body, else other."""
    rules = [(contains_any(subject, words), bucket, "subject") for bucket, words in INBOX_RULES]
    rules += [(contains_any(body, words), bucket, "body") for bucket, words in INBOX_RULES]
    return decide(rules, ("other", "no_rule"))


def top_bucket(is_duplicate: Column, is_report: Column, has_case: Column, event_type: Column, state: Column, needs_link: Column, needs_ai: Column, outbox_status: Column) -> Column:
    """struct(value, reason): the one bucket of a mail and its case."""
    return decide(
        [
            (is_duplicate, "duplicate", "linked_to_original"),
            (is_report, "report", "report_mail"),
            (~has_case, "no_case", "not_classified"),
            (event_type.isin("reminder", "supplier_decision", "follow_up"), "follow_up", "event_type"),
            (event_type == "pre_delivery_refusal", "refusal", "event_type"),
            (outbox_status == "error", "error", "outbox"),
            (outbox_status.isin("sent", "delivered"), "exported", "outbox"),
            (state == "ready", "ready", "state"),
            (needs_link, "needs_link", "quarantine"),
            (needs_ai, "needs_ai", "flag"),
            (state == "needs_review", "needs_review", "state"),
        ],
        ("other", "no_rule"),
    )


#: The route of each bucket.
ROUTE_OF = {"duplicate": "hidden", "report": "hidden", "no_case": "technical", "follow_up": "linked", "refusal": "export", "ready": "export", "exported": "export", "needs_link": "review", "needs_ai": "review", "needs_review": "review", "error": "technical", "other": "technical"}


def route(bucket: Column) -> Column:
    out = None
    for name, value in ROUTE_OF.items():
        out = F.when(bucket == name, value) if out is None else out.when(bucket == name, value)
    return out.otherwise("technical")


def rollup(rows: DataFrame, outer: str, inner: str) -> DataFrame:
    """Counts by outer and inner key, by outer key, and of all rows, with the level (0: all, 1: outer, 2: both)."""
    g = rows.rollup(outer, inner).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    return g.select(outer, inner, "n", F.when(F.col("g") == 3, 0).when(F.col("g") == 1, 1).otherwise(2).alias("level"))


def completeness(rows: DataFrame, bucket: str, known: Sequence[str]) -> DataFrame:
    """One row: all rows, those in a known bucket, and the difference, which must be 0."""
    counted = rows.agg(F.count("*").alias("total"), F.count_if(F.col(bucket).isin(*known)).alias("counted"))
    return counted.withColumn("unaccounted", F.col("total") - F.col("counted"))


def evidence_gate(statuses: Column, required: Sequence[str]) -> Column:
    """struct(passed, blocking, strength) from a map field -> status (found, weak, missing, conflict).

    A required field that is missing or in conflict blocks; strength is strong if all required are found.
    """
    status = lambda k: F.coalesce(F.try_element_at(statuses, F.lit(k)), F.lit("missing"))
    blocking = F.array_compact(F.array(*[F.when(status(k).isin("missing", "conflict"), F.concat_ws(":", F.lit(k), status(k))) for k in required]))
    found = sum(((status(k) == "found").cast("int") for k in required), F.lit(0))
    strength = F.when(found == len(required), "strong").when(found * 2 >= len(required), "medium").when(found > 0, "weak").otherwise("none")
    return F.struct((F.size(blocking) == 0).alias("passed"), blocking.alias("blocking"), strength.alias("strength"))


def strong_key(buyer: Column, claim_number: Column, document: Column, part: Column) -> Column:
    """The key of a case: buyer and claim number, else document and part, else document; null without a buyer."""
    some = lambda x: F.nullif(F.lower(F.trim(x)), F.lit(""))
    rest = F.coalesce(F.concat(F.lit("claim:"), some(claim_number)), F.concat(F.lit("doc:"), some(document), F.lit("|part:"), some(part)), F.concat(F.lit("doc:"), some(document)))
    return F.when(some(buyer).isNotNull() & rest.isNotNull(), F.concat(some(buyer), F.lit("|"), rest))


def thread_key(strong: Column, references: Column, in_reply_to: Column, template: Column) -> Column:
    """The strong key, else the first reference, else the mail replied to, else a hash of the subject template."""
    return F.coalesce(strong, F.try_element_at(references, F.lit(1)), F.nullif(F.trim(in_reply_to), F.lit("")), F.concat(F.lit("subject:"), F.substring(F.sha1(template), 1, 16)))


def direction(from_domain: Column, to_domain: Column, own: Sequence[str], folder: Column, subject: Column) -> Column:
    """struct(value, reason): outgoing, internal, forwarded, incoming."""
    mine = lambda d: F.coalesce(sum(((d == o) | d.endswith("." + o)).cast("int") for o in own) > 0, F.lit(False))
    return decide(
        [
            (F.lower(folder).rlike("sent|отправлен"), "outgoing", "folder"),
            (mine(from_domain) & mine(to_domain), "internal", "both_own"),
            (mine(from_domain) & F.lower(subject).rlike(r"^\s*(fw|fwd|пер)\s*:"), "forwarded", "subject"),
            (mine(from_domain), "outgoing", "from_own"),
            (mine(to_domain), "incoming", "to_own"),
        ],
        ("incoming", "default"),
    )
