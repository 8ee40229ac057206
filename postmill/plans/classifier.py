"""From a letter to a case: fields by spans, kind, event, keys, deadline, what is missing, state and confidence in one chain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions import dates as D
from postmill.functions import text as X
from postmill.operators import records as O
from postmill.operators import spans as S
from postmill.operators.spans import BAD, BLOCK, GUESS, LABEL, Extractor
from postmill.plans import casework as K
from postmill.plans import routing as R
from postmill.plans.relational import read

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


FIELDS = ["document_number", "document_date", "part_number", "quantity", "price", "claim_number", "client_request_number"]
_DAY = r"(?:\d{1,2}[./-]\d{1,2}[./-]\d{4}|\d{4}-\d{2}-\d{2}|\d{1,2}[./-]\d{1,2}[./-]\d{2})"
_W, _X = "[а-яё]*", "[0-9a-zа-яё]"
_PAPER = rf"(?:(?:счет|счёт)[- ]фактур{_W}|упд|с/ф|торг-12|накладн{_W}|реализаци{_W}|документ{_W})"
_PAPERS = ("фактур", "упд", "с/ф", "торг-12", "накладн", "реализаци", "документ")
#: Labels before guesses; dates, prices, telephone numbers, links and addresses keep their digits from other fields.
EXTRACTORS = [
    Extractor("document_number", LABEL, rf"{_PAPER}\s*(?:№|n|номер)?\s*[:#]?\s*([0-9](?:{_X}|[/_-]){{1,38}}{_X})", 100, small=True, needs=_PAPERS),
    Extractor("document_number", GUESS, r"№\s*([0-9][0-9-]{3,20})", 50, needs=("№",)),
    Extractor("document_number", BAD, rf"(?:заявк|заказ|тикет|обращени|телефон|трек){_W}|reclam[a-z]*|инн|кпп", 0, 0, small=True, needs=("заявк", "заказ", "тикет", "обращени", "телефон", "трек", "reclam", "инн", "кпп")),
    Extractor("document_date", LABEL, rf"{_PAPER}[^\n.]{{0,60}}?\s+от\s+({_DAY})", 110, small=True, needs=_PAPERS),
    Extractor("document_date", GUESS, rf"({_DAY})", 90),
    Extractor("part_number", LABEL, r"(?:артикул(?:\s+заказа)?|код товара)\s*[:#№.| —-]+\*?\s*([0-9a-z][0-9a-z._/-]{1,49}[0-9a-z])", 100, small=True, needs=("артикул", "код товара")),
    Extractor("part_number", GUESS, r"([A-Z]{1,4}-?[0-9][0-9A-Z-]{2,20})", 40),
    Extractor("part_number", BAD, rf"маркировк{_W}|честн{_W}\s+знак{_W}", 0, 0, small=True, needs=("маркировк", "честн")),
    Extractor("quantity", LABEL, r"(?:кол[- ]?во|количество)\s*[:=| ]+(\d{1,5})", 100, small=True, needs=("кол",)),
    Extractor("quantity", GUESS, r"(\d{1,4})\s*(?:шт|ед)", 45, leading=True, small=True, needs=("шт", "ед")),
    Extractor("price", GUESS, r"(\d{1,7}[.,]\d{2})\s*(?:руб|₽)", 80, leading=True, small=True, needs=("руб", "₽")),
    Extractor("claim_number", LABEL, rf"(?:претензи|рекламаци){_W}\s*№\s*({_X}(?:{_X}|[/-]){{3,39}})", 105, small=True, needs=("претензи", "рекламаци")),
    Extractor("client_request_number", LABEL, rf"заявк{_W}(?:\s+клиента)?\s*№\s*({_X}(?:{_X}|[/-]){{3,39}})", 105, small=True, needs=("заявк",)),
    Extractor("telephone", BLOCK, r"(?:\+7|8)[ (-]*\d{3}[ )-]*\d{3}[ -]?\d{2}[ -]?\d{2}", 120, 0),
    Extractor("link", BLOCK, r"https?://[^\s<>\"]+", 130, 0, small=True, needs=("://",)),
    Extractor("address", BLOCK, r"[0-9A-Za-z][0-9A-Za-z._+-]{0,63}@[0-9A-Za-z-]+(?:\.[0-9A-Za-z-]+)+", 125, 0, needs=("@",)),
]
SERVICE_STATES = {"followup_reminder": "needs_link", "followup_dialog": "needs_link", "ready_to_ship": "needs_link", "shortage_link_event": "needs_link", "problem_notice": "problem_notice", "outbound": "context_sent", "internal": "ignored_internal", "info_only": "ignored_info_only", "supplier_report": "ignored_info_only", "spam_promo": "ignored_spam_promo"}


def split_document_cell(cell: Column) -> Column:
    """struct(number, date) of a cell such as "№ 81407 от 15.05.2026"; null where it holds none."""
    part = lambda pattern: F.nullif(F.regexp_extract(F.coalesce(cell, F.lit("")), pattern, 1), F.lit(""))
    return F.struct(part(r"(?iu)№?\s*([0-9][0-9a-zа-я_/-]{2,})(?![0-9a-zа-яё])").alias("number"), part(r"(\d{1,2}[./-]\d{1,2}[./-]\d{2,4}|\d{4}-\d{2}-\d{2})").alias("date"))


def link_only(text: Column, kind: Column, links: Column, portals: Sequence[str]) -> Column:
    """A shortage that names nothing but a link to a trusted portal: (host and path) prefixes, www. or not."""
    trusted = "|".join(p.replace(".", r"\.").rstrip("/") for p in portals)
    said = (kind == "shortage") | X.contains_any(text, ["недопостав"])
    return F.coalesce(said, F.lit(False)) & F.exists(links, lambda x: x.rlike(rf"(?i)^https?://(www\.)?({trusted})(/|$)"))


def strong_key(buyer: Column, values: dict[str, Column]) -> Column:
    """The key that links a case: a claim or request number, a document with its part, or a document, of a known buyer; else null."""
    have = lambda f: (F.length(F.coalesce(values[f], F.lit(""))) > 0) & ~O.bad_value(values[f], f)
    known = F.length(F.coalesce(buyer, F.lit(""))) > 0
    doc, part = values["document_number"], values["part_number"]
    out = F.when(~known, F.lit(None).cast("string"))
    for f in ("claim_number", "client_request_number"):
        out = out.when(have(f), F.concat_ws(":", F.lit(f), buyer, F.lower(values[f])))
    both = have("document_number") & have("part_number")
    return out.when(both, F.concat_ws(":", F.lit("doc_part"), buyer, F.lower(doc), F.lower(part))).when(have("document_number"), F.concat_ws(":", F.lit("document"), buyer, F.lower(doc)))


def thread_key(key: Column, references: Column, reply_to: Column, buyer: Column, subject: Column) -> Column:
    """The strong key, the first reference, what it answers, or a hash of buyer and subject template."""
    weak = F.concat_ws(":", F.lit("subject"), F.coalesce(buyer, F.lit("unknown")), X.subject_template(subject))
    return F.when(key.isNotNull(), F.concat(F.lit("strong:"), key)).when(F.size(references) > 0, F.concat(F.lit("message:"), F.get(references, F.lit(0)))).when(F.length(reply_to) > 0, F.concat(F.lit("message:"), reply_to)).otherwise(X.stable_hash(weak, "weak_thread"))


#: Lists of phrases beside those of the rules in casework.
SAID = {"urgent": ["срочно", "повторно", "крайний срок", "просроч", "горит"], "nondelivery": ["недопостав"], "act": ["мнение комисси", "тип возврата", "комментарий"], "link": ["http"]}


def classify(letters: DataFrame, now: Column, portals: Sequence[str], extractors: Sequence[Extractor] = EXTRACTORS, kinds: dict[str, list[str]] = R.KIND_PHRASES) -> DataFrame:
    """One row a letter: id, FIELDS, event, kind, keys, deadline, priority, missing, problems, state, confidence, needs_ai, ready.

    ``letters`` has id, subject, text, direction, buyer, buyer_score, first (no earlier letter of the thread), references,
    reply_to, names (of attachments), received. Ids are distinct; a null text or subject is empty, a null list has no
    elements, a null score is 0. Texts are read once, where they lie, and nothing is shuffled or joined.
    """
    full = F.concat_ws("\n", F.coalesce("subject", F.lit("")), F.coalesce("text", F.lit("")))
    lists = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    texts = S.held(letters.withColumn("full", full), "full")
    lists_of = {f"says_{k}": words for k, words in (K.WORDS | SAID).items()} | {f"kind_{k}": words for k, words in kinds.items()}
    read = texts.withColumns({"_read": S.fields_of(F.col("full"), extractors, FIELDS), "_said": X.phrase_scores(F.col("full"), lists_of)})
    scores = {k: F.col(f"_said.kind_{k}") for k in kinds}
    said = {k: F.col(f"_said.says_{k}") > 0 for k in [*K.WORDS, *SAID]}
    c = read.select(
        "id", "direction", "buyer", F.coalesce("buyer_score", F.lit(0.0)).alias("buyer_score"), F.coalesce("first", F.lit(True)).alias("first"), lists(F.col("references")).alias("references"), F.coalesce("reply_to", F.lit("")).alias("reply_to"),
        lists(F.col("names")).alias("names"), "received", F.coalesce("subject", F.lit("")).alias("subject"), "_said", R.kind_vote(F.col("full"), kinds, scores).alias("voted"), F.array_max(F.array(*scores.values())).alias("votes"),
        F.when(said["act"], K.kind_from_act(F.col("full"))).alias("act"), F.when(said["link"], F.array_distinct(F.regexp_extract_all("full", F.lit(r"(?i)https?://[^\s<>\"]+"), F.lit(0)))).otherwise(F.array().cast("array<string>")).alias("links"),
        *[F.col(f"_read.{f}.value").alias(f) for f in FIELDS], F.col("_read.document_date.n").alias("dates"), F.col("_read.document_date.labelled").alias("labelled"),
    )
    checked = [f for f in FIELDS if f != "price"]
    c = c.withColumns({f"_{f}": F.when(F.col(f).isNotNull(), O.bad_value(F.col(f), f)) for f in checked})
    bad = F.array_compact(F.array(*[F.when(F.col(f"_{f}"), F.lit(f"{f}_bad")) for f in checked]))
    c = c.withColumn("problems", bad).withColumns({f: F.when(~F.col(f"_{f}"), F.col(f)) for f in checked}).drop(*[f"_{f}" for f in checked])
    c = S.held(c, "problems", *checked)
    kind = F.coalesce("act", "voted")
    c = c.withColumn("kind", kind).withColumn("kind_score", F.when(F.col("act").isNotNull(), 0.9).when(F.col("votes") > 0, F.least(F.lit(0.85), 0.45 + 0.12 * F.col("votes"))).otherwise(0.0))
    request = F.coalesce("claim_number", "client_request_number")
    reply = (F.size("references") > 0) | (F.length("reply_to") > 0)
    event = K.event_type(F.lit(""), F.col("subject"), reply, F.col("first"), F.col("direction"), F.col("kind"), F.col("part_number"), F.col("document_number"), request, said=said)["value"]
    c = S.held(c.withColumn("event0", event).withColumn("request", request), "event0", "request", "kind", "kind_score")
    c = c.withColumn("pre_delivery", K.pre_delivery_refusal(F.lit(""), F.col("event0"), F.col("document_number"), said=said))
    c = c.withColumn("link_only", link_only(F.when(said["nondelivery"], SAID["nondelivery"][0]), F.col("kind"), F.col("links"), portals))
    c = c.withColumn("event", F.when(F.col("link_only"), "shortage_link_event").when(F.col("pre_delivery"), "pre_delivery_refusal").otherwise(F.col("event0")))
    c = c.withColumn("strong_key", strong_key(F.col("buyer"), {f: F.col(f) for f in FIELDS}))
    c = S.held(c, "event", "pre_delivery", "link_only", "strong_key")
    c = c.withColumn("thread_key", thread_key(F.col("strong_key"), F.col("references"), F.col("reply_to"), F.col("buyer"), F.col("subject")))
    proof = K.evidence_summary(F.col("names"), F.col("links"))
    c = S.held(c.withColumns({k: proof[k] for k in ("has_photo", "has_service_document")}), "has_photo", "has_service_document")
    c = c.withColumn("missing", K.quality_missing(F.col("event"), F.col("kind"), F.col("direction"), F.col("buyer"), F.col("strong_key"), F.col("document_number"), F.col("request"), F.col("part_number"), F.col("pre_delivery"), F.col("link_only"), {k: F.col(k) for k in ("has_photo", "has_service_document")}))
    c = S.held(c, "missing")
    # several dates of which none stands with the document: perhaps another date
    loose = (F.col("event") == "new_return") & F.col("document_number").isNotNull() & F.col("document_date").isNotNull() & (F.coalesce("dates", F.lit(0)) >= 2)
    c = c.withColumn("problems", F.concat("problems", F.array_compact(F.array(F.when(loose & ~F.col("labelled"), "date_not_anchored")))))
    has = lambda f: F.col(f).isNotNull()
    least = F.when(F.col("link_only"), has("buyer") & (F.col("kind") == "shortage")).when(F.col("pre_delivery"), has("request") & has("part_number")).otherwise(has("document_number") & has("document_date") & has("part_number") & has("kind"))
    c = c.withColumn("has_min", F.coalesce(least, F.lit(False))).withColumn("exportable", F.col("event").isin(*K.RETURN_EVENTS))
    follow = F.col("event").isin("followup_reminder", "followup_dialog", "supplier_decision")
    sound = F.size("problems") == 0
    trust = F.least(F.lit(1.0), 0.1 + 0.35 * F.col("buyer_score") + 0.35 * F.col("kind_score") + F.when(has("strong_key"), 0.2).otherwise(0.0))
    trust = F.when(follow & reply, F.greatest(trust, F.lit(0.75))).when(F.col("event").isin("internal", "outbound"), F.greatest(trust, F.lit(0.85))).when(F.col("exportable") & F.col("has_min") & has("buyer") & has("strong_key") & sound, F.greatest(trust, F.lit(0.82))).otherwise(trust)
    c = S.held(c.withColumn("confidence", F.round(trust, 3)), "confidence", "has_min", "exportable", "problems")
    c = c.withColumn("needs_ai", F.col("exportable") & ((F.col("confidence") < 0.8) | ~F.col("has_min") | F.col("buyer").isNull()))
    c = c.withColumn("ready", F.col("exportable") & (F.size("missing") == 0) & sound & (F.col("direction") == "inbound_customer") & F.col("has_min") & ~F.col("needs_ai"))
    linked = has("strong_key") | (F.size("references") > 0)
    late = F.when(F.col("event").isin("supplier_decision", "correction_request", "marking_request", "number_replacement"), F.when(linked, "linked_event").otherwise("needs_link"))
    late = late.when(F.col("event").isin("followup_reminder", "followup_dialog", "ready_to_ship"), F.when(has("strong_key"), "linked_event").otherwise("needs_link"))
    state = late.when(F.col("ready"), "ready_to_1c")
    for name, value in SERVICE_STATES.items():
        state = state.when(F.col("event") == name, value)
    deadline = D.deadline(F.col("kind"), F.col("event"), F.col("received"), now)
    c = c.withColumn("state", state.otherwise("needs_review")).withColumn("deadline", deadline)
    c = c.withColumn("priority", D.priority_by_hours(D.hours_left(F.col("deadline"), now), said["urgent"], follow))
    return c.select("id", *FIELDS, "kind", "event", "pre_delivery", "link_only", "strong_key", "thread_key", "deadline", "priority", "missing", "problems", "confidence", "needs_ai", "ready", "state")


# queries: letters written from the positions of an order, so that SQL knows the fields without reading the letter

PORTAL = "portal.example.com/nondelivery"


def letters(spark, sf_dir) -> DataFrame:
    """A letter of each order about its first position, in one of nine shapes."""
    first = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min_by(F.struct("l_partkey", F.col("l_quantity").cast("int").alias("q")), F.struct("l_linenumber", "l_partkey", "l_quantity")).alias("l"))
    # dealt out by key, as a join with a small table would leave all letters of a file in one task
    o = read(spark, sf_dir, "orders").repartition("o_orderkey").join(first, "o_orderkey", "left")
    number, day, iso = (F.col("o_orderkey") + 100000).cast("string"), F.date_format("o_orderdate", "dd.MM.yyyy"), F.date_format("o_orderdate", "yyyy-MM-dd")
    part, q = F.concat(F.lit("AB-"), F.coalesce(F.col("l.l_partkey") + 1000, F.lit(999)).cast("string")), F.coalesce(F.col("l.q"), F.lit(1)).cast("string")
    say = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    shapes = [
        say("Прошу согласовать возврат: брак. УПД № ", number, " от ", day, ". Артикул: ", part, " Кол-во: ", q, ". Заказ ждём с 03.02.2020, тел. +7 912 345-67-89"),
        say("Возврат, пересорт. ", part, ", ", q, " шт, цена 1234,50 руб, документ № ", number, " за ", iso),
        say("Рекламация, излиш. Привезли ZX-77777 и 99 шт вместо. Код товара: ", part, " Количество = ", q, " накладная ", number, " от ", iso),
        say("По заявке № ", number, " возврат, брак. Артикул: ", part, ". Телефон 8 912 345 67 89, пишите на box", number, "@example.com"),
        say("Обращение № ", number, ", возврат, пересорт. Артикул: ", part, ". К УПД ", number, " от ", day),
        say("Возврат. Маркировка AB-5555, честный знак AB-5555. Счет-фактура ", number, " на 500,00 руб и 10,00 руб"),
        say("Недопоставка, список: https://www.", PORTAL, "/", number, "?n=12345"),
        say("Возврат: просим не отгружать. Заявка клиента № ", number, ", артикул - ", part, ", ", q, " шт. Срочно!"),
        say("Напоминаем о возврате, претензия № ", number, "/1"),
    ]
    k = (F.col("o_orderkey") % len(shapes)).cast("int")
    body = F.coalesce(*[F.when(k == i, s) for i, s in enumerate(shapes)])
    ref = F.concat(F.lit("<m"), (F.col("o_orderkey") - 1).cast("string"), F.lit(">"))
    return o.select(
        F.col("o_orderkey").alias("id"), F.lit("Письмо").alias("subject"), body.alias("text"), F.lit("inbound_customer").alias("direction"), F.when(F.col("o_custkey") % 5 > 0, F.concat(F.lit("b"), F.col("o_custkey").cast("string"))).alias("buyer"), F.lit(0.9).alias("buyer_score"),
        F.col("o_orderstatus").isin("F", "O").alias("first"), F.when(F.col("o_orderstatus") == "P", F.array(ref)).alias("references"), F.lit(None).cast("string").alias("reply_to"), F.array(F.lit("photo.jpg"), F.lit("act.pdf")).alias("names"), F.col("o_orderdate").cast("timestamp").alias("received"),
    )


_LETTERS = f"""WITH l AS (SELECT l_orderkey, arg_min((l_partkey, l_quantity::INT), (l_linenumber, l_partkey, l_quantity)) AS p FROM lineitem GROUP BY 1)
, v AS (SELECT o_orderkey AS id, o_orderkey % 9 AS k, (o_orderkey + 100000)::VARCHAR AS number, strftime(o_orderdate, '%d.%m.%Y') AS day, strftime(o_orderdate, '%Y-%m-%d') AS iso, 'AB-' || coalesce(p[1] + 1000, 999) AS part, coalesce(p[2], 1)::VARCHAR AS q, o_orderstatus <> 'P' AS first_, CASE WHEN o_custkey % 5 > 0 THEN 'b' || o_custkey END AS buyer FROM orders LEFT JOIN l ON l_orderkey = o_orderkey)
, f AS (SELECT *, CASE WHEN k IN (0, 1, 2, 4, 5) THEN number END AS document_number, CASE WHEN k IN (0, 4) THEN day WHEN k IN (1, 2) THEN iso END AS document_date, CASE WHEN k IN (0, 1, 2, 3, 4, 7) THEN part END AS part_number, CASE WHEN k IN (0, 1, 2, 7) THEN q END AS quantity, CASE k WHEN 1 THEN '1234,50' WHEN 5 THEN '500,00' END AS price,
  CASE WHEN k = 8 THEN number || '/1' END AS claim_number, CASE WHEN k IN (3, 7) THEN number END AS client_request_number, CASE WHEN k IN (0, 3) THEN 'defect' WHEN k IN (1, 4) THEN 'wrong_item' WHEN k = 2 THEN 'surplus' WHEN k = 6 THEN 'shortage' END AS kind FROM v)
, e AS (SELECT *, CASE WHEN k = 6 THEN 'shortage_link_event' WHEN NOT first_ AND k = 8 THEN 'followup_reminder' WHEN NOT first_ THEN 'followup_dialog' WHEN k = 7 THEN 'pre_delivery_refusal' ELSE 'new_return' END AS event,
  CASE WHEN buyer IS NULL THEN NULL WHEN k = 8 THEN 'claim_number:' || buyer || ':' || number || '/1' WHEN k IN (3, 7) THEN 'client_request_number:' || buyer || ':' || number WHEN k IN (0, 1, 2, 4) THEN 'doc_part:' || buyer || ':' || number || ':' || lower(part) WHEN k = 5 THEN 'document:' || buyer || ':' || number END AS strong_key FROM f)
, m AS (SELECT *, event IN ('new_return', 'pre_delivery_refusal') AS back, concat_ws(',', CASE WHEN buyer IS NULL THEN 'buyer' END, CASE WHEN event IN ('new_return', 'pre_delivery_refusal') AND strong_key IS NULL THEN 'strong_key' END, CASE WHEN event = 'new_return' AND document_number IS NULL AND claim_number IS NULL AND client_request_number IS NULL THEN 'document_number' END,
  CASE WHEN event IN ('new_return', 'pre_delivery_refusal') AND part_number IS NULL THEN 'part_number' END) AS missing, '' AS problems, CASE WHEN event = 'pre_delivery_refusal' THEN part_number IS NOT NULL ELSE document_number IS NOT NULL AND document_date IS NOT NULL AND part_number IS NOT NULL AND kind IS NOT NULL END AS least_ FROM e)
, t AS (SELECT *, round(CASE WHEN event IN ('followup_reminder', 'followup_dialog') THEN greatest(0.75, base) WHEN back AND least_ AND buyer IS NOT NULL THEN greatest(0.82, base) ELSE base END, 3) AS confidence FROM (SELECT *, 0.1 + 0.35 * 0.9 + 0.35 * CASE WHEN kind IS NULL THEN 0 ELSE 0.57 END + CASE WHEN strong_key IS NULL THEN 0 ELSE 0.2 END AS base FROM m))
, r AS (SELECT *, back AND (confidence < 0.8 OR NOT least_ OR buyer IS NULL) AS needs_ai FROM t)
"""


@query(_LETTERS + """SELECT id, document_number, document_date, part_number, quantity, price, claim_number, client_request_number, kind, event, strong_key, missing, problems, confidence::DOUBLE AS confidence, needs_ai, back AND missing = '' AND least_ AND NOT needs_ai AS ready,
CASE WHEN event = 'shortage_link_event' THEN 'needs_link' WHEN event IN ('followup_reminder', 'followup_dialog') THEN CASE WHEN strong_key IS NULL THEN 'needs_link' ELSE 'linked_event' END WHEN back AND missing = '' AND least_ AND NOT needs_ai THEN 'ready_to_1c' ELSE 'needs_review' END AS state FROM r""")
def classified_letters(spark, sf_dir):
    out = classify(letters(spark, sf_dir), F.lit("1999-01-01 00:00:00").cast("timestamp"), [PORTAL])
    return out.select("id", *FIELDS, "kind", "event", "strong_key", F.array_join("missing", ",").alias("missing"), F.array_join("problems", ",").alias("problems"), "confidence", "needs_ai", "ready", "state")


#: What documents hold: addresses, links, dates and numbers with units; overlaps go to the higher score.
TOKENS = [
    Extractor("link", BLOCK, r"https?://[A-Za-z0-9./?=&_%-]+", 90, 0),
    Extractor("address", LABEL, r"[A-Za-z0-9][A-Za-z0-9._-]{0,40}@[A-Za-z0-9.-]{1,60}", 80, 0),
    Extractor("date", LABEL, r"[0-9]{1,4}[./-][0-9]{1,2}[./-][0-9]{1,4}", 70, 0),
    Extractor("telephone", BLOCK, r"[+(]?[0-9][0-9 ()-]{7,16}[0-9]", 60, 0),
    Extractor("year", GUESS, r"(?:in|of|de|von) ([12][0-9]{3})", 75),
    Extractor("number", GUESS, r"[0-9]+(?:[.,][0-9]+)?", 20, 0),
    Extractor("count", GUESS, r"([0-9]+) [a-z]{4,}", 40, leading=True),
    Extractor("number", BAD, r"version|Version|page|Seite", 0, 0),
]
_TOKEN_ROWS = " UNION ALL ".join(
    f"SELECT doc_id, text, '{e.field}' AS field, '{e.kind}' AS kind, {e.score} AS score, regexp_extract_all(text, '{e.pattern}') AS hits, string_split(regexp_replace(text, '{e.pattern}', chr(1), 'g'), chr(1)) AS gaps, regexp_extract_all(text, '{e.pattern}', {e.group}) AS vals, {str(e.leading).lower()} AS ahead FROM d"
    for e in TOKENS
)


@query(rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents WHERE doc_id IS NOT NULL), m AS ({_TOKEN_ROWS})
, i AS (SELECT * EXCLUDE (hits, gaps, vals, text), generate_subscripts(hits, 1) AS n, unnest(hits) AS hit, unnest(gaps[:len(hits)]) AS gap, unnest(vals) AS val FROM m WHERE len(hits) > 0)
, p AS (SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id, field, kind ORDER BY n) AS stop FROM i)
, s AS (SELECT doc_id, field, kind, score, val, CASE WHEN ahead THEN stop - length(hit) ELSE stop - length(val) END AS a FROM p)
, g AS (SELECT v.*, NOT EXISTS (SELECT 1 FROM s b WHERE b.doc_id = v.doc_id AND b.kind = 'bad' AND b.field = v.field AND b.a + length(b.val) <= v.a AND b.a >= v.a - 22) AS clean FROM s v WHERE kind <> 'bad')
, c AS (SELECT * FROM g QUALIFY bool_or(clean) OVER (PARTITION BY doc_id, field, lower(val)))
, o AS (SELECT doc_id, list([{{'s': score, 'a': a, 'b': a + length(val), 'f': field, 'k': kind, 'v': val}}] ORDER BY score DESC, length(val) DESC, a, field, kind) AS spans FROM c GROUP BY doc_id)
, r AS (SELECT doc_id, unnest(list_reduce(spans, lambda x, y: CASE WHEN len(list_filter(x, lambda z: z.a < y[1].b AND y[1].a < z.b)) > 0 THEN x ELSE x || y END)) AS t FROM o)
SELECT doc_id, t.f AS field, t.a::INTEGER AS start, t.b::INTEGER AS "end", t.v AS value FROM r""")
def document_spans(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return S.settled(S.without_bad(S.found(d, "doc_id", F.col("text"), TOKENS))).select(F.col("id").alias("doc_id"), "field", "start", "end", "value")
