"""Decisions on a mail and its case: safety, visible bucket, folder, reason, route, final bucket, events and actions.

Each is one ordered ``when`` chain over the columns of a view of mail left-joined to case:

    mail: subject, body, mail_status, duplicate (boolean)
    case: case_id (null without a case), event_type, claim_kind, state, status, ready, needs_ai, gate_passed, blocking,
          pre_delivery, shortage_link (booleans), subcategory, defect_docs, missing (array<string>),
          statuses (map field -> status), part_number, document_number, request_number

A later decision reads the columns of earlier ones, under the names that ``decided`` gives them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions import text as X
from postmill.plans.routing import decide

#: Events and kinds of the rules below.
SERVICE_EVENTS = ["marking_request", "correction_request", "document_flow_notice", "info_update", "number_replacement"]
SERVICE_KINDS = ["marking_request", "correction_request", "number_replacement"]
FOLLOWUP_EVENTS = ["followup_dialog", "followup_reminder", "supplier_decision", "ready_to_ship", "shortage_link_event"]
RETURN_EVENTS = ["new_return", "pre_delivery_refusal"]
RETURN_KINDS = ["quality_refusal", "defect", "nonconforming", "shortage", "wrong_item", "incomplete_set", "overdelivery"]
CAUSES = [*RETURN_KINDS, "marking", "number_replacement", "pre_delivery_refusal"]
VISIBLE = ["action.review", "action.ai_assist", "action.ready_to_1c", "action.errors", "terminal.linked_active", "terminal.linked_completed", "terminal.supplier_report", "terminal.service", "terminal.duplicate", "terminal.junk", "technical.raw_without_case", "technical.unknown"]
FOLDERS = ["review", "ai", "ready", "defect_unchecked", "defect_incomplete", "errors", "pre_delivery", "shortage_link", "number_replacement", "marking", "correction", "ready_to_ship", "links_active", "links_completed", "reports", "problem_notice", "duplicates", "junk", "raw_no_case", "unknown", "service_other"]
ROUTES = ["ready_for_operator", "ai_assist", "manual_review", "ready_to_1c", "no_action_archive", "error_technical"]
FINAL = ["auto_safe_staged", "auto_safe_preview_not_staged", "auto_warning_candidate", "quick_review_one_click", "quick_review_choice", "human_review", "blocked_needs_rule", "needs_link", "terminal_non_export", "duplicate_or_followup", "unknown_error"]
NEXT_ACTION = {
    "auto_safe_staged": "await_staging_approval", "auto_safe_preview_not_staged": "stage_safe", "auto_warning_candidate": "manual_sample_or_warning_policy",
    "quick_review_one_click": "operator_one_click_decision", "quick_review_choice": "operator_choice", "human_review": "operator_full_review",
    "blocked_needs_rule": "create_supplier_rule_or_parser_fix", "needs_link": "link_to_parent_case", "terminal_non_export": "no_action_terminal",
    "duplicate_or_followup": "keep_linked_no_export", "unknown_error": "inspect_runtime_or_data_error",
}
CONTROL_ACTION = {
    "sla_overdue": "escalate_overdue_case", "sla_due_soon": "prioritize_before_deadline", "waiting_customer_documents": "request_missing_documents_or_photos",
    "return_ready": "create_or_update_return", "duplicate_or_repeat_ready": "prioritize_existing_or_merge_return", "followup_reminder": "prioritize_existing_case",
    "duplicate_or_repeat": "prioritize_existing_case", "followup_dialog": "append_to_case_history", "supplier_decision": "append_to_case_history",
    "status_update": "append_to_case_history", "needs_link": "request_link_to_existing_case", "needs_review": "request_operator_review", "blocked_missing_evidence": "request_operator_review",
}
#: Patterns of subjects and bodies.
REPLACEMENT = r"замен[а-яё]*\s+(номер|бренд|артикул)|перезавести\s+номер|номер\s*/\s*бренд"
MARKING = r"маркиров|тн\s*вэд|тнвэд"
PRE_DELIVERY = r"запрос\s+на\s+снятие|не\s+поставлять|снять\s+(этот\s+)?товар|отказ\s+(от\s+)?клиента\s+на\s+заказан|до\s+поставки|до\s+получения"
REPORT = r"прайс|остатк|отчет|отчёт|stock"
URGENT = r"срочно|напомина|когда\s+ответ|жд[её]м\s+решени|повторно|просим\s+ответить|ответьте|требуется\s+ответ"
#: Phrases by which the kind of a letter is told; data that may be exchanged.
WORDS = {
    "report": ["прайс", "остатки", "отчет об", "отчёт об"],
    "promo": ["акция", "скидк", "распродажа", "вебинар"],
    "ready_to_ship": ["готов к выдаче", "заберите возврат", "готов к отгрузке"],
    "info": ["информируем", "уведомляем", "график работы", "для информации"],
    "return_data": ["вернуть товар", "на возврат", "возврату подлеж", "необходимость вернуть"],
    "exchange": ["переход на эдо", "переход на систему эдо", "электронный документооборот", "оператор эдо", "диадок", "сбис"],
    "announce": ["сообщаем", "переход на", "просим вас уведомить", "по какой системе"],
    "reconcile": ["акт сверки", "прошу сверить", "просьба сверить", "сверить и подписать"],
    "reminder": ["напомина", "повторно", "срочно", "рассмотрели", "ждем ответ", "ждём ответ", "статус", "ответьте", "когда будет", "актуально", "что по", "повторная просьба"],
    "strong_reminder": ["повторно", "напомина", "рассмотрели", "рассмотрен", "ждем ответ", "ждём ответ", "ответьте", "когда будет", "что по", "актуально", "повторная просьба", "просьба дать ответ"],
    "decision": ["согласовано", "принято", "отказано", "одобрено", "решение", "можете вернуть", "возврат разрешен", "возврат разрешён"],
    "new": ["возврат", "рекламац", "претензи", "прошу согласовать", "заявляем", "вернуть"],
    "before_shipping": ["запрос на снятие", "снять этот товар", "не поставлять", "снятие позиции", "до отгрузки", "не отгружать", "отмена заказа", "отмена позиции", "снять с заказа", "отказ от поставки", "до поставки", "не привозить", "отменить заказ", "отказ до получения"],
    "shipped": ["упд", "накладн", "счёт-фактур", "счет-фактур", "реализаци", "торг-12", "документ реализации"],
}
REPLY = r"(?iu)^\s*(re|fw|fwd|отв|пер|ответ)\s*:"


def _has(x: Column) -> Column:
    return F.length(F.trim(F.coalesce(x, F.lit("")))) > 0


def _yes(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _matches(x: Column, pattern: str) -> Column:
    return F.coalesce(x.rlike("(?iu)" + pattern), F.lit(False))


# what kind of letter it is


def event_type(text: Column, subject: Column, reply_headers: Column, first: Column, direction: Column, kind: Column, part: Column, document: Column, request: Column, words: dict[str, Sequence[str]] = WORDS, said: Mapping[str, Column] | None = None) -> Column:
    """struct(value, reason) of a letter: reports, adverts and notices first, then direction, service kinds, follow-ups, new returns.

    ``said`` has for each list of words whether the text holds one of them, if that is known; else the text is searched.
    """
    says = lambda key: X.contains_any(text, words[key]) if said is None else said[key]
    reply = reply_headers | F.coalesce(subject.rlike(REPLY), F.lit(False))
    goods = _has(part) & (_has(document) | _has(request)) | says("return_data")
    signal = says("new") | (_has(part) & _has(document)) | _has(request) | _has(kind)
    return decide(
        [
            (says("report"), "supplier_report", "service_report"),
            (says("promo") & ~_has(part) & ~_has(document), "spam_promo", "spam_promo"),
            (says("ready_to_ship"), "ready_to_ship", "ready_to_ship_phrases"),
            (~_has(kind) & ~goods & says("info"), "info_only", "info_only_phrases"),
            (~_has(part) & says("exchange") & says("announce"), "info_only", "edo_announcement"),
            (says("reconcile"), "followup_reminder", "reconciliation_request"),
            (direction == "outbound", "outbound", "direction"),
            (direction == "internal", "internal", "direction"),
            (kind == "correction_request", "correction_request", "service_type"),
            (kind == "marking_request", "marking_request", "service_type"),
            (kind == "number_replacement", "number_replacement", "service_type"),
            (~first & says("strong_reminder"), "followup_reminder", "strong_reminder_words"),
            (says("decision") & reply, "supplier_decision", "supplier_decision_words"),
            (~first & reply, "followup_dialog", "reply"),
            (~first & says("reminder"), "followup_reminder", "reminder_words"),
            (~first, "followup_dialog", "not_first_fallback_followup"),
            (signal & _has(kind), "new_return", "kind"),
            (signal, "new_return", "new_return_without_subkind"),
            (reply, "followup_dialog", "reply"),
        ],
        ("unknown", "no_rule"),
    )


def pre_delivery_refusal(text: Column, event: Column, document: Column, words: dict[str, Sequence[str]] = WORDS, said: Mapping[str, Column] | None = None) -> Column:
    """A return that asks not to ship, with no sign of a shipping document. ``said``: as in ``event_type``."""
    says = lambda key: X.contains_any(text, words[key]) if said is None else said[key]
    return (event == "new_return") & says("before_shipping") & ~_has(document) & ~says("shipped")


def marking_subcategory(text: Column) -> Column:
    says = lambda *w: X.contains_any(text, w)
    code = says("тнвэд", "тн вэд", "код тн")
    return F.when(
        code | says("маркировк", "честн"),
        F.when(says("исправьте в своей системе", "поправьте в своей системе"), "marking.need_supplier_fix")
        .when(says("в нашей системе указан код", "поправить код", "исправить код в нашей системе"), "marking.need_our_system_fix")
        .when(says("не подлежащий маркировке", "не подлежит маркировке"), "marking.not_required")
        .when(code & says("не совпад", "неверн", "поправ", "исправ", "указан код"), "marking.tnved_mismatch")
        .when(says("код маркировки", "коды маркировки", "честного знака") & says("не совпад", "неверн", "ошиб"), "marking.code_mismatch")
        .otherwise("marking.required"),
    )


def kind_from_act(text: Column) -> Column:
    """The kind that an act names after its verdict, column of return types, or comment; null without any of the three."""
    t = X.norm(F.coalesce(text, F.lit("")))
    cut = lambda mark, width: F.when(F.locate(mark, t) > 0, F.substring(t, F.locate(mark, t), F.lit(width)))
    window = F.coalesce(cut("мнение комисси", 2000), cut("тип возврата", 2000), cut("комментарий", 70))
    v = F.regexp_replace(window, r"(?s)(?<=.{41})заключени.*$", "")
    has = lambda *w: X.contains_any(v, w)
    return (
        F.when(v.isNull(), F.lit(None).cast("string")).when(has("недопоставк", "недостач"), "shortage").when(has("честн", "маркировк") | (has("код") & has("не совпад")), "marking_request")
        .when(has("пересорт", "не верный подбор", "неверный подбор"), "wrong_item").when(has("излиш"), "overdelivery").when(has("отказ", "октаз"), "quality_refusal")
        .when(has("сломан", "не работает", "неисправ", "разбит", "трещин", "отсутств", "некомплект", "поврежд", "бой", "скол", "вмятин", "деформ", "брак", "дефект"), "defect")
    )


# proof


#: File names of photographs, documents and the three papers of a defect.
PHOTO_FILE, DOCUMENT_FILE = r"(?i)\.(jpg|jpeg|png|heic|webp|bmp|gif)$", r"(?i)\.(pdf|doc|docx|xls|xlsx|zip|rar|7z)$"
DEFECT_PAPERS = {"install_order": r"(?iu)установк|монтаж|install", "removal_order": r"(?iu)сняти|снят|демонтаж|removal", "service_act": r"(?iu)акт|заключени|сервис|дефектовк|диагност|экспертиз|akt|act|torg|торг[- ]?2"}
PROOF_LINK = r"(?iu)возврат|претенз|рекламац|claim|return|rma|photo|фото|акт"


def evidence_summary(names: Column, links: Column) -> Column:
    """struct of counts and flags over the file names of the attachments and the links of the text."""
    n = lambda a, pattern: F.size(F.filter(a, lambda x: x.rlike(pattern)))
    photos, papers, service, proof = n(names, PHOTO_FILE), n(names, DOCUMENT_FILE), n(names, DEFECT_PAPERS["service_act"]), n(links, PROOF_LINK)
    return F.struct(
        F.size(names).alias("attachments"), photos.alias("photos"), papers.alias("documents"), service.alias("service_documents"), F.size(links).alias("links"), proof.alias("return_links"),
        (photos > 0).alias("has_photo"), (papers + service + proof > 0).alias("has_document"), (service + proof > 0).alias("has_service_document"),
    )


def required_evidence(kind: Column, strict: bool = True) -> Column:
    """struct(photo, service_document): what a kind of claim needs."""
    photo = kind.isin("defect", "nonconforming", "wrong_item", "shortage", "incomplete_set")
    return F.struct((photo & F.lit(strict)).alias("photo"), ((kind == "defect") & F.lit(strict)).alias("service_document"))


def _like(pattern: str):
    return lambda x: x.rlike(pattern)


def defect_papers(names: Column) -> Column:
    """struct(state, missing): how many of the three papers of a defect the file names show; absent without any file."""
    missing = F.array_compact(F.array(*[F.when(~F.exists(names, _like(pattern)), name) for name, pattern in DEFECT_PAPERS.items()]))
    state = F.when(F.size(names) == 0, "absent").when(F.size(missing) == 0, "complete").when(F.size(missing) < 3, "partial").otherwise("present_unverified")
    return F.struct(state.alias("state"), missing.alias("missing"))


def defect_flags(kind: Column, summary: Column, papers: Column) -> Column:
    """struct(missing, incomplete, complete, attention) for export; other kinds have none of them."""
    defect = kind.isin("defect", "nonconforming")
    paper = (papers > 0) | summary["has_service_document"]
    return F.struct(
        (defect & (summary["attachments"] == 0) & (summary["links"] == 0)).alias("missing"), (defect & (summary["attachments"] > 0) & ~paper).alias("incomplete"),
        (defect & paper).alias("complete"), (defect & ~paper).alias("attention"),
    )


def evidence_signals(names: Column, links: Column) -> Column:
    """array<string>: cheap signs of proof by names of files and hosts of links."""
    every = X.norm(F.concat_ws(" ", F.concat(names, links)))
    files, urls = X.norm(F.concat_ws(" ", names)), X.norm(F.concat_ws(" ", links))
    return F.array_compact(
        F.array(
            F.when(every.rlike("брак|дефект|defect"), "defect_by_name"), F.when(every.rlike("недопост|недовоз|nondelivery"), "shortage_by_name"),
            F.when(files.rlike("торг|torg|акт|akt"), "act_torg2_doc"), F.when(files.rlike("упд|upd|накладн"), "upd_document"),
            F.when(F.exists(names, lambda x: x.rlike(PHOTO_FILE)) | urls.rlike("reclamation|claim-transfer|/photo"), "photo_evidence"),
            F.when(urls.rlike("youtu|video"), "video_evidence"), F.when(urls.rlike("return|vozvrat|nondelivery"), "return_portal_link"), F.when(F.exists(names, lambda x: x.rlike(r"(?i)\.(xls|xlsx|csv)$")), "position_table"),
        )
    )


def quality_missing(event: Column, kind: Column, direction: Column, buyer: Column, key: Column, document: Column, request: Column, part: Column, pre_delivery: Column, link_only: Column, summary: Column) -> Column:
    """array<string>: what a case lacks for export; proof by the required evidence of its kind."""
    back, need = event.isin(*RETURN_EVENTS), required_evidence(kind)
    usual = back & ~pre_delivery & ~link_only
    return F.array_compact(
        F.array(
            F.when((direction == "inbound_customer") & ~_has(buyer), "buyer"), F.when(back & ~_has(key) & ~link_only, "strong_key"),
            F.when(back & pre_delivery & ~link_only & ~_has(request), "client_request_number"), F.when(usual & ~_has(document) & ~_has(request), "document_number"),
            F.when(back & ~link_only & ~_has(part), "part_number"), F.when(back & need["photo"] & ~summary["has_photo"], "photo_evidence"),
            F.when(back & need["service_document"] & ~summary["has_service_document"], "service_document"), F.when(event == "unknown", "event_type"),
        )
    )


def control_summary(event: Column, state: Column, ready: Column, missing: Column, key: Column, overdue: Column) -> Column:
    """struct(status, action, owner) of what business must do now; an overdue case is escalated."""
    lacks = lambda *k: F.arrays_overlap(missing, F.array(*map(F.lit, k)))
    shape = lambda status, action, owner: F.struct(F.lit(status).alias("status"), (action if isinstance(action, Column) else F.lit(action)).alias("action"), F.lit(owner).alias("owner"))
    way = lambda yes, no: F.when(_has(key), yes).otherwise(no)
    plain = (
        F.when(ready & (state == "ready_to_1c"), shape("ready_to_1c", "send_to_1c", "system"))
        .when(event == "followup_reminder", shape("customer_reminder", way("raise_priority_existing_case", "link_reminder_to_case"), "operator_or_1c"))
        .when(event == "supplier_decision", shape("supplier_decision_received", "append_decision_and_update_case", "operator_or_1c"))
        .when(event == "followup_dialog", shape("dialog_update", way("append_to_case_history", "link_dialog_to_case"), "operator_or_1c"))
        .when(lacks("photo_evidence", "service_document"), shape("waiting_customer_documents", "request_missing_evidence", "customer"))
        .when(lacks("strong_key"), shape("needs_business_key", "extract_or_request_document_number", "system_then_operator"))
        .when(lacks("buyer"), shape("needs_buyer_identification", "identify_customer_or_ask_ai", "system_then_operator"))
        .when(state == "needs_link", shape("needs_link", "link_to_existing_case", "operator_or_1c"))
        .when(state == "needs_review", shape("needs_review", "review_or_run_ai", "system_then_operator"))
        .when(state == "linked_event", shape("under_control", "keep_in_case_history", "system"))
        .when(state == "context_sent", shape("waiting_counterparty_or_1c", "wait_for_response", "counterparty"))
        .when(state == "ignored_internal", shape("ignored_internal", "no_business_action", "system"))
        .otherwise(shape("needs_review", "review_unknown_event", "system_then_operator"))
    )
    late = overdue & ~plain["status"].isin("ready_to_1c", "ignored_internal")
    return F.struct(F.when(late, F.concat(F.lit("overdue_"), plain["status"])).otherwise(plain["status"]).alias("status"), F.when(late, F.concat(F.lit("escalate_"), plain["action"])).otherwise(plain["action"]).alias("action"), plain["owner"].alias("owner"))


def case_event(event: Column, state: Column, ready: Column, missing: Column, related: Column, overdue: Column, due_soon: Column) -> Column:
    """struct(value, reason): the event to queue for a case; the reason is the action that it asks for."""
    open_ = ~state.isin("ready_to_1c", "ignored_internal", "closed", "exported")
    proof = F.arrays_overlap(missing, F.array(F.lit("photo_evidence"), F.lit("service_document")))
    is_ready = ready & (state == "ready_to_1c")
    rules = [
        (overdue & open_, "sla_overdue"), (due_soon & open_, "sla_due_soon"), (proof & ~event.isin("followup_reminder", "followup_dialog", "supplier_decision") & ~is_ready, "waiting_customer_documents"),
        (is_ready & related, "duplicate_or_repeat_ready"), (is_ready, "return_ready"), (event == "followup_reminder", "followup_reminder"), (event == "followup_dialog", "followup_dialog"),
        (event == "supplier_decision", "supplier_decision"), (state == "needs_link", "needs_link"), (related & (event == "new_return"), "duplicate_or_repeat"), (proof, "blocked_missing_evidence"), (state == "needs_review", "needs_review"),
    ]
    return decide([(condition, value, CONTROL_ACTION[value]) for condition, value in rules], ("status_update", CONTROL_ACTION["status_update"]))


# where it goes


def strength() -> Column:
    """strong, medium, weak or none, by gate, missing fields and statuses of fields."""
    values = F.coalesce(F.map_values("statuses"), F.array().cast("array<string>"))
    lacks = F.size(F.coalesce("missing", F.array().cast("array<string>"))) > 0
    confirmed = F.size(F.filter(values, lambda v: v.contains("confirm")))
    weak = F.exists(values, lambda v: v.rlike("weak|missing|guess"))
    return (
        F.when(F.col("case_id").isNull(), "none")
        .when(_yes("ready") & _yes("gate_passed") & ~lacks & ~_yes("blocking"), "strong")
        .when(_yes("blocking") | (lacks & (confirmed == 0)), "weak")
        .when((confirmed >= 2) & ~weak, "medium").when(weak | lacks, "weak").otherwise("medium")
    )


def _replaced() -> Column:
    return (_text("claim_kind") == "number_replacement") | (_text("event_type") == "number_replacement") | _matches(F.col("subject"), REPLACEMENT)


def safety_route() -> Column:
    """struct(value, reason): ready_to_1c, ai_assist, manual_review, errors, terminal or service; reads ``strength``."""
    event, kind, state = _text("event_type"), _text("claim_kind"), _text("state")
    lacks = F.size(F.coalesce("missing", F.array().cast("array<string>")))
    back = event.isin(*RETURN_EVENTS) | kind.isin(*RETURN_KINDS)
    follow = event.isin(*FOLLOWUP_EVENTS) | (state == "linked_event")
    safe = _yes("ready") & (state == "ready_to_1c") & _yes("gate_passed") & ~_yes("blocking") & F.col("strength").isin("strong", "medium")
    return decide(
        [
            (F.col("case_id").isNull(), "manual_review", "raw_without_case"),
            ((_text("status") == "error") | (state == "error"), "errors", "processing_error"),
            (event.isin(*SERVICE_EVENTS) | kind.isin(*SERVICE_KINDS), "service", "service_event"),
            (event.isin("info_only", "supplier_report") | (state == "ignored_info_only"), "terminal", "ignored"),
            (follow & (state == "needs_link"), "manual_review", "missing_parent"),
            (follow, "terminal", "linked"),
            (state == "needs_link", "manual_review", "needs_link"),
            (back & safe, "ready_to_1c", "gate_passed"),
            (back & _yes("pre_delivery"), "manual_review", "pre_delivery_refusal"),
            (back & ((F.col("strength") == "weak") | lacks.between(1, 2) | _yes("needs_ai")), "ai_assist", "weak_evidence"),
            (back, "manual_review", "not_ready"),
        ],
        ("manual_review", "unknown_type"),
    )


def visible_bucket() -> Column:
    """struct(value, reason): exactly one of VISIBLE; reads ``decision`` (the value of the safety route)."""
    event, state, decision = _text("event_type"), _text("state"), F.col("decision")
    report = _matches(F.col("subject"), REPORT) | _matches(F.col("subcategory"), "price|report")
    info = (decision == "terminal") & ((event == "info_only") | (state == "ignored_info_only"))
    return decide(
        [
            (F.col("case_id").isNull(), "technical.raw_without_case", "no_case"),
            ((_text("mail_status") == "duplicate") | _yes("duplicate") | (event == "duplicate"), "terminal.duplicate", "duplicate"),
            (_replaced() & (decision != "errors"), "terminal.service", "number_replacement"),
            ((state == "needs_link") & ~decision.isin("service", "errors"), "terminal.linked_active", "needs_link"),
            (decision == "service", "terminal.service", "service"),
            (info & report, "terminal.supplier_report", "report"),
            (info, "terminal.junk", "info_or_noise"),
            ((decision == "terminal") & (state == "linked_event"), "terminal.linked_completed", "linked_event"),
            (decision == "terminal", "terminal.linked_active", "linked"),
            (decision == "ready_to_1c", "action.ready_to_1c", "ready"),
            (decision == "ai_assist", "action.ai_assist", "weak_evidence"),
            (decision == "errors", "action.errors", "error"),
            (event.isin("", "unknown") & ~_text("claim_kind").isin(*RETURN_KINDS), "technical.unknown", "unknown"),
        ],
        ("action.review", "manual_review"),
    )


def folder() -> Column:
    """struct(value, reason): exactly one of FOLDERS, with its group as the reason; reads ``bucket`` (the visible one)."""
    event, kind, state, bucket = _text("event_type"), _text("claim_kind"), _text("state"), F.col("bucket")
    words = F.concat_ws(" ", "subject", "body")
    ready_defect = (bucket == "action.ready_to_1c") & (kind == "defect")
    return decide(
        [
            (bucket == "technical.raw_without_case", "raw_no_case", "TECHNICAL"),
            (bucket == "terminal.duplicate", "duplicates", "TERMINAL"),
            (bucket == "action.errors", "errors", "ACTION"),
            (_replaced() | _matches(words, REPLACEMENT), "number_replacement", "SPECIAL_ACTION"),
            ((event == "marking_request") | (kind == "marking_request") | _matches(words, MARKING), "marking", "SPECIAL_ACTION"),
            ((event == "pre_delivery_refusal") | _yes("pre_delivery") | _matches(words, PRE_DELIVERY), "pre_delivery", "SPECIAL_ACTION"),
            ((kind == "shortage") & (_yes("shortage_link") | (_text("subcategory") == "shortage.link_only")), "shortage_link", "SPECIAL_ACTION"),
            ((event == "correction_request") | (kind == "correction_request"), "correction", "SPECIAL_ACTION"),
            (event == "ready_to_ship", "ready_to_ship", "SPECIAL_ACTION"),
            ((event == "problem_notice") | (state == "problem_notice"), "problem_notice", "OBSERVE"),
            (ready_defect & _text("defect_docs").isin("", "unknown_not_read", "metadata_only", "missing"), "defect_unchecked", "ACTION"),
            (ready_defect & (_text("defect_docs") == "incomplete"), "defect_incomplete", "ACTION"),
            (bucket == "action.review", "review", "ACTION"),
            (bucket == "action.ai_assist", "ai", "ACTION"),
            (bucket == "action.ready_to_1c", "ready", "ACTION"),
            (bucket == "terminal.linked_active", "links_active", "LINKED"),
            (bucket == "terminal.linked_completed", "links_completed", "LINKED"),
            (bucket == "terminal.supplier_report", "reports", "TERMINAL"),
            (bucket == "terminal.junk", "junk", "TERMINAL"),
            (bucket == "terminal.service", "service_other", "SPECIAL_ACTION"),
        ],
        ("unknown", "TECHNICAL"),
    )


#: The reason that a folder stands for by itself.
FOLDER_REASON = {
    "marking": "marking", "number_replacement": "number_replacement", "pre_delivery": "pre_delivery_refusal", "shortage_link": "shortage", "correction": "correction", "ready_to_ship": "ready_to_ship",
    "links_completed": "linked_completed", "reports": "supplier_report", "duplicates": "duplicate", "junk": "junk", "raw_no_case": "unknown", "unknown": "unknown",
}


def reason_group() -> Column:
    """The cause or event of a mail, by its folder, then by event and kind; reads ``folder``."""
    event, kind = _text("event_type"), _text("claim_kind")
    linked = F.when(event == "supplier_decision", "linked_decision").when((event != "followup_reminder") & _matches(F.col("subcategory"), "document"), "linked_documents").otherwise("linked_reminder")
    own = F.try_element_at(F.create_map(*[F.lit(x) for kv in FOLDER_REASON.items() for x in kv]), F.col("folder"))
    rest = F.when(F.col("folder") == "links_active", linked).when(event == "pre_delivery_refusal", event).when(kind.isin(*RETURN_KINDS), kind).when(event == "new_return", "quality_refusal").when(event == "correction_request", "correction").otherwise("unknown")
    return F.coalesce(own, rest)


def required_missing(delivered: bool = True) -> Column:
    """array<string>: the fields that the reason asks for and the case lacks; reads ``reason``."""
    reason, part, document, request = F.col("reason"), _has(F.col("part_number")), _has(F.col("document_number")), _has(F.col("request_number"))
    by_document = reason.isin("quality_refusal", "defect", "nonconforming", "wrong_item", "overdelivery", "incomplete_set")
    return F.array_compact(
        F.array(
            F.when((reason == "pre_delivery_refusal") & ~part & ~request, "part_number_or_request_number"),
            F.when((by_document | reason.isin("marking", "number_replacement", "shortage")) & ~part, "part_number"),
            F.when(by_document & F.lit(delivered) & ~document, "document_number"),
        )
    )


def uplift(phrases: dict[str, Sequence[str]]) -> Column:
    """Whether a supplier's own phrase makes the evidence strong: with a part number and no word of another cause."""
    words = F.concat_ws(" ", "subject", "body")
    hit = F.lit(False)
    for buyer, own in phrases.items():
        hit = F.when(F.col("buyer") == buyer, X.contains_any(words, own)).otherwise(hit)
    other = (F.col("reason") == "quality_refusal") & X.contains_any(words, ["брак", "пересорт", "недовоз", "недопостав"])
    return F.col("case_id").isNotNull() & _has(F.col("part_number")) & hit & ~other


def canonical_route() -> Column:
    """struct(value, reason): exactly one of ROUTES; reads ``bucket``, ``reason``, ``required``, ``proof`` (strength after uplift), ``parent``."""
    bucket, reason, proof, n = F.col("bucket"), F.col("reason"), F.col("proof"), F.size("required")
    cause = reason.isin(*CAUSES)
    asks = bucket.startswith("action.") | (_text("state") != "linked_event")
    return decide(
        [
            (bucket.isin("technical.raw_without_case", "technical.unknown", "action.errors"), "error_technical", "technical"),
            (reason.isin("supplier_report", "duplicate", "junk", "linked_completed"), "no_action_archive", "no_action"),
            (reason.isin("correction", "ready_to_ship") & asks, "manual_review", "event"),
            (reason.isin("correction", "ready_to_ship"), "no_action_archive", "event_done"),
            (reason.startswith("linked_") & F.col("parent").isNotNull(), "manual_review", "update_parent"),
            (reason.startswith("linked_"), "manual_review", "parent_not_found"),
            (cause & (bucket == "action.ready_to_1c"), "ready_to_1c", "payload_ready"),
            (cause & (n == 0) & proof.isin("strong", "medium") & ~_yes("blocking"), "ready_for_operator", "evidence"),
            (cause & (n.between(1, 2) | (proof == "weak") | (bucket == "action.ai_assist") | (reason == "shortage")), "ai_assist", "weak_or_missing"),
            (cause, "manual_review", "cause"),
        ],
        ("manual_review", "no_rule"),
    )


def decided(view: DataFrame, phrases: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """``view`` (with buyer and parent) and all decisions: strength, decision, bucket, folder, reason, required, proof, route."""
    out = view.withColumn("strength", strength()).withColumn("decision", safety_route()["value"]).withColumn("bucket", visible_bucket()["value"])
    out = out.withColumn("folder", folder()["value"]).withColumn("reason", reason_group()).withColumn("required", required_missing())
    out = out.withColumn("proof", F.when(uplift(phrases or {}), "strong").otherwise(F.col("strength")))
    return out.withColumn("route", canonical_route()["value"])


def final_bucket() -> Column:
    """The final sorting of a case; reads tasks, one_click and human_tasks (counts), staged_safe, safe, warning, repeated (booleans), dry_class, disposition."""
    state, event, dry = _text("state"), _text("event_type"), _text("dry_class")
    rules = [
        (state.isin("linked_event", "linking_event"), "duplicate_or_followup"),
        (state.isin("ignored_info_only", "ignore_info_only", "info_only") | (_text("disposition") == "terminal_non_export"), "terminal_non_export"),
        ((state == "needs_link") | (_text("disposition") == "link_required"), "needs_link"),
        (event.isin("followup_reminder", "followup_dialog", "supplier_decision"), "duplicate_or_followup"),
        (_yes("staged_safe"), "auto_safe_staged"), (_yes("safe") | (dry == "auto_export_safe"), "auto_safe_preview_not_staged"),
        (_yes("warning") | (dry == "auto_export_with_warning"), "auto_warning_candidate"), (F.col("human_tasks") > 0, "human_review"),
        ((F.col("tasks") > 0) & (F.col("one_click") == F.col("tasks")), "quick_review_one_click"), (F.col("tasks") > 0, "quick_review_choice"),
        (dry.isin("human_review", "suspicious_passed"), "human_review"), ((dry == "blocked") & _yes("repeated"), "blocked_needs_rule"), (dry == "blocked", "human_review"),
    ]
    return decide([(c, v, NEXT_ACTION[v]) for c, v in rules], ("unknown_error", NEXT_ACTION["unknown_error"]))


def final_sorting(cases: DataFrame, tasks: DataFrame, previews: DataFrame, staging: DataFrame, ledger: DataFrame, outbox: DataFrame, repeat: int = 5) -> DataFrame:
    """One row a case from six sources: its final bucket, next action, counts of tasks and decisions, and outbox statuses.

    ``cases`` (case_id, buyer, state, event_type, dry_class, disposition, blocking_reasons array<string>); ``tasks``
    (case_id, review_type, one_click); ``previews`` (case_id, safety_class); ``staging`` (case_id, safety_class, status);
    ``ledger`` (case_id, ts, field); ``outbox`` (case_id, status). Each source is reduced to a row a case before the join.
    A reason that ``repeat`` cases or more name is repeated.
    """
    reasons = cases.select("case_id", F.explode("blocking_reasons").alias("reason")).where("reason <> ''")
    often = reasons.groupBy("reason").agg(F.count("*").alias("n")).where(F.col("n") >= repeat).select("reason")
    repeated = reasons.join(often, "reason").groupBy("case_id").agg(F.lit(True).alias("repeated"))
    is_ = lambda c, v: F.bool_or(F.coalesce(F.col(c) == v, F.lit(False)))
    task = tasks.groupBy("case_id").agg(F.count("*").alias("tasks"), F.count_if("one_click").alias("one_click"), F.count_if(F.col("review_type") == "send_to_human_review").alias("human_tasks"))
    shown = previews.groupBy("case_id").agg(is_("safety_class", "auto_export_safe").alias("safe"), is_("safety_class", "auto_export_with_warning").alias("warning"))
    staged = staging.groupBy("case_id").agg(is_("safety_class", "auto_export_safe").alias("staged_safe"))
    notes = ledger.groupBy("case_id").agg(F.count("*").alias("decisions"), F.max_by("field", F.struct("ts", "field")).alias("last_field"))
    sent = outbox.groupBy("case_id").agg(F.array_join(F.array_sort(F.collect_set("status")), ",").alias("outbox_statuses"))
    out = cases
    for part in (repeated, task, shown, staged, notes, sent):
        out = out.join(part, "case_id", "left")
    out = out.na.fill(0, ["tasks", "one_click", "human_tasks", "decisions"]).withColumn("f", final_bucket())
    noted = (F.col("decisions") > 0) & F.col("f.value").isin("quick_review_one_click", "quick_review_choice")
    return out.select("case_id", F.coalesce("buyer", F.lit("unknown")).alias("buyer"), "event_type", F.col("f.value").alias("final_bucket"), F.when(noted, "decision_recorded_awaiting_rebuild").otherwise(F.col("f.reason")).alias("next_action"), "tasks", "decisions", "last_field", "outbox_statuses")


def taxonomy(has_message_id: Column, names: Column) -> Column:
    """category.subcategory of a mail as the audit names it; ``names`` are its file names."""
    event, kind, state = _text("event_type"), _text("claim_kind"), _text("state")
    follow = F.when(event.isin("followup_reminder", "followup_dialog", "supplier_decision"), event).when(event == "correction_request", "additional_documents").when(event == "ready_to_ship", "repeated_request").when(event == "marking_request", "clarification_request").otherwise("followup_dialog")
    listed = X.norm(F.concat_ws(" ", "subject", "body", F.concat_ws(" ", names)))
    report = F.when(listed.rlike(r"прайс|price.?list"), "price_list").when(listed.rlike("остатк|stock|наличи"), "stock_report").when(F.exists(names, lambda x: x.rlike(r"(?i)\.(xlsx?|csv|zip)$")), "excel_report").otherwise("daily_report")
    papers = F.when(_text("defect_docs").isin("docs_complete", "complete"), "defect.documents_present").when(_text("defect_docs").isin("docs_incomplete", "present_unverified"), "defect.incomplete_documents").when(_text("defect_docs").isin("docs_missing", "missing"), "defect.no_documents").otherwise("defect")
    back = F.when(_yes("pre_delivery"), "pre_delivery_refusal").when(kind == "defect", papers).when(kind.isin(*RETURN_KINDS), kind).otherwise("unknown_return_reason")
    named = lambda group, x: F.concat(F.lit(group + "."), x if isinstance(x, Column) else F.lit(x))
    return (
        F.when(_yes("duplicate") | (_text("mail_status") == "duplicate"), named("duplicate", F.when(has_message_id, "exact_message_id_duplicate").otherwise("semantic_duplicate")))
        .when(F.col("case_id").isNull(), named("unknown", F.when(~_has(F.concat_ws("", "subject", "body")), "no_body").otherwise("parser_failed")))
        .when((state == "linked_event") | (event.isin("followup_reminder", "followup_dialog", "supplier_decision") & (state != "needs_review")), named("linked_event", follow))
        .when(state == "needs_link", "linked_event.parent_missing")
        .when((event == "info_only") | (state == "ignored_info_only"), named("supplier_report", report))
        .when((event == "problem_notice") | (state == "problem_notice"), "problem_notice.defect_accepted_no_return")
        .when((event == "spam_promo") | (state == "ignored_spam_promo"), "junk.advertising")
        .when(event == "new_return", named("return_claim", back))
        .otherwise("unknown.needs_human_classification")
    )


def defect_class(status: Column, kind: Column, proposed: Column) -> Column:
    """How far the text backs a defect, by the status of its kind's evidence."""
    explicit = status.isin("confirmed_by_explicit_reason", "confirmed_by_reason_label", "confirmed_by_supplier_contract", "confirmed_by_table_reason_column")
    return F.when(status == "conflict_reason_detected", "conflict_defect").when(explicit & kind.isin("defect", "nonconforming"), "confirmed_defect").when(proposed & ~explicit, "defect_rejected_by_evidence").otherwise("weak_defect")


def asks_model(buyer: Column, missing: Column, enabled: bool = True, unknown_buyers: bool = True) -> Column:
    """Whether a case is worth a model's answer: an unknown buyer, or one of the fields that a model can find is missing."""
    wanted = F.array(*map(F.lit, ("buyer", "event_type", "claim_kind", "strong_key", "goods_or_document")))
    return F.lit(enabled) & ((~_has(buyer) & F.lit(unknown_buyers)) | F.coalesce(F.arrays_overlap(missing, wanted), F.lit(False)))


#: Phrases of reminders without content.
REMINDS = ["ожидаем ответ", "ждем ответ", "ждём ответ", "напоминаем", "просьба ответить", "прошу ответить", "нет ответа", "ожидаем решени", "ждем решени", "ждём решени"]


def contentless_reminder(text: Column, phrases: Sequence[str] = REMINDS, most: int = 400) -> Column:
    """A short letter that only asks for an answer: no part number, table or quantity in it."""
    t = F.trim(F.coalesce(text, F.lit("")))
    low = X.norm(t)
    data = low.rlike(r"(^|[^\p{L}\d])[\p{L}]{2,}\d{3,}($|[^\p{L}\d])") | low.contains("артикул") | t.contains("|") | low.contains("кол-во")
    return (F.length(t) <= most) & X.contains_any(t, phrases) & ~data


def brand_ok(brand: Column, forbidden: Sequence[str]) -> Column:
    """A brand that is a short name with letters and holds none of the forbidden words."""
    b = X.clean_ws(brand)
    return (F.length(b).between(2, 40)) & b.rlike(r"\p{L}") & ~b.rlike(r"\d{5,}") & ~X.contains_any(b, forbidden)
