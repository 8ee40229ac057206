"""Decisions, evidence, records and the work cycle on literal rows."""

import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from postmill.functions import evidence as E
from postmill.operators import records as O
from postmill.plans import casework as K
from postmill.plans import judged
from postmill.streaming import cycle, flows


def values(spark, column, texts, kind="string"):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], f"i int, x {kind}")
    return [r.y for r in rows.select("i", column.alias("y")).orderBy("i").collect()]


@pytest.fixture(autouse=True)
def column(spark):
    global X
    X = F.col("x")


def test_words_of_letters(spark):
    assert values(spark, K.marking_subcategory(X), ["Код ТН ВЭД не совпадает", "маркировка: исправьте в своей системе", "не подлежит маркировке", "коды маркировки неверны", "честный знак", "болт"]) == ["marking.tnved_mismatch", "marking.need_supplier_fix", "marking.not_required", "marking.code_mismatch", "marking.required", None]
    assert values(spark, K.kind_from_act(X), ["Мнение комиссии о причинах: пересорт | заключение: брак брак брак", "тип возврата | недостача", "Комментарий: излишек", "мнение комиссии: отказ клиента", "комментарий: скол на корпусе", "без акта брак", None]) == ["wrong_item", "shortage", "overdelivery", "quality_refusal", "defect", None, None]
    none, yes = F.lit(None).cast("string"), F.lit(True)
    kinds = values(spark, K.event_type(X, F.lit(""), F.lit(False), yes, F.lit("inbound_customer"), none, none, none, none)["value"], ["Прошу согласовать возврат", "График работы на праздники", "Прайс на сегодня", "акт сверки за май", "просто текст"])
    assert kinds == ["new_return", "info_only", "supplier_report", "followup_reminder", "unknown"]
    later = values(spark, K.event_type(X, F.lit("Re: a"), F.lit(True), F.lit(False), F.lit("inbound_customer"), none, none, none, none)["value"], ["повторно прошу", "возврат разрешен", "спасибо"])
    assert later == ["followup_reminder", "supplier_decision", "followup_dialog"]
    assert values(spark, K.pre_delivery_refusal(X, F.lit("new_return"), none), ["запрос на снятие", "запрос на снятие по УПД 5", "возврат"]) == [True, False, False]
    assert values(spark, K.contentless_reminder(X), ["Добрый день. Ожидаем ответ.", "Ожидаем ответ по AB1234", "Ожидаем ответ | 5", "x" * 500 + " ожидаем ответ", "возврат"]) == [True, False, False, False, False]
    assert values(spark, K.brand_ok(X, ["ооо"]), ["Bosch", "ООО Ромашка", "1", "12345678"]) == [True, False, False, False]


def test_proof(spark):
    names = [["act.pdf", "installation order.pdf", "removal.pdf"], ["photo.jpg"], [], ["заключение сервиса.pdf", "a.png"]]
    assert values(spark, K.defect_papers(X)["state"], names, "array<string>") == ["complete", "present_unverified", "absent", "partial"]
    links = F.array(F.lit("https://a.b/return/5"))
    got = values(spark, K.evidence_summary(X, links), names, "array<string>")
    assert [(g.photos, g.documents, g.has_photo, g.has_service_document) for g in got] == [(0, 3, False, True), (1, 0, True, True), (0, 0, False, True), (1, 1, True, True)]
    flags = values(spark, K.defect_flags(F.lit("defect"), K.evidence_summary(X, F.array().cast("array<string>")), F.lit(0)), names, "array<string>")
    assert [(f.missing, f.incomplete, f.complete) for f in flags] == [(False, False, True), (False, True, False), (True, False, False), (False, False, True)]
    assert values(spark, K.evidence_signals(X, F.array(F.lit("http://x.y/nondelivery/1"))), [["УПД 5.xlsx", "брак.jpg"], []], "array<string>") == [["defect_by_name", "shortage_by_name", "upd_document", "photo_evidence", "return_portal_link", "position_table"], ["shortage_by_name", "return_portal_link"]]
    assert values(spark, K.required_evidence(X), ["defect", "shortage", "quality_refusal"]) == [(True, True), (True, False), (False, False)]
    assert values(spark, K.defect_class(X, F.lit("defect"), F.lit(True)), ["confirmed_by_reason_label", "conflict_reason_detected", "weak_found"]) == ["confirmed_defect", "conflict_defect", "defect_rejected_by_evidence"]
    assert values(spark, K.asks_model(F.lit("b"), X), [["claim_kind"], ["photo"], []], "array<string>") == [True, False, False]


def evidence(spark, make, text, html="", **fields):
    rows = spark.createDataFrame([(1, text, html, *fields.values())], "id int, body string, html string, " + ", ".join(f"{k} string" for k in fields))
    return make(rows, *[F.col(k) for k in fields], [("body", F.col("body"))], F.col("html")).first().evidence


TABLE = "<table><tr><th>Артикул</th><th>Наименование</th><th>Количество</th></tr><tr><td>AB-12</td><td>Фильтр масляный</td><td>3 шт</td></tr></table>"


@pytest.mark.parametrize(
    "value, text, html, want",
    [
        ("3", "", TABLE, "confirmed_by_table_quantity_column"), ("3", "a | b | c\nартикул | имя | кол-во\nAB-12 | болт | 3", "", "confirmed_by_table_quantity_column"),
        ("2", "Количество: 2; цена 500", "", "confirmed_by_quantity_label"), ("2", "прислали 2 шт болтов", "", "confirmed_by_piece_unit"), ("2", "артикул AB-12 кол-во 2", "", "confirmed_by_compact_item_line"),
        ("2", "AB-12, 2 шт", "", "confirmed_by_part_quantity_pair"), ("5", "от 05.04.2024 и 5/04", "", "weak_number_without_quantity_context"), ("500", "цена 500 руб", "", "weak_number_without_quantity_context"),
        ("2", "кол-во 2; кол-во 7", "", "conflict_quantity_candidates"), ("9", "кол-во 2", "", "not_found"), ("", "кол-во 2", "", "missing_processed"), ("два", "два", "", "missing_processed"), (None, None, None, "missing_processed"),
    ],
)
def test_quantity(spark, value, text, html, want):
    make = lambda rows, value, part, texts, html: E.quantity_evidence(rows, "id", value, part, F.lit(""), F.lit(""), texts, html)
    got = evidence(spark, make, text, html, value=value, part="AB-12")
    assert got.status == want and (got.source != "none") == (want.startswith(("conf", "weak")) or "conflict" in want)


def test_part_and_document(spark):
    part = lambda rows, value, texts, html: E.part_evidence(rows, "id", value, F.lit("Фильтр масляный"), F.lit("2"), texts, html)
    asked = [("AB-12", "", TABLE), ("AB-12", "артикул: AB-12", ""), ("AB-12", "деталь AB-12 в количестве: 2", ""), ("AB-12", "Фильтр масляный AB-12", ""), ("AB-12", "претензия AB-12", ""), ("12", "код 12", ""), ("12", "про 12", ""), ("+7 900 123-45-67", "тел +7 900 123-45-67", ""), ("", "x", ""), ("ZZ", "нет", "")]
    assert [evidence(spark, part, t, h, value=v).status for v, t, h in asked] == ["confirmed_by_table_column", "confirmed_by_part_label", "confirmed_by_compact_item_line", "confirmed_by_product_context", "weak_found", "confirmed_by_part_label", "weak_found", "weak_found", "missing_processed", "not_found"]
    document = lambda rows, value, texts, html: E.document_evidence(rows, "id", value, F.lit(""), texts)
    asked = [("123", "УПД № 123 от 05.04.2024"), ("123", "накладная 123"), ("123", "счет-фактура 123"), ("123", "документ 123"), ("123", "претензия 123"), ("123", "письмо 123"), ("123", "заявка 99, " + "слово " * 20 + "УПД 123"), ("01.02.2024", "УПД 01.02.2024"), ("", "x"), ("9", "УПД 123")]
    got = [evidence(spark, document, t, value=v) for v, t in asked]
    assert [g.status for g in got] == ["confirmed_by_upd_context", "confirmed_by_waybill_context", "confirmed_by_invoice_context", "confirmed_by_document_label", "conflict_claim_or_request_number", "weak_no_document_context", "confirmed_by_upd_context", "weak_no_document_context", "missing_processed", "not_found"]
    assert values(spark, E.document_candidate([("b", X)]), ["УПД № 82669 от 1.2.2024", "заявка 5"]) == ["82669", None]


def test_kind_buyer_and_counterparties(spark):
    rules = {"defect": ["брак", "дефект"], "shortage": ["недостача"]}
    rows = spark.createDataFrame([(1, "defect", "Причина: брак"), (2, "defect", "Причина: недостача"), (3, "defect", "тут дефект"), (4, "defect", "недостача"), (5, "defect", "дефект и недостача"), (6, "odd", "x"), (7, None, "x"), (8, "defect", "отказ"), (9, "defect", "причина | шт | \nбрак | 1 | ")], "id int, kind string, body string")
    got = {r.id: r.e.status for r in E.kind_evidence(rows, "e", F.col("kind"), [("body", F.col("body"))], F.lit(""), rules, ["отказ"]).collect()}
    assert got == {1: "confirmed_by_reason_label", 2: "conflict_reason_detected", 3: "confirmed_by_explicit_reason", 4: "conflict_reason_detected", 5: "conflict_reason_detected", 6: "weak_found", 7: "missing_processed", 8: "weak_generic_refusal", 9: "confirmed_by_table_reason_column"}
    texts = lambda *x: F.array(*map(F.lit, x))
    none = F.lit(None).cast("string")
    found = E.buyer_evidence(X, F.lit("inbox/shop"), none, none, texts("boss@"), texts("shop.ru"), texts("nowhere"))["status"]
    assert values(spark, found, ["boss@x.y", "a@mail.shop.ru", "a@b.c"]) == ["confirmed_by_sender", "confirmed_by_domain", ""]
    seen = values(spark, E.mismatch_class(F.lit("a"), X, X == "nested", F.lit("nested supplier"), X == "route", F.lit(True)), ["nested", "route", "other"])
    assert [(s["class"], s.severity) for s in seen] == [("known_nested_counterparty", "info"), ("dangerous_profile_conflict", "error"), ("unknown_mismatch", "warning")]
    assert values(spark, E.contexts(X, F.lit("12"), 3), ["a 12 b, 12; 123"]) == [["a 12 b,", "b, 12; 1"]]
    assert values(spark, E.date_anchored(F.lit("01.02.2024"), F.lit("77"), X), ["УПД 77 от 01.02.2024", "77" + " x" * 60 + " 01.02.2024"]) == [True, False]


def test_filters_and_items(spark):
    assert values(spark, O.glob_like(X, "*\"state\": \"rea?y*"), ['{"State": "Ready"}', '{"state": "done"}', None]) == [True, False, False]
    assert values(spark, O.lacks(X, "Secret"), ["a SECRET", "b", None]) == [False, True, True]
    items = [[("A-1", 1), ("a1", 1), ("A-1", 2)], None]
    assert [None if v is None else len(v) for v in values(spark, O.distinct_items(X, ["part", "n"]), items, "array<struct<part:string,n:int>>")] == [2, None]
    assert values(spark, O.multi_item(X)["multi"], items, "array<struct<part:string,n:int>>") == [True, False]
    assert values(spark, O.first_item(X, "part"), items, "array<struct<part:string,n:int>>") == ["A-1", None]
    maps = [{"a": "", "b": "2"}, None]
    assert values(spark, O.first_filled(X, F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("9"))), maps, "map<string,string>") == [{"a": "1", "b": "2"}, {"a": "1", "b": "9"}]
    got = values(spark, O.inherited(X, F.create_map(F.lit("a"), F.lit("1"), F.lit("c"), F.lit("3")), ["a"]), maps, "map<string,string>")
    assert [(g.fields, g.taken) for g in got] == [({"a": "1", "b": "2"}, ["a"]), ({"a": "1"}, ["a"])]
    assert values(spark, O.ordered_distinct(X, F.array(F.lit("z"), F.lit("a"))), [["a", "", "b", None], None], "array<string>") == [["a", "b", "z"], ["z", "a"]]
    assert values(spark, O.accepted_draft(X, F.create_map(F.lit("a"), F.lit("weak"), F.lit("b"), F.lit("confirmed_x"))), maps, "map<string,string>") == [{"b": "2"}, None]
    links = values(spark, O.link_kinds(X, ["portal.x"], ["noise"]), [["http://portal.x/1", "http://noise/2", "http://a/b.pdf", "http://a/"]], "array<string>")[0]
    assert [x.kind for x in links] == ["portal", "file", "page"]
    assert values(spark, O.bad_value(X, "part_number"), ["AB-1", "a@b", "артикул", "http://x", "01.02.2024", ""]) == [False, True, True, True, True, False]
    clean = values(spark, O.sane({"part_number": X, "quantity": F.lit("3 шт")}), ["a@b", "AB-1"])
    assert [(c.cleaned, c.removed) for c in clean] == [({"quantity": "3 шт"}, ["part_number"]), ({"part_number": "AB-1", "quantity": "3 шт"}, [])]
    rows = spark.createDataFrame([('{"a": {"part": "AB1"}, "l": [{"note": "has ab1 in"}]}',), ("{bad",), (None,)], "x string")
    assert [(r.h.score, r.h.field) for r in rows.select(O.json_hits(X, "ab1", {"part": 90}).alias("h")).collect()] == [(130, "part"), (None, None), (None, None)]
    n = spark.range(20)
    assert [r.id for r in O.over_fetched(n, [F.desc("id")], 3, F.col("id") % 4 == 0).collect()] == [16, 12, 8]
    assert [r.id for r in O.ordered_by(n, "new", {"new": [F.desc("id")], "old": [F.col("id")]}, "old").limit(1).collect()] == [19]


def test_state_changes(spark):
    outbox = spark.createDataFrame([("a", "draft"), ("b", "draft"), ("c", "sent")], "event_key string, status string")
    assert {r.event_key: r.status for r in O.approved(outbox, outbox.where("event_key = 'a'").select("event_key")).collect()} == {"a": "new", "b": "draft", "c": "sent"}
    assert {r.status for r in O.approved(outbox, None).collect()} == {"new", "sent"}
    cases = spark.createDataFrame([(1, "x", "old"), (2, "y", "same")], "id int, other string, kind string")
    at = datetime.datetime(2024, 1, 1)
    log = spark.createDataFrame([(1, at, "kind", "a"), (1, at + datetime.timedelta(1), "kind", "new"), (2, at, "kind", "same")], "id int, ts timestamp, field string, value string")
    fixed, events = O.corrected(cases, log, "id", ["kind"])
    assert {r.id: (r.other, r.kind) for r in fixed.collect()} == {1: ("x", "new"), 2: ("y", "same")}
    assert [tuple(r) for r in events.collect()] == [(1, "kind", "old", "new")]
    files = spark.createDataFrame([(1,), (2,), (3,)], "mail_id int")
    kinds = spark.createDataFrame([(1, "spam"), (2, "spam"), (2, "new_return")], "mail_id int, event_type string")
    assert sorted(r.mail_id for r in O.without_junk(files, kinds, ["spam"]).collect()) == [2, 3]
    days = spark.createDataFrame([(1, at), (2, None)], "id int, at timestamp")
    assert {r.id: r.kept for r in O.window_split(days, F.col("at"), F.lit("2024-02-01").cast("timestamp")).collect()} == {1: False, 2: True}


def test_work_cycle_is_idempotent(spark, tmp_path):
    spark.createDataFrame([(k, "new_return" if k % 2 else "info_only") for k in range(10)], "case_id long, event_type string").repartition(5).write.parquet(f"{tmp_path}/mail")
    mail = lambda: flows.stream(spark, f"{tmp_path}/mail", 2)
    for checkpoint in ("one", "one", "two"):  # started again, and replayed from the start
        cycle.work_cycle(mail(), lambda df: df, F.col("event_type") == "new_return", F.lit("return_ready"), f"{tmp_path}/out", f"{tmp_path}/{checkpoint}")
    assert spark.read.parquet(f"{tmp_path}/out/outbox").count() == 5 and spark.read.parquet(f"{tmp_path}/out/outbox").select("event_key").distinct().count() == 5
    now = datetime.datetime(2024, 1, 1)
    sent = lambda df: df.select("event_key", F.lit(now).cast("timestamp").alias("at"), (F.col("case_id") > 3).alias("ok"))
    for checkpoint in ("d1", "d2"):
        cycle.deliver(flows.stream(spark, f"{tmp_path}/out/outbox/batch=[0]", 1).select("case_id", "event_key"), sent, f"{tmp_path}/attempts", f"{tmp_path}/{checkpoint}")
    outbox = spark.read.parquet(f"{tmp_path}/out/outbox").drop("batch")
    done = cycle.deliveries(outbox, spark.read.parquet(f"{tmp_path}/attempts").drop("batch"))
    assert set(r.status for r in done.collect()) <= {"sent", "retry", "new"}
    calls = spark.createDataFrame([(1000, 500, 2), (10, None, None)], "input_tokens long, output_tokens long, image_count long")
    entry = cycle.ledger_entry(calls, F.lit(0.5), F.lit(2.0), F.lit(0.1))
    assert [r.total_cost for r in entry.collect()] == [1.7, 0.005]
    cycle.append_lines(entry, f"{tmp_path}/ledger")
    cycle.append_lines(entry, f"{tmp_path}/ledger")
    assert spark.read.json(f"{tmp_path}/ledger").count() == 4
    cycle.text_report(spark.createDataFrame([("a", 2), ("b", 5)], "bucket string, n long"), "bucket", "n", f"{tmp_path}/report")
    lines = [r.value.split() for r in spark.read.text(f"{tmp_path}/report").collect()]
    assert lines == [["b", "5"], ["a", "2"], ["total", "7"]]
    table = spark.createDataFrame([(1, 10)], "id long, size long")
    manifest = cycle.comparison_export(table, spark.createDataFrame([(1, 5)], "mail_id long, case_id long"), table, table, f"{tmp_path}/export")
    assert {r.part: r.n for r in manifest.collect()} == {"mail": 1, "cases": 1, "attachments": 1, "outbox": 1}


def test_health_counts_parts_of_a_second(spark):
    at = [("a", 3600.0), ("b", 3600.000001), ("c", 86400.0), ("d", 86400.9), ("e", 10.5)]
    now = datetime.datetime(2024, 1, 30, 12, 0, 0, 200000)
    jobs = spark.createDataFrame([(k, now - datetime.timedelta(seconds=s), "running") for k, s in at], "k string, last_heartbeat_at timestamp, status string")
    got = {r.k: (r.status, r.possible_hang) for r in O.job_health(jobs, F.lit(now), 3600, 86400).collect()}
    assert got == {"a": ("running", False), "b": ("running", True), "c": ("running", True), "d": ("abandoned", True), "e": ("running", False)}


def test_line_ends_touch_nothing_and_bars_follow_labels(spark, tmp_path):
    texts = ["word\nAB1234 x", "some of | AB1234 x", "7\nAB1234 x", "AB1234x wordAB1234"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.status for r in judged.QUERIES["part_evidence"](spark, str(tmp_path)).collect()}
    rows = duckdb.execute(judged.SQL["part_evidence"].replace("FROM documents", f"FROM '{tmp_path}/documents.parquet/*.parquet'")).fetchall()
    assert got == {r[0]: r[1] for r in rows} == {0: "weak_found", 1: "confirmed_by_part_label", 2: "weak_found", 3: "weak_found"}
    seen = spark.createDataFrame([("of word\nAB1234",)], "text string").select(F.size(E.contexts(F.col("text"), F.lit("AB1234"))).alias("n"))
    assert seen.first().n == 1


def test_texts_are_normalised_where_kinds_may_clash_only(spark):
    rules = {"a": ["broken"], "b": ["missing"]}
    rows = spark.createDataFrame([(1, "a", "Broken  box, missing lid"), (2, "a", "broken" + " x" * 300 + " missing"), (3, "a", "broken"), (4, "b", "broken"), (5, "a", "x | y | z\nq | broken | 1")], "k int, v string, t string")
    out = E.kind_evidence(rows, "e", F.col("v"), [("body", F.col("t"))], F.lit(""), rules)
    got = {r.k: r.e.status for r in out.select("k", "e").collect()}
    assert got == {1: "conflict_reason_detected", 2: "confirmed_by_explicit_reason", 3: "confirmed_by_explicit_reason", 4: "conflict_reason_detected", 5: "confirmed_by_explicit_reason"}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "size(_kinds" in plan.split("AS _norm")[0].rsplit("CASE WHEN", 1)[1]


def test_numbers_are_judged_in_the_text_as_it_is(spark, tmp_path):
    far = " " + "x" * 30 + " "
    texts = [
        "of +1 (555) 555-2655 xxxxxxxx 51.180.45.146 the q", "de abcd able### 5551 x", "in 01-02-2020 the", "the 1234" + far + "de, 12341234 de", "the" + far + "7777 of" + far + "2020-1-5, 7777 de" + far + "of",
        "de\u00a0\u00a0\u00a0\u00a0\u00a0\u00a0\u00a0\u00a0\u00a0\u00a0 5552 the", "de" + "\u000b " * 9 + "5553 abcdef the", "x 12345678901 the", "5554\nthe", "text", "of,\u00a0\u3000 5556 abcdefg the",
    ]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.status for r in judged.QUERIES["document_evidence"](spark, str(tmp_path)).collect()}
    rows = duckdb.execute(judged.SQL["document_evidence"].replace("FROM documents", f"FROM '{tmp_path}/documents.parquet/*.parquet'")).fetchall()
    assert got == {r[0]: r[1] for r in rows}
    assert (got[0], got[1], got[2]) == ("conflict_claim_or_request_number", "conflict_claim_or_request_number", "confirmed_by_document_label")
