"""Columns on literal rows."""

import datetime

import pytest
from pyspark.sql import functions as F

from postmill.functions import dates as D
from postmill.functions import markup as M
from postmill.functions import numbers as N
from postmill.functions import text as X
from postmill.operators import cases as C
from postmill.operators import tables as T
from postmill.plans import routing as R


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first().y


@pytest.mark.parametrize(
    "text, want",
    [("2024-03-05", "05.03.2024"), ("5.3.24", "05.03.2024"), ("05/03/2024", "05.03.2024"), ("5 марта 2024", "05.03.2024"), ("7 май 2023", "07.05.2023"), ("5-3-2024", "05.03.2024"), ("31.02.2024", "31.02.2024"), ("soon", "soon"), (None, None)],
)
def test_dates(spark, text, want):
    assert one(spark, D.normal_date(F.col("x")), text) == want


def test_dates_in_text_and_variants(spark):
    text = "from 01.02.2024 to 2024-02-03, again 01.02.2024, v1.2"
    assert one(spark, D.dates_in(F.col("x")), text) == ["01.02.2024", "2024-02-03"]
    assert one(spark, D.date_grounded(F.lit(datetime.date(2024, 2, 1)), F.col("x")), text) is True
    assert one(spark, D.date_grounded(F.lit(datetime.date(2025, 2, 1)), F.col("x")), text) is False


def test_year_week_counts_from_monday(spark):
    days = [datetime.date(2015, 1, 1) + datetime.timedelta(days=k) for k in range(0, 4000, 7)] + [datetime.date(y, m, d) for y in range(2015, 2026) for m, d in ((1, 1), (1, 4), (12, 31))]
    got = spark.createDataFrame([(d,) for d in days], "d date").select("d", D.year_week(F.col("d")).alias("w")).collect()
    assert all(r.w == r.d.strftime("%Y-W%W") for r in got)


def test_deadlines(spark):
    now, was = F.lit("2024-01-10 00:00:00").cast("timestamp"), F.lit("2024-01-01 00:00:00").cast("timestamp")
    at = lambda kind, event: str(one(spark, D.deadline(F.lit(kind), F.lit(event), was, now).cast("string"), None))
    assert at("defect", "new_return") == "2024-01-11 00:00:00" and at("odd", "new_return") == "2024-01-08 00:00:00"
    assert at("defect", "reminder") == "2024-01-10 04:00:00" and at("defect", "internal") == "None"
    left = lambda h, urgent=False, follow=False: one(spark, D.priority_by_hours(F.lit(float(h)), F.lit(urgent), F.lit(follow)), None)
    assert [left(-1), left(20), left(70), left(200), left(200, True), left(200, False, True)] == ["critical", "high", "medium", "normal", "critical", "medium"]
    assert one(spark, D.priority_by_hours(F.lit(None).cast("double"), F.lit(False), F.lit(True)), None) == "normal"
    assert [one(spark, D.retry_seconds(F.col("x")), n, "int") for n in (0, 1, 2, 5, 40)] == [300, 300, 600, 4800, 21600]


def test_text(spark):
    assert one(spark, X.subject_template(F.col("x")), "RE: Fwd: Возврат по накладной 12345678 от поставщика, the box №7") == "возврат накладной поставщика box"
    assert one(spark, X.clean_ws(F.col("x"), 10), "  a \n b   cccccccccccc") == "a b ccccc…"
    assert one(spark, X.email_domain(F.col("x")), "A B <a.b@Sub.Example.org>") == "sub.example.org"
    assert one(spark, X.addresses(F.col("x"), F.col("x")), "A@b.org, c.d@e.com") == ["a@b.org", "c.d@e.com"]
    assert [one(spark, X.query_type(F.col("x")), q) for q in ("<a@b>", "a@b.org", "x.1@host", "123", "AB-12/3", "1234-56", "hello world", " ")] == ["message_id", "email", "message_id", "numeric", "part_number", "text", "text", "unknown"]
    assert one(spark, X.identifier(F.col("x")), "№ 12-34 / Ё") == "n1234е"
    assert one(spark, X.around(F.col("x"), F.lit("needle"), 3), "some needle here") == "me needle he"
    assert one(spark, X.comment_for_export(F.col("x")), "call 1234567890") is None and one(spark, X.comment_for_export(F.col("x")), " fine  text ") == "fine text"
    assert one(spark, X.phrase_score(F.col("x"), ["Shortage", "broken", "none"]), "a SHORTAGE of broken things") == 2
    assert one(spark, X.safe_filename(F.col("x")), "a/b c?.txt") == "a_b_c_.txt" and one(spark, X.safe_filename(F.col("x")), "__.") == "event"


def test_numbers(spark):
    price = lambda v: tuple(one(spark, N.check_price(F.col("x")), v))
    assert price("1 200,50 руб.") == (1200.5, None) and price("0") == (None, "not_positive") and price("x") == (None, "has_letters") and price("20000000") == (None, "too_large")
    quantity = lambda v: tuple(one(spark, N.check_quantity(F.col("x")), v))
    assert quantity("12") == (12.0, None) and quantity("12 шт.") == (12.0, None) and quantity("два") == (None, "has_letters") and quantity("1001") == (None, "too_large")
    document = lambda v: one(spark, N.check_document_number(F.col("x")), v).error
    assert [document(v) for v in ("УТ-15", "abc", "01.02.2024", "", None, "1" * 41, "Фильтр 12")] == [None, "no_digit", "is_date", "missing", "missing", "too_long", "is_product"]
    shape = lambda v: one(spark, N.part_number_shape(F.col("x")), v)
    assert [shape(v) for v in ("AB-12", "", "a@b", "01.02.24", "+7 (900) 123-45-67", "12")] == [None, "missing", "email", "date", "phone", "short_numeric"]
    assert [one(spark, N.looks_like_price(F.col("x")), v) for v in ("1 200,50", "150.00", "12", "AB12")] == [True, True, False, False]
    assert one(spark, N.ratio(F.lit(1), F.lit(0)), None) is None and one(spark, N.percent(F.lit(1), F.lit(3)), None) == 33.33
    assert [one(spark, N.risk_bucket(F.col("x")), v, "int") for v in (20, 21, 80, 100)] == ["0-20", "21-50", "51-80", "81-100"]


HTML = "<html><style>x</style><p>Dear&nbsp;all,<br>see <b>below</b></p><table><tr><th>Part number</th><th>Name</th><th>Qty</th></tr><tr><td>A-1</td><td>Bolt &amp; nut</td><td>2</td></tr><tr><td>odd</td></tr></table></html>"


def test_html(spark):
    text = spark.createDataFrame([(HTML,)], "x string").select(M.html_to_text(F.col("x")).alias("y")).first().y
    assert text.split("\n") == ["Dear\xa0all,", "see below", "Part number | Name | Qty", "A-1 | Bolt & nut | 2", "odd"]
    items = one(spark, M.product_items(M.table_rows(F.col("x"))), HTML)
    assert items == [{"part_number": "A-1", "product_name": "Bolt & nut", "quantity": "2"}]
    layout = HTML.replace("<tr><td>odd</td></tr>", "<tr><td>1</td><td>2</td><td>3</td></tr>" * 30)
    assert len(one(spark, M.product_items(M.table_rows(F.col("x"))), layout)) == 1
    assert one(spark, M.product_items(M.table_rows(F.col("x"))), "no table") == []
    assert one(spark, M.links(F.col("x")), "http://a.b/c http://a.b/c <https://d.e>") == ["http://a.b/c", "https://d.e"]
    assert one(spark, M.visible_body(F.col("x")), "new text\nOn Monday X wrote:\n> old") == "new text"


def test_json(spark):
    doc = '{"a": {"b": "v", "token": "s3cret"}, "list": [{"b": 2}], "password": "x"}'
    assert one(spark, M.field_at(F.col("x"), "a.b"), doc) == "v" and one(spark, M.field_at(F.col("x"), "a.b"), "{bad") is None
    masked = lambda d: spark.createDataFrame([(d,)], "x string").select(M.mask_secrets(F.col("x")).alias("y")).first().y
    assert masked(doc) == '{"a": {"b": "v", "token": "***"}, "list": [{"b": 2}], "password": "***"}' and masked("{bad") is None
    assert masked('{"token": {"value": "hunter2"}, "secret": [["a"],["b"]]}') == '{"token": "***", "secret": "***"}'
    df = spark.createDataFrame([(doc,), ("{bad",), (None,)], "x string")
    assert [r.y for r in df.select(M.values_for_key(F.col("x"), "b").alias("y")).collect()] == [["v", "2"], [], []]
    answer = '<think>{"no": 1}</think> Sure: ```json\n{"b": 1, "a": {"c": 2}}\n``` bye }'
    assert [r.y for r in spark.createDataFrame([(answer,), ("none",)], "x string").select(M.answer_json(F.col("x")).alias("y")).collect()] == ['{"a": {"c": 2}, "b": 1}', None]


def test_dedup_identity(spark):
    key = C.canonical_key(F.col("m"), F.col("h"), F.lit("inbox"), F.col("u"))
    rows = [(1, " <A@b> ", "h1", "1"), (2, "<a@B>", "h1", "2"), (3, "<a@b>", "h2", "3"), (4, None, "h9", "4"), (5, " ", None, "5")]
    df = spark.createDataFrame(rows, "id long, m string, h string, u string").withColumn("key", key)
    assert [r.key for r in df.orderBy("id").collect()] == ["mid:<a@b>"] * 3 + ["raw:h9", "uid:inbox:5"]
    assert sorted(map(tuple, C.semantic_duplicates(df, "key", "h", "id").collect())) == [(3, 1)]
    exact = {r.first_id: (r.n, r.folders) for r in C.exact_duplicates(df, ["key", "h"], "id", "u").collect()}
    assert exact[1] == (2, ["1", "2"]) and len(exact) == 4
    assert one(spark, C.merge_folders(F.array(F.lit("a")), F.col("x")), "a") == ["a"]
    assert one(spark, C.merge_folders(F.lit(None).cast("array<string>"), F.col("x")), "b") == ["b"]


def test_links_and_merges(spark):
    rows = [(1, "s", "t"), (2, "s", None), (3, None, "t"), (4, None, None), (5, "s", "t")]
    df = spark.createDataFrame(rows, "id long, strong string, thread string")
    assert sorted(map(tuple, T.tiered_parent(df, df, ["strong", "thread"], "id", "id").collect())) == [(1, 1, 2), (2, 1, 1), (3, 2, 1), (5, 1, 1)]
    assert sorted(map(tuple, T.related(df, "strong", "id", 1).collect())) == [(1, 2, 1), (2, 1, 1), (5, 1, 1)]
    old, new = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n int"), spark.createDataFrame([("b", 5), (None, 7)], "k string, n int")
    merged = T.upsert(old, new, ["k"], {"n": F.coalesce("old.n", F.lit(0)) + F.coalesce("new.n", F.lit(0))})
    assert sorted(map(tuple, merged.collect()), key=str) == [("a", 1), ("b", 7), (None, 7)]
    assert [tuple(r) for r in T.zero_filled(T.count_by(old, "k"), "k", ["b", "z"]).orderBy("place").select("k", "n").collect()] == [("b", 1), ("z", 0)]


def test_routing(spark):
    assert one(spark, R.kind_vote(F.col("x")), "брак и дефект, не хватает") == "defect"
    assert one(spark, R.kind_vote(F.col("x")), "defect, broken") == "damage" and one(spark, R.kind_vote(F.col("x")), "hello") is None
    assert tuple(one(spark, R.inbox_bucket(F.col("x"), F.lit("возврат")), "Daily report")) == ("report", "subject")
    assert tuple(one(spark, R.inbox_bucket(F.col("x"), F.lit("прошу возврат")), "hi")) == ("return", "body")
    columns = "dup boolean, rep boolean, has boolean, event string, state string, link boolean, ai boolean, out string"
    rows = [(True, True, True, "new_return", "ready", False, False, None), (False, True, False, None, None, False, False, None), (False, False, False, None, None, None, None, None), (False, False, True, "reminder", "ready", False, False, None), (False, False, True, "new_return", "ready", False, False, "error"), (False, False, True, "new_return", "ready", False, False, None), (False, False, True, "new_return", "needs_review", True, True, None), (False, False, True, "new_return", "odd", None, None, None)]
    df = spark.createDataFrame(rows, columns)
    df = df.withColumn("bucket", R.top_bucket(*[F.col(c) for c in ("dup", "rep", "has", "event", "state", "link", "ai", "out")])["value"]).withColumn("route", R.route(F.col("bucket")))
    assert [r.bucket for r in df.collect()] == ["duplicate", "report", "no_case", "follow_up", "error", "ready", "needs_link", "other"]
    assert R.completeness(df, "bucket", R.BUCKETS).first().unaccounted == 0
    total = {r.level: r.n for r in R.rollup(df, "route", "bucket").where("level = 0").collect()}
    assert total == {0: len(rows)}
    gate = lambda m: one(spark, R.evidence_gate(F.col("x"), ["a", "b"]), m, "map<string,string>")
    assert tuple(gate({"a": "found", "b": "found"})) == (True, [], "strong") and tuple(gate({"a": "conflict"})) == (False, ["a:conflict", "b:missing"], "none")
    assert one(spark, R.strong_key(F.col("x"), F.lit(None).cast("string"), F.lit("D-1"), F.lit("P")), "Buyer") == "buyer|doc:d-1|part:p"
    assert one(spark, R.strong_key(F.col("x"), F.lit("C"), F.lit("D"), F.lit("P")), " ") is None


def test_outbox_is_idempotent(spark):
    cases = spark.createDataFrame([(1, [("a", 2)]), (2, [("a", 2), ("b", 1)])], "id long, items array<struct<part:string,amount:int>>")
    events = C.outbox_events(cases, "id", "items", F.lit("ready"))
    assert events.count() == 3 and events.select("event_key").distinct().count() == 3
    assert C.append_new(events, events.limit(0)).count() == 3 and C.append_new(events, events).count() == 0


def test_ageing_and_periods(spark):
    df = spark.createDataFrame([("2024-01-01", "b", "a"), ("2024-05-01", "b", "a"), (None, "b", "a")], "d string, body string, att string").withColumn("d", F.to_timestamp("d"))
    out = C.age_out(df, F.col("d"), F.lit("2024-06-01").cast("timestamp"), 100, 10, "body", "att").collect()
    assert [(r.body, r.att) for r in out] == [(None, None), ("b", None), ("b", "a")]
    assert [r.y for r in df.select(C.outside_period(F.col("d"), "2024-02-01", "2024-12-31").alias("y")).collect()] == [True, False, True]


def test_headers_are_read_once_a_cell(spark):
    rows = spark.createDataFrame([([["Part", "Name", "Qty"], ["1", "nut", "2"]],), ([["a", "b"]],), (None,)], "r array<array<string>>")
    out = rows.select(M.product_items(F.col("r")).alias("x"))
    assert [r.x for r in out.collect()] == [[{"part_number": "1", "product_name": "nut", "quantity": "2"}], [], []]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("contains(") <= len(M.HEADERS)
