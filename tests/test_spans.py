"""Spans against a plain search of the text, and the chain from letter to case on odd letters."""

import random
import re

from pyspark.sql import functions as F

from postmill.operators import spans as S
from postmill.plans import classifier as C

RULES = [
    S.Extractor("n", S.LABEL, r"(?:q|qty)[: ]+(\d+)", 100), S.Extractor("n", S.GUESS, r"(\d+) ?pc", 40, leading=True), S.Extractor("n", S.GUESS, r"\d+", 10, 0), S.Extractor("n", S.BAD, r"ticket|tel", 0, 0),
    S.Extractor("d", S.BLOCK, r"\d+[./]\d+[./]\d+", 60, 0), S.Extractor("w", S.GUESS, r"[a-z]+\d[a-z0-9]*", 60, 0), S.Extractor("w", S.BAD, r"mark", 0, 0),
]


def plain_spans(text):
    found = []
    for e in RULES:
        for m in re.finditer(e.pattern, text):
            a, b = m.span(e.group)
            found.append((e.field, e.kind, e.score, a, b, m.group(e.group)))
    bad = [s for s in found if s[1] == S.BAD]
    values = [s for s in found if s[1] != S.BAD]
    near = lambda s: any(x[0] == s[0] and x[4] <= s[3] and x[3] >= s[3] - S.NEAR for x in bad)
    values = [s for s in values if any(not near(x) for x in values if x[0] == s[0] and x[5].lower() == s[5].lower())]
    kept = []
    for s in sorted(values, key=lambda s: (-s[2], s[3] - s[4], s[3], s[0], s[1])):
        if all(k[4] <= s[3] or s[4] <= k[3] for k in kept):
            kept.append(s)
    return sorted(kept, key=lambda s: s[3])


def some_text(draw):
    words = ["q: 12", "qty 7", "5 pc", "33pc", "ticket", "tel", "mark", "12", "7", "1.2.2024", "12/5/7", "ab12", "x9", "mark ab12", "so far", "é", "12"]
    return " ".join(draw.choice(words) for _ in range(draw.randrange(0, 30)))


def test_spans_equal_plain_search(spark):
    draw = random.Random(2)
    texts = {i: some_text(draw) for i in range(150)} | {500: None, 501: "", 502: "12" * 3000, 503: "1.2.3 " * 700, 504: "q: 1\x01 2 pc"}
    rows = spark.createDataFrame([(i, t, 1, 2) for i, t in texts.items()], "id long, text string, t int, n int").repartition(5)
    got = S.settled(S.without_bad(S.found(rows, "id", F.col("text"), RULES))).collect()
    by = {}
    for r in got:
        by.setdefault(r.id, []).append((r.field, r.kind, r.score, r.start, r.end, r.value))
    want = {i: plain_spans((t or "").replace("\x01", " ")) for i, t in texts.items()}
    assert {i: sorted(v, key=lambda s: s[3]) for i, v in by.items()} == {i: v for i, v in want.items() if v}


def test_repeated_rows_and_ids(spark):
    rows = [(1, "q: 5 and 6"), (1, "q: 5 and 6"), (1, "7 pc"), (None, "q: 5")]
    out = S.settled(S.without_bad(S.found(spark.createDataFrame(rows, "id long, text string"), "id", F.col("text"), RULES)))
    assert sorted((r.id, r.start, r.value) for r in out.collect()) == [(1, 0, "7"), (1, 3, "5"), (1, 9, "6")]
    best = {r.n for r in S.chosen(out, ["n", "w"]).collect()}
    assert best == {"5", "7"}
    assert S.found(spark.createDataFrame([], "id long, text string"), "id", F.col("text"), RULES).count() == 0


LETTER = "id long, subject string, text string, direction string, buyer string, buyer_score double, first boolean, references array<string>, reply_to string, names array<string>, received timestamp"


def classified(spark, *letters):
    filled = [(k, "Письмо", text, "inbound_customer", "b1", 0.9, True, None, None, ["photo.jpg", "act.pdf"], None) for k, text in enumerate(letters)]
    out = C.classify(spark.createDataFrame(filled, LETTER), F.lit("2024-01-01").cast("timestamp"), [C.PORTAL])
    return {r.id: r for r in out.collect()}


def test_letters(spark):
    rows = classified(
        spark,
        None,
        "Возврат, брак. УПД 12345 от 01.02.2024. Артикул: QW-777. Кол-во: 3. Срок 05.06.2024",
        "Возврат, брак. УПД 12345, АРТИКУЛ: QW-777. Написано 01.02.2024, ждали 05.06.2024",
        "Возврат по заказу № 98765, брак",
        "Возврат по заказу № 98765, брак, акт: № 98765",
        "Возврат. Количество: 4, было 9 шт, цена 12,50 руб, тел. 8 (912) 345-67-89",
        "Недовоз, см. https://other.example.com/nondelivery/1",
        f"Недовоз, см. https://{C.PORTAL}/1",
        "x" * 200_000,
    )
    assert rows[0].event == "unknown" and rows[0].document_number is None and rows[0].state == "needs_review"
    assert (rows[1].document_number, rows[1].document_date, rows[1].part_number, rows[1].quantity, rows[1].ready, rows[1].state) == ("12345", "01.02.2024", "QW-777", "3", True, "ready_to_1c")
    assert rows[2].problems == ["date_not_anchored"] and not rows[2].ready and rows[2].part_number == "QW-777"
    assert rows[3].document_number is None and rows[4].document_number == "98765"
    assert (rows[5].quantity, rows[5].price) == ("4", "12,50")
    assert not rows[6].link_only and rows[7].link_only and rows[7].event == "shortage_link_event" and not rows[7].needs_ai
    assert rows[8].event == "unknown"


def test_split_document_cell(spark):
    cells = [("№ 81407 от 15.05.2026", "81407", "15.05.2026"), ("УТ-12/б 2024-01-02", "12/б", "2024-01-02"), ("12", None, None), (None, None, None)]
    df = spark.createDataFrame([(c,) for c, _, _ in cells], "c string").select("c", C.split_document_cell(F.col("c")).alias("x"))
    assert [(r.c, r.x.number, r.x.date) for r in df.collect()] == cells


def test_contexts_are_whole_however_often_a_value_stands_in_them(spark):
    from postmill.functions import evidence as E

    draw = random.Random(5)
    rows = [(k, draw.choice(["1", "12", "Ab", "x.", "", None]), "".join(draw.choice("1 2abAB x.") for _ in range(draw.randrange(0, 300))), draw.choice([None, "1 12 AB"])) for k in range(120)]
    rows.append((500, "1", "1 " * 3000, "y" * 9000 + "1" + "z" * 9000))
    df = spark.createDataFrame(rows, "id int, v string, a string, b string")
    got = E.occurrence_rows(df, ["id", "v"], "v", [("a", F.col("a")), ("b", F.col("b"))], r"\d", 30).where("at is not null").collect()
    want = []
    for k, v, *texts in rows:
        for name, text in zip("ab", texts):
            for m in re.finditer(re.escape(v), text or "", re.I) if v and v.strip() else ():
                # between the places of a value the value stands as it was asked
                head, tail = re.sub(re.escape(v), lambda _: v, text[: m.start()], flags=re.I)[-30:], re.sub(re.escape(v), lambda _: v, text[m.end() :], flags=re.I)[:30]
                if not re.search(r"\d$", head) and not re.match(r"\d", tail):
                    want.append((k, name, head, tail))
    assert sorted((r.id, r.source, r.before, r.after) for r in got) == sorted(want)


def test_a_pattern_passes_a_text_once(spark):
    texts = spark.createDataFrame([(1, "Version 12, of 1999: 3,50 12 boxes a$b 7")], "k long, t string")
    out = S.found(texts, "k", F.col("t"), C.TOKENS)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract" not in plan and plan.count("regexp_replace(") == len(C.TOKENS)
    assert ("year", 15, 19, "1999") in {(r.field, r.start, r.end, r.value) for r in out.collect()}


def test_fields_of_a_text_are_those_of_its_settled_spans(spark):
    draw = random.Random(7)
    texts = {i: some_text(draw) for i in range(150)} | {500: None, 501: "", 502: "12" * 3000, 503: "1.2.3 " * 700, 504: "q: 1\x01 2 pc", 505: "İİ qty 7"}
    hinted = [S.Extractor(e.field, e.kind, e.pattern, e.score, e.group, e.leading, needs=("q",) if e.pattern.startswith("(?:q") else ()) for e in RULES]
    rows = spark.createDataFrame(list(texts.items()), "id long, text string").repartition(5)
    read = rows.select("id", S.fields_of(F.col("text"), hinted, ["n", "w"]).alias("r"))
    assert "Exchange" not in read._jdf.queryExecution().executedPlan().toString().split("ArrowEvalPython")[0]
    got = {r.id: {f: (r.r[f].value, r.r[f].n, r.r[f].labelled) for f in ("n", "w")} for r in read.collect()}
    settled = S.settled(S.without_bad(S.found(rows, "id", F.col("text"), RULES)))
    best = {r.id: r for r in S.chosen(settled, ["n", "w"]).collect()}
    spans = settled.collect()
    for i in texts:
        for f in ("n", "w"):
            mine = [s for s in spans if s.id == i and s.field == f and s.kind != S.BLOCK]
            assert got[i][f] == (best[i][f] if i in best else None, len({s.value for s in mine}), any(s.kind == S.LABEL for s in mine))


def test_letters_are_read_without_an_exchange(spark):
    rows = spark.createDataFrame([(1, "Письмо", "УПД № AB1 от 01.02.2024, КОД ТОВАРА: Qw-777, HTTPS://x.y/Z", "inbound_customer", "b1", 0.9, True, None, None, None, None)], LETTER)
    out = C.classify(rows, F.lit("2024-01-01").cast("timestamp"), [C.PORTAL])
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    got = out.first()
    assert (got.document_number, got.document_date, got.part_number) == (None, "01.02.2024", "Qw-777")
