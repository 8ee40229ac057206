"""Is a processed value backed by the mail's own text? In Spark functions only.

Every evaluator gives struct(status, source, snippet, method, warnings). Texts are a list of (name of source, column), in
order of preference. Occurrences of a value become rows, are judged one by one and reduced to a row an id by partial
aggregates; ids are distinct. A text is cut at its value once; contexts are whole, however often the value stands in them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions import text as X
from postmill.functions.markup import table_rows
from postmill.operators.spans import held

#: Patterns of labels and units, and words of columns, prices and documents.
QUANTITY_LABEL = r"(?:количеств[а-яё]*(?:\s+(?:претензи[ия]|возврата?))?|кол-во|кол\.|к-во|qty|quantity)"
PIECE_UNIT = r"(?:шт\.?|штук[аи]?|ед\.|pcs)"
PART_LABEL = r"(?:арт(?:икул)?\.?|код(?:\s+товара)?|номенклатура|sku|part\s*number)"
QUANTITY_COLUMNS = ["количество", "кол-во", "qty", "quantity"]
PART_COLUMNS = ["артикул", "номенклатура", "код товара", "part number", "sku"]
REASON_COLUMNS = ["причина", "reason", "тип возврата"]
PRICE_WORDS = ["цена", "стоимость", "сумма", "итого", "руб", "ндс"]
DOCUMENT_WORDS = ["упд", "счет-фактур", "накладн", "накл", "реализац", "торг-12", "invoice", "waybill", "с/ф", "документ", "отгружен"]
CLAIM_WORDS = ["претензи", "заявк", "обращени", "рекламац", "claim", "request", "ticket"]
#: Status by the label that is nearest to a document number.
DOCUMENT_STATUS = [("упд", "confirmed_by_upd_context"), ("счет-фактур", "confirmed_by_invoice_context"), ("с/ф", "confirmed_by_invoice_context"), ("invoice", "confirmed_by_invoice_context"), ("накл", "confirmed_by_waybill_context"), ("торг-12", "confirmed_by_waybill_context"), ("waybill", "confirmed_by_waybill_context"), ("реализац", "confirmed_by_realization_context")]

#: Characters around a phrase of a kind in which a phrase of another kind is a conflict.
NEAR_KINDS = 160
_BETWEEN = r"\s*[:=—| -]*\s*"
Texts = Sequence[tuple[str, Column]]


def _finding(status, source="none", snippet="", method="", warnings: Sequence = ()) -> Column:
    """The common shape of a result; arguments are columns or plain text."""
    some = lambda x: x if isinstance(x, Column) else F.lit(x)
    listed = F.array(*map(some, warnings)) if warnings else F.array().cast("array<string>")
    return F.struct(some(status).alias("status"), some(source).alias("source"), some(snippet).alias("snippet"), some(method).alias("method"), listed.alias("warnings"))


def _staged(rows: DataFrame, out: str, steps: dict[str, Column], verdict: Column) -> DataFrame:
    """``rows`` with ``out``: each step is a column of its own first, so that what is used often is computed once."""
    for name, column in steps.items():
        rows = held(rows.withColumn(name, column), name)
    return rows.withColumn(out, verdict).drop(*steps)


def occurrences(texts: Texts, value: Column, edge: str, radius: int = 110) -> Column:
    """array<struct<source, before, after>>: the context of each occurrence of a value that no character of ``edge`` touches."""
    found = []
    for name, text in texts:
        pieces = F.split(F.coalesce(text, F.lit("")), F.concat(F.lit(r"(?iu)\Q"), value, F.lit(r"\E")), -1)
        # neighbours side by side, as a lambda would split the text again for each of its elements
        n = F.size(pieces)
        none = F.lit(None).cast("string")
        back = lambda k, p=pieces, n=n: F.concat(F.array_repeat(none, F.least(F.lit(k), n - 1)), F.slice(p, 1, F.greatest(n - 1 - k, F.lit(0))))
        ahead = lambda k, p=pieces, n=n: F.concat(F.slice(p, F.least(F.lit(k), n) + 1, F.greatest(n - k, F.lit(0))), F.array_repeat(none, F.least(F.lit(k - 1), n - 1)))
        before = F.zip_with(F.zip_with(back(2), back(1), _joined(value)), back(0), _joined(value))
        after = F.zip_with(F.zip_with(ahead(1), ahead(2), _joined(value)), ahead(3), _joined(value))
        found.append(F.zip_with(before, after, _around(name, radius)))
    every = F.filter(F.concat(*found), lambda o: ~o["before"].rlike(rf"[{edge}]\z") & ~o["after"].rlike(f"^[{edge}]"))
    return F.when(F.length(F.trim(value)) > 0, every).otherwise(F.slice(every, 1, 0))


def _joined(value: Column):
    return lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.concat(a, value, b))


def _around(name: str, radius: int):
    return lambda a, b: F.struct(F.lit(name).alias("source"), F.right(a, F.lit(radius)).alias("before"), F.substring(b, 1, radius).alias("after"))


def nearest(context: Column, phrases: Sequence[str], from_end: bool) -> Column:
    """struct(distance, phrase) of the phrase nearest to the end, or to the start, of a context; null if it holds none. Signs stay signs: # and № are no letters of a phrase."""
    text = F.regexp_replace(X.clean_ws(F.translate(X.norm(context), "ё", "е")), r"^\p{Zs}+|\p{Zs}+\z", "")
    if from_end:
        at = [(F.locate(p[::-1], F.reverse(text)), p) for p in phrases]
    else:
        at = [(F.locate(p, text), p) for p in phrases]
    return F.array_min(F.array_compact(F.array(*[F.when(n > 0, F.struct((n - 1).alias("distance"), F.lit(p).alias("phrase"))) for n, p in at])))


def nearest_phrase(occurrence: Column, phrases: Sequence[str]) -> Column:
    """struct(distance, phrase) of the phrase nearest to an occurrence, on either side; null without any."""
    return F.array_min(F.array_compact(F.array(nearest(occurrence["before"], phrases, True), nearest(occurrence["after"], phrases, False))))


def contexts(text: Column, value: Column, radius: int = 80) -> Column:
    """array<string>: all contexts of a value in a text, white space folded."""
    return F.transform(occurrences([("text", text)], value, r"\p{L}\p{N}", radius), lambda o: X.clean_ws(F.concat(o["before"], value, o["after"])))


def rows_of(html: Column, text: Column) -> Column:
    """array<array<string>>: the cells of HTML table rows, then of lines with two bars or more; normalised."""
    barred = F.coalesce(F.when(F.contains(text, F.lit("|")), text), F.lit(""))  # other texts are not cut into lines
    lines = F.filter(F.split(barred, r"\r?\n"), lambda line: F.length(F.regexp_replace(line, r"[^|]", "")) >= 2)
    every = F.concat(table_rows(html), F.transform(lines, lambda line: F.split(line, r"\|")))
    return F.transform(every, lambda r: F.transform(r, X.evidence_norm))


def cells_under(rows: Column, names: Sequence[str]) -> Column:
    """array<struct<cell, row, under>>: every cell of a row that is no header, and whether the last header row above it names its column."""
    named = lambda cell: X.contains_any(cell, names)
    line, cells = "array<string>", "array<struct<cell:string,row:array<string>,under:boolean>>"
    start = F.struct(F.array().cast(line).alias("head"), F.array().cast(cells).alias("out"))

    def step(done: Column, row: Column) -> Column:
        own = F.filter(F.zip_with(row, done["head"], lambda c, h: F.struct(c.alias("cell"), row.alias("row"), F.coalesce(named(h), F.lit(False)).alias("under"))), lambda x: x["cell"].isNotNull())
        header = F.struct(row.cast(line).alias("head"), done["out"].alias("out"))
        return F.when(F.exists(row, named), header).otherwise(F.struct(done["head"].alias("head"), F.concat(done["out"], own.cast(cells)).alias("out")))

    return F.aggregate(rows, start, step, lambda done: done["out"])


def _number(x: Column) -> Column:
    return F.regexp_replace(F.trim(x), ",", ".").try_cast("double")


def occurrence_rows(rows: DataFrame, keep: Sequence[str], value: str, texts: Texts, edge: str, radius: int = 110, repeats: bool = False) -> DataFrame:
    """(``keep``, at, source, before, after): a row for each place of the column ``value`` in the texts that no character of ``edge`` touches.

    ``at`` orders the places of a row; a text without one gives a row with a null ``at``. Case is ignored; an empty or null
    value is nowhere. What ends the line before does not touch a value (\\z, as $ would look past a line end). Contexts have up to ``radius`` characters on each side.
    With ``repeats`` a value that stands directly beside itself is not touched by that.
    """
    v = F.col(value)
    every = F.array(*[F.struct(F.lit(k).alias("_k"), F.lit(name).alias("source"), F.coalesce(text, F.lit("")).alias("_text")) for k, (name, text) in enumerate(texts)])
    # of a long piece only its ends are in a context
    ends = lambda p: F.when(F.length(p) > 2 * radius, F.concat(F.left(p, F.lit(radius)), F.right(p, F.lit(radius)))).otherwise(p)
    pieces = F.when(F.length(F.trim(v)) > 0, F.transform(F.split("_text", F.concat(F.lit(r"(?iu)\Q"), v, F.lit(r"\E")), -1), ends))
    cut = held(rows.select(*keep, F.inline(every)).withColumn("_pieces", pieces), "_pieces")
    many = F.floor(F.lit(radius) / F.length(v)).cast("int") + 2  # pieces that a context can reach
    n = F.size("_pieces")

    def spot(i: Column) -> Column:
        begin = F.greatest(F.lit(1), i - many)
        before = F.right(F.call_function("array_join", F.slice("_pieces", begin, i - begin + 1), v), F.lit(radius))
        own = [F.get("_pieces", i - 1).alias("left"), F.get("_pieces", i).alias("right")] if repeats else []
        return F.struct(before.alias("before"), F.left(F.call_function("array_join", F.slice("_pieces", i + 1, many), v), F.lit(radius)).alias("after"), *own)

    spots = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), spot))
    left, right = ("left", "right") if repeats else ("before", "after")
    free = F.filter(spots, lambda o: ~o[left].rlike(rf"[{edge}]\z") & ~o[right].rlike(f"^[{edge}]"))
    found = cut.select(*keep, "_k", "source", F.posexplode_outer(free).alias("_i", "_o"))
    return found.select(*keep, (F.col("_k").cast("long") * (1 << 32) + F.col("_i")).alias("at"), "source", "_o.before", "_o.after")


def _found(rows: DataFrame, id_col: str, value: Column, texts: Texts, edge: str, radius: int, repeats: bool = False, **more: Column) -> DataFrame:
    """(id, v, each of ``more``, at, source, before, after): a row an occurrence, or one with a null ``at`` for a text without one."""
    kept = rows.select(F.col(id_col).alias("id"), value.alias("v"), *[c.alias(k) for k, c in more.items()], *[t.alias(f"t{k}") for k, (_, t) in enumerate(texts)])
    named = [(name, F.col(f"t{k}")) for k, (name, _) in enumerate(texts)]
    return occurrence_rows(held(kept, "v", *more), ["id", "v", *more], "v", named, edge, radius, repeats)


def _verdicts(found: DataFrame, score: Column, method: Column, snippet: Column, conflict: Column | None = None) -> DataFrame:
    """(id, v, table, shape, n, best, clash, first): the best occurrence by score, the first in conflict, and the first of all."""
    one = F.struct(F.col("source"), snippet.alias("snippet"), method.alias("method"), score.alias("score"))
    judged = found.select("id", "v", "table", "shape", "at", one.alias("one"), (F.lit(False) if conflict is None else conflict).alias("conflict"))
    at = F.col("at")
    return judged.groupBy("id").agg(
        F.max("v").alias("v"), F.max("table").alias("table"), F.max("shape").alias("shape"), F.count("at").alias("n"), F.max_by(F.when(at.isNotNull(), F.col("one")), F.struct(F.coalesce("one.score", F.lit(-10_000)), -at)).alias("best"),
        F.min_by("one", F.when(F.col("conflict"), at)).alias("clash"), F.min_by("one", at).alias("first"),
    )


def _table_row(cells: Column) -> Column:
    """The text of the first row of matching cells; null without one."""
    return F.array_join(F.get(cells, F.lit(0))["row"], " | ")


def quantity_evidence(rows: DataFrame, id_col: str, value: Column, part: Column, product: Column, document: Column, texts: Texts, html: Column, label: str = QUANTITY_LABEL, unit: str = PIECE_UNIT) -> DataFrame:
    """(id, evidence) for a quantity: by a table's column, else a compact item line, part and quantity, a label, or a unit; conflicts of labels first.

    A number inside a date or telephone number, or beside words of prices, is no evidence without a label or unit.
    """
    number = _number(value)
    whole = F.when(number.isNull(), F.lit(None).cast("string")).when(number == F.floor(number), number.cast("long").cast("string")).otherwise(F.regexp_replace(F.trim(value), ",", "."))
    some = lambda x: F.coalesce(F.lower(F.trim(x)), F.lit(""))
    cell = lambda c: _number(F.regexp_extract(c["cell"], rf"(?iu)^\s*(\d+(?:[.,]\d+)?)\s*{unit}?\s*$", 1)) == number
    mine = lambda c: (F.length(some(part)) > 0) & F.exists(c["row"], lambda x: x.contains(some(part)))
    table = F.filter(cells_under(rows_of(html, texts[-1][1]), QUANTITY_COLUMNS), lambda c: F.coalesce(cell(c), F.lit(False)) & (c["under"] | mine(c)))
    found = _found(rows, id_col, whole, texts, r"\d.,", 110, table=_table_row(table), shape=F.lit(""), part=some(part), product=some(product), document=some(document))
    before, after, here = F.col("before"), F.col("after"), F.concat("before", "v", "after")
    labelled = before.rlike(rf"(?iu){label}{_BETWEEN}$")
    pieces = after.rlike(rf"(?iu)^\s*{unit}($|\W)") | (before.rlike(rf"(?iu){unit}{_BETWEEN}$") & ~before.rlike(rf"(?iu)\d\s*{unit}{_BETWEEN}$"))
    has_part = ((F.length("part") > 0) & F.lower(here).contains(F.col("part"))) | ((F.length("product") >= 4) & F.lower(here).contains(F.col("product")))
    named = F.size(F.array_distinct(F.regexp_extract_all(here, F.lit(rf"(?iu){label}{_BETWEEN}(\d+(?:[.,]\d+)?)"), 1)))
    fits = (labelled | pieces) & (F.col("document") != F.col("v"))
    kind = F.when(~fits, "").when(has_part & here.rlike(rf"(?iu){PART_LABEL}"), "compact_item_line").when(has_part, "part_quantity_pair").when(labelled, "quantity_label").otherwise("piece_unit")
    score = F.when(dangerous_number(before, after) & ~labelled & ~pieces, 0).otherwise(F.element_at(F.create_map(*[F.lit(x) for x in ("", 0, "compact_item_line", 50, "part_quantity_pair", 45, "quantity_label", 35, "piece_unit", 30)]), kind))
    j = _verdicts(found, score, kind, X.clean_ws(here), fits & (named > 1))
    weak = F.when(F.col("v") == "1", "quantity_1_without_context").otherwise("quantity_without_context")
    return j.select("id", (
        F.when(F.col("v").isNull(), _finding("missing_processed"))
        .when(F.length("table") > 0, _finding("confirmed_by_table_quantity_column", "table", F.col("table"), "table_quantity_column"))
        .when(F.col("n") == 0, _finding("not_found"))
        .when(F.col("clash").isNotNull(), _finding("conflict_quantity_candidates", F.col("clash.source"), F.col("clash.snippet"), "multiple_equal_context_candidates", ["quantity_multiple_candidates"]))
        .when(F.col("best.score") > 0, _finding(F.concat(F.lit("confirmed_by_"), "best.method"), F.col("best.source"), F.col("best.snippet"), F.col("best.method")))
        .otherwise(_finding("weak_number_without_quantity_context", F.col("first.source"), F.col("first.snippet"), "unlabeled_number", [weak]))
    ).alias("evidence"))


def dangerous_number(before: Column, after: Column, words: Sequence[str] = PRICE_WORDS) -> Column:
    """Whether the context makes a number part of a date or a telephone number, or a price."""
    dated = before.rlike(r"\d[/-]\z") | after.rlike(r"^[/-]\d")
    phone = before.rlike(r"\+?\d[\d\s()-]{4,}$") | after.rlike(r"^[\s()-]*\d[\d\s()-]{4,}")
    return dated | phone | X.contains_any(F.concat(before, after), words)


def part_shape(x: Column) -> Column:
    """What is wrong with a part number: missing, email, date, phone or short_numeric; empty if nothing. Digits alone are no telephone number."""
    v = X.clean_ws(x)
    return (
        F.when(F.length(v) == 0, "missing").when(v.contains("@"), "email").when(v.rlike(r"^\d{1,2}[./-]\d{1,2}[./-]\d{2,4}$"), "date")
        .when(v.rlike(r"^\+?\d[\d\s().-]{8,}$") & v.rlike(r"[+\s().-]"), "phone").when(v.rlike(r"^\d{1,5}$"), "short_numeric").otherwise("")
    )


def part_evidence(rows: DataFrame, id_col: str, value: Column, product: Column, quantity: Column, texts: Texts, html: Column, label: str = PART_LABEL, quantity_label: str = QUANTITY_LABEL, unit: str = PIECE_UNIT) -> DataFrame:
    """(id, evidence) for a part number: by a table's column, a label before it, a compact item line, or the product's name within 120 characters."""
    v, shape = X.clean_ws(value), part_shape(value)
    low, name = X.evidence_norm(v), X.evidence_norm(product)
    words = lambda c: F.size(F.filter(c["row"], lambda x: (x != low) & x.rlike(r"[a-zа-я]{3,}")))
    near = lambda c: (shape != "short_numeric") & ((words(c) >= 2) | ((F.length(name) > 0) & F.exists(c["row"], lambda x: x.contains(name))))
    table = F.filter(cells_under(rows_of(html, texts[-1][1]), PART_COLUMNS), lambda c: (c["cell"] == low) & (c["under"] | near(c)))
    found = _found(rows, id_col, v, texts, r"\p{L}\p{N}", 120, table=_table_row(table), shape=shape, product=name, amount=F.coalesce(F.trim(quantity), F.lit("")))
    odd, amount = F.col("shape").isin("phone", "date", "email"), F.col("amount")
    here = X.clean_ws(F.concat("before", "v", "after"))
    item = F.concat(F.lit(rf"(?iu)({quantity_label}[:=,—\s-]*\Q"), amount, F.lit(rf"\E([^\d]|$))|((^|[^\d])\Q"), amount, F.lit(rf"\E\s*{unit})"))
    danger = X.contains_any(here, DOCUMENT_WORDS + CLAIM_WORDS) & ~here.rlike(rf"(?iu){label}")
    kind = F.when(~odd & F.col("before").rlike(rf"(?iu){label}{_BETWEEN}\*?\s*$"), 3)
    kind = kind.when((F.col("shape") == "") & (F.length(amount) > 0) & F.regexp_like(here, item) & here.rlike(r"\p{L}{3,}") & ~danger, 2)
    kind = kind.when((F.col("shape") == "") & (F.length("product") > 0) & X.evidence_norm(here).contains(F.col("product")) & ~danger, 1).otherwise(0)
    method = F.element_at(F.array(*map(F.lit, ("", "product_context", "compact_item_line", "part_label"))), kind + 1)
    j = _verdicts(found, kind, method, here)
    warning = F.when(odd, F.concat(F.lit("part_number_looks_like_"), "shape")).when(F.col("shape") == "short_numeric", "part_number_short_numeric_without_label").otherwise("part_number_without_product_context")
    return j.select("id", (
        F.when(F.col("shape") == "missing", _finding("missing_processed"))
        .when(~odd & (F.length("table") > 0), _finding("confirmed_by_table_column", "table", F.col("table"), "table_column"))
        .when(F.col("n") == 0, _finding("not_found"))
        .when(F.col("best.score") > 0, _finding(F.concat(F.lit("confirmed_by_"), "best.method"), F.col("best.source"), F.col("best.snippet"), F.col("best.method")))
        .otherwise(_finding("weak_found", F.col("first.source"), F.col("first.snippet"), "", [warning]))
    ).alias("evidence"))


def document_evidence(rows: DataFrame, id_col: str, value: Column, date: Column, texts: Texts, positive: Sequence[str] = DOCUMENT_WORDS, negative: Sequence[str] = CLAIM_WORDS, dates: int = 15, repeats: bool = False) -> DataFrame:
    """(id, evidence) for a document number: by the nearest label within 90 characters; a nearer word of claims makes it a conflict.

    A label scores 100 less its distance, a date beside it ``dates`` more, and a word of claims nearer by more than eight
    characters the opposite; the best occurrence with a label decides. ``repeats``: as in ``occurrence_rows``.
    """
    v = X.clean_ws(value)
    bad = v.contains("@") | v.rlike(r"^(\d{1,2}[./-]\d{1,2}[./-]\d{2,4}|\d{4}-\d{1,2}-\d{1,2})$") | (v.rlike(r"^\+?\d[\d\s().-]{8,}$") & (F.length(F.regexp_replace(v, r"\D", "")) >= 10))
    found = _found(rows, id_col, v, texts, r"\p{L}\p{N}", 90, repeats, table=F.lit(""), shape=F.when(bad, "bad").otherwise(""), day=F.coalesce(F.lower(F.trim(date)), F.lit("")))
    sides = F.struct("before", "after")
    found = found.withColumns({"plus": nearest_phrase(sides, positive), "minus": nearest_phrase(sides, negative)})
    here, plus, minus = X.clean_ws(F.concat("before", "v", "after")), F.col("plus.distance"), F.col("minus.distance")
    dated = ((F.length("day") > 0) & F.lower(here).contains(F.col("day"))) | here.rlike(r"(^|\D)(\d{1,2}[./-]\d{1,2}[./-]\d{2,4}|\d{4}-\d{1,2}-\d{1,2})(\D|$)")
    claim = minus.isNotNull() & (plus.isNull() | (minus + 8 < plus))
    score = F.when(plus.isNotNull(), 100 - F.least(plus, F.lit(90))).otherwise(0) + F.when(dated, dates).otherwise(0) - F.when(claim, 100 - F.least(minus, F.lit(90))).otherwise(0)
    one = F.struct(F.col("source"), here.alias("snippet"), F.col("plus.phrase").alias("phrase"), (minus.isNull() | (plus <= minus + 8)).alias("clear"))
    j = found.select("id", "v", "shape", "at", one.alias("one"), plus.alias("plus"), minus.alias("minus"), score.alias("score")).groupBy("id").agg(
        F.max("v").alias("v"), F.max("shape").alias("shape"), F.count("at").alias("n"), F.min_by("one", "at").alias("first"),
        F.max_by("one", F.when(F.col("plus").isNotNull(), F.struct(F.col("score"), -F.col("at")))).alias("good"), F.min_by("one", F.when(F.col("minus").isNotNull(), F.struct("minus", "at"))).alias("wrong"),
    )
    status = F.lit(None).cast("string")
    for phrase, name in DOCUMENT_STATUS[::-1]:
        status = F.when(F.col("good.phrase").contains(phrase), name).otherwise(status)
    return j.select("id", (
        F.when(F.length("v") == 0, _finding("missing_processed"))
        .when(F.col("shape") == "bad", _finding("weak_no_document_context", warnings=["document_number_bad_shape"]))
        .when(F.col("n") == 0, _finding("not_found"))
        .when(F.col("good.clear"), _finding(F.coalesce(status, F.lit("confirmed_by_document_label")), F.col("good.source"), F.col("good.snippet"), "document_context"))
        .when(F.col("wrong").isNotNull(), _finding("conflict_claim_or_request_number", F.col("wrong.source"), F.col("wrong.snippet"), "negative_context", ["possible_claim_number_not_document_number"]))
        .otherwise(_finding("weak_no_document_context", F.col("first.source"), F.col("first.snippet"), "unlabeled_number", ["document_number_without_document_context"]))
    ).alias("evidence"))


def document_candidate(texts: Texts, positive: Sequence[str] = DOCUMENT_WORDS, negative: Sequence[str] = CLAIM_WORDS) -> Column:
    """The number that best follows a document label in the texts, by distance; null if none does."""
    token = r"(?:№|#|no\.?)?\s*([\p{L}\d][\p{L}\d./_-]{2,30})"
    found = []
    for _, text in texts:
        for phrase in positive:
            found.append(F.regexp_extract(F.coalesce(text, F.lit("")), rf"(?iu){phrase}[\p{{L}}]*[\s:№#.-]{{0,12}}{token}", 1))
    numbers = F.filter(F.array(*found), lambda v: v.rlike(r"\d") & ~v.rlike(r"^\d{1,2}[./-]\d{1,2}[./-]\d{2,4}$"))
    return F.get(numbers, F.lit(0))


def _holds(low: Column, phrases: Sequence[str]) -> Column:
    """How many of the phrases a text holds that is normal already, so that it is not normalised once a phrase."""
    return sum((low.contains(p.lower()).cast("int") for p in phrases), F.lit(0))


def kinds_found(text: Column, rules: dict[str, Sequence[str]]) -> Column:
    """array<string>: the kinds with a phrase in the text, in the order of the rules."""
    return F.array_compact(F.array(*[F.when(X.contains_any(text, phrases), kind) for kind, phrases in rules.items()]))


def kind_evidence(rows: DataFrame, out: str, value: Column, texts: Texts, html: Column, rules: dict[str, Sequence[str]], weak: Sequence[str] = (), labels: Sequence[str] = tuple(REASON_COLUMNS), contract: Sequence[str] = ()) -> DataFrame:
    """``out`` for a kind of claim: by the table's column of reasons, a labelled reason, conflicts, the supplier's phrases, or phrases in the text."""
    combined = F.concat_ws("\n", *[t for _, t in texts])
    cells = F.transform(F.filter(cells_under(F.col("_rows"), labels), lambda c: c["under"]), lambda c: F.struct(kinds_found(c["cell"], rules).alias("kinds"), F.array_join(c["row"], " | ").alias("snippet")))
    said = F.transform(F.regexp_extract_all(combined, F.lit(rf"(?iu)(?:{'|'.join(labels)})\s*[:=—| -]{{1,12}}([^\n\r]{{1,180}})"), 1), lambda s: F.struct(kinds_found(s, rules).alias("kinds"), X.clean_ws(s).alias("snippet")))
    some = lambda found: F.get(F.filter(found, lambda f: F.size(f["kinds"]) > 0), F.lit(0))
    steps = {"_rows": rows_of(html, texts[-1][1]), "_table": some(cells), "_label": some(said), "_low": X.norm(combined), "_kinds": F.array_compact(F.array(*[F.when(_holds(F.col("_low"), phrases) > 0, kind) for kind, phrases in rules.items()])), "_norm": F.when(F.array_contains("_kinds", value) & (F.size("_kinds") > 1), X.evidence_norm(combined))}  # what is near is asked for these alone
    return _staged(rows, out, steps, _kind(value, F.col("_table"), F.col("_label"), F.col("_kinds"), combined, rules, weak, contract))


def _kind(value: Column, table: Column, label: Column, every: Column, combined: Column, rules: dict[str, Sequence[str]], weak: Sequence[str], contract: Sequence[str]) -> Column:
    listed = F.array(*map(F.lit, rules))
    alone = lambda f: (F.size(f["kinds"]) == 1) & F.array_contains(f["kinds"], value)
    near = F.lit(False)
    for kind, phrases in rules.items():
        others = [q for k, ps in rules.items() if k != kind for q in ps if len(q) <= NEAR_KINDS]
        sides = [rf"\Q{p}\E[\s\S]{{0,{NEAR_KINDS - len(q)}}}\Q{q}\E|\Q{q}\E[\s\S]{{0,{NEAR_KINDS - len(q)}}}\Q{p}\E" for p in phrases for q in others]
        near = F.when(value == kind, F.col("_norm").rlike("|".join(sides)) if sides else F.lit(False)).otherwise(near)
    clash = lambda f, method: _finding("conflict_reason_detected", "table" if method == "table_reason_column" else "body", f["snippet"], method, ["claim_kind_conflict"])
    has = F.array_contains(every, value)
    return (
        F.when(F.coalesce(F.length(value), F.lit(0)) == 0, _finding("missing_processed"))
        .when(~F.array_contains(listed, value), _finding("weak_found", warnings=["claim_kind_without_explicit_evidence"]))
        .when(table.isNotNull() & alone(table), _finding("confirmed_by_table_reason_column", "table", table["snippet"], "table_reason_column"))
        .when(table.isNotNull(), clash(table, "table_reason_column"))
        .when(label.isNotNull() & alone(label), _finding("confirmed_by_reason_label", "body", label["snippet"], "reason_label"))
        .when(label.isNotNull(), clash(label, "reason_label_conflict"))
        .when((~has & (F.size(every) > 0)) | (has & (F.size(every) > 1) & near), _finding("conflict_reason_detected", "body", X.clean_ws(combined, 360), "conflict_detection", ["claim_kind_conflict"]))
        .when(_holds(F.col("_low"), contract) > 0, _finding("confirmed_by_supplier_contract", "body", X.clean_ws(combined, 360), "supplier_contract"))
        .when(has, _finding("confirmed_by_explicit_reason", "body", X.clean_ws(combined, 360), "explicit_reason"))
        .when(_holds(F.col("_low"), weak) > 0, _finding("weak_generic_refusal", "body", X.clean_ws(combined, 360), "generic_reason", ["claim_kind_generic_refusal"]))
        .otherwise(_finding("weak_found", warnings=["claim_kind_without_explicit_evidence"]))
    )


def buyer_evidence(sender: Column, mailbox: Column, parser: Column, pattern: Column, senders: Column, domains: Column, folders: Column) -> Column:
    """How a buyer is known: by sender, domain, import folder, parser, or pattern; the arrays are those of the buyer's own rule."""
    low, domain, box = X.evidence_norm(F.coalesce(sender, F.lit(""))), X.email_domain(sender), X.evidence_norm(F.coalesce(mailbox, F.lit("")))
    some = lambda x: F.length(F.trim(F.coalesce(x, F.lit("")))) > 0
    none = lambda a: F.coalesce(a, F.array().cast("array<string>"))
    within = lambda d: (domain == d) | domain.endswith(F.concat(F.lit("."), d))
    routed = F.exists(none(folders), lambda f: some(f) & box.contains(f)) | F.exists(none(domains), lambda d: some(d) & box.contains(d))
    return (
        F.when(F.exists(none(senders), lambda s: some(s) & low.contains(s)), _finding("confirmed_by_sender", "sender", sender, "configured_sender"))
        .when((F.length(domain) > 0) & F.exists(none(domains), lambda d: some(d) & within(d)), _finding("confirmed_by_domain", "from_domain", domain, "configured_domain"))
        .when(routed, _finding("confirmed_by_route", "import_route", mailbox, "route"))
        .when(some(parser), _finding("confirmed_by_parser", parser, "", "parser"))
        .when(some(pattern), _finding("confirmed_by_pattern", "pattern_detector", "", pattern))
        .otherwise(_finding("", "", ""))
    )


def mismatch_class(code: Column, found: Column, allowed: Column, relation: Column, routed: Column, by_pattern: Column) -> Column:
    """struct(class, severity, confirm) of a counterparty in the text that is not the buyer.

    An allowed one is known, by its relation; one that the import route names while the buyer rests on a pattern or parser
    is a dangerous conflict; any other is unknown.
    """
    shape = lambda kind, severity, ask: F.struct(F.lit(kind).alias("class"), F.lit(severity).alias("severity"), F.lit(ask).alias("confirm"))
    kin = F.lower(F.coalesce(relation, F.lit("")))
    return (
        F.when(allowed & (kin.contains("nested") | kin.contains("supplier")), shape("known_nested_counterparty", "info", True))
        .when(allowed & kin.contains("signature"), shape("known_signature", "info", False))
        .when(allowed, shape("known_alias", "info", False))
        .when((found != code) & routed & by_pattern, shape("dangerous_profile_conflict", "error", False))
        .otherwise(shape("unknown_mismatch", "warning", True))
    )


#: Words that make a date a document's date, and words that make it another one.
STRONG_DATE_WORDS = ["упд", "накладн", "счет-фактур", "документ", "реализац", "торг-12", "invoice"]
WEAK_DATE_WORDS = ["отправлено", "sent", "from:", "телефон", "до ", "срок", "напомина"]


def date_candidates(rows: DataFrame, id_col: str, texts: Texts, number: Column, strong: Sequence[str] = STRONG_DATE_WORDS, weak: Sequence[str] = WEAK_DATE_WORDS) -> DataFrame:
    """(id, value, score, source, strong): each distinct D.M.YYYY or ISO date of the texts with its best score.

    20 and 2 for each strong word up to 28, less 5 for each weak word up to 18; 3 for the subject, 5 for a table; 14 with
    the document's number beside it; 2 where it is written DD.MM.YYYY.
    """
    pattern = F.lit(r"(?<![\d.])(\d{1,2}[./-]\d{1,2}[./-]\d{4}|\d{4}-\d{1,2}-\d{1,2})(?![\d])")
    every = F.array(*[F.struct(F.lit(name).alias("name"), F.coalesce(text, F.lit("")).alias("text")) for name, text in texts])
    kept = rows.select(F.col(id_col).alias("id"), F.lower(F.trim(F.coalesce(number, F.lit("")))).alias("doc"), F.explode(every).alias("t"))
    written = kept.select("id", "doc", "t", F.explode(F.array_distinct(F.regexp_extract_all("t.text", pattern, 1))).alias("w"))
    written = written.select("id", "doc", "w", F.col("t.name").alias("name"), F.col("t.text").alias("text"))
    found = occurrence_rows(written, ["id", "doc", "w", "name"], "w", [("t", F.col("text"))], r"\d").where("at is not null")
    w, parts = F.col("w"), F.split("w", r"[./-]")
    iso = w.rlike(r"^\d{4}-")
    first, middle, last = (F.get(parts, F.lit(k)) for k in range(3))
    day = F.try_to_timestamp(F.concat_ws("-", F.when(iso, first).otherwise(last), F.lpad(middle, 2, "0"), F.lpad(F.when(iso, last).otherwise(first), 2, "0")), F.lit("yyyy-MM-dd"))
    found = held(found.withColumns({"value": F.date_format(day, "dd.MM.yyyy"), "here": X.evidence_norm(F.concat("before", "w", "after"))}), "value", "here")
    good, bad = _holds(F.col("here"), strong), _holds(F.col("here"), weak)
    score = F.when(good > 0, 20 + F.least(F.lit(8), 2 * good)).otherwise(0) - F.least(F.lit(18), 5 * bad) + F.when(F.col("name") == "subject", 3).when(F.col("name") == "table", 5).otherwise(0)
    score += F.when((F.length("doc") > 0) & F.col("here").contains(F.col("doc")), 14).otherwise(0) + F.when(w == F.col("value"), 2).otherwise(0)
    best = F.max(F.struct(score.alias("score"), F.col("name").alias("source"), (good > 0).alias("strong")))
    return found.where("value is not null").groupBy("id", "value").agg(best.alias("b")).select("id", "value", "b.*")


def repaired_dates(candidates: DataFrame) -> DataFrame:
    """(id, value, warning): the only best candidate of an id, if it has a strong word and 15 points or more; else why there is none."""
    levels = candidates.groupBy("id", "score").agg(F.count("*").alias("ties"), F.min("value").alias("value"), F.bool_and("strong").alias("strong"))
    top = levels.groupBy("id").agg(F.max(F.struct("score", "ties", "value", "strong")).alias("m"))
    warning = F.when(F.col("m.ties") > 1, "document_date_multiple_candidates").when((F.col("m.score") < 15) | ~F.col("m.strong"), "document_date_no_strong_context")
    return top.select("id", F.when(warning.isNull(), F.col("m.value")).alias("value"), warning.alias("warning"))


def date_anchored(date: Column, number: Column, text: Column, radius: int = 60) -> Column:
    """The date is written within ``radius`` characters of the number."""
    return F.exists(occurrences([("text", text)], number, r"\p{L}\p{N}", radius), lambda o: o["before"].contains(date) | o["after"].contains(date))
