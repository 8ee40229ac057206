"""HTML mail as columns: text, links, table rows; JSON helpers."""

from __future__ import annotations

import html
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType


#: What column headers of product tables mean, by lower-case header.
HEADERS = {
    "артикул": "part_number", "код": "part_number", "part": "part_number", "part number": "part_number", "номенклатура": "product_name",
    "наименование": "product_name", "товар": "product_name", "name": "product_name", "product": "product_name", "кол-во": "quantity",
    "количество": "quantity", "qty": "quantity", "quantity": "quantity", "цена": "price", "price": "price", "документ": "document",
    "накладная": "document", "document": "document", "причина": "reason", "reason": "reason",
}
ITEM = "array<map<string,string>>"
SECRET = r"(?i)(password|passwd|token|secret|api[_-]?key|authorization)"


@F.pandas_udf(StringType())
def unescape(texts: pd.Series) -> pd.Series:
    """Character references decoded; Spark has no function for them."""
    return texts.map(lambda t: html.unescape(t) if isinstance(t, str) else None)


def strip_tags(x: Column) -> Column:
    """Text of HTML: scripts, styles and comments out, cells parted by bars, blocks by line ends, tags removed; references stay."""
    t = F.regexp_replace(F.coalesce(x, F.lit("")), r"(?is)<(script|style|head)\b.*?</\1\s*>|<!--.*?-->", " ")
    t = F.regexp_replace(t, r"[\r\n\t ]+", " ")
    t = F.regexp_replace(t, r"(?i)</t[dh]\s*>\s*<t[dh]\b[^>]*>", " | ")
    t = F.regexp_replace(t, r"(?i)<br\b[^>]*>|</(p|div|tr|li|h[1-6]|table|ul|ol)\s*>", "\n")
    t = F.regexp_replace(t, r"<[^>]*>", "")
    t = F.regexp_replace(F.regexp_replace(t, r"[ ]*\n[ ]*", "\n"), r"\n{2,}", "\n")
    return F.regexp_replace(t, r"^[ \n]+|[ \n]+$", "")


def html_to_text(x: Column) -> Column:
    return unescape(strip_tags(x))


def visible_body(x: Column) -> Column:
    """The text before the first header of quoted mail."""
    quote = r"(?imu)^\s*(-{2,}\s*(original message|исходное сообщение|пересылаемое сообщение)|from:|от:|.{0,80}(wrote|написал\(а\)|пишет):\s*$)"
    return F.regexp_replace(F.try_element_at(F.split(F.coalesce(x, F.lit("")), quote, 2), F.lit(1)), r"^\s+|\s+$", "")


def quote_markers(x: Column) -> Column:
    return F.regexp_count(F.coalesce(x, F.lit("")), F.lit(r"(?imu)^\s*(from:|от:|>|.{0,80}(wrote|написал\(а\)|пишет):)"))


def links(x: Column, most: int | None = 20) -> Column:
    """The first distinct http links of a text, in order; with ``most`` None all of them."""
    found = F.array_distinct(F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(r"https?://[^\s\"'<>]+"), 0))
    return found if most is None else F.slice(found, 1, most)


def _references(x: Column) -> Column:
    """The common character references decoded in columns; &amp; last."""
    for name, char in (("nbsp", " "), ("#160", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("laquo", "«"), ("raquo", "»"), ("mdash", "—"), ("ndash", "–"), ("amp", "&")):
        x = F.replace(x, F.lit(f"&{name};"), F.lit(char))
    return x


def table_rows(x: Column) -> Column:
    """array<array<string>>: the cells of each table row, tags removed."""
    rows = F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr\s*>"), 1)
    return F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]\s*>"), 1), lambda c: F.trim(_references(F.regexp_replace(c, r"<[^>]*>", "")))))


def _field_of(cell: Column) -> Column:
    """The field that a header of at most 40 characters names anywhere in it; the first listed one wins."""

    def named(low: Column) -> Column:
        out = F.lit(None).cast("string")
        for word, field in reversed(HEADERS.items()):
            out = F.when(low.contains(word), field).otherwise(out)
        return F.when(F.length(low).between(1, 40), out)

    return _let(F.lower(F.trim(cell)), named)


def product_items(rows: Column, most: int = 20) -> Column:
    """array<map<field, value>>: the rows below the first header row that has three known columns or more.

    Rows of another width are left out; a table with more rows than ``most`` is a layout table and gives its first row.
    """
    at_of = lambda fields: F.array_position(F.transform(fields, lambda f: F.size(F.array_compact(f)) >= 3), True).cast("int")
    empty = F.array().cast(ITEM)

    def items(t: Column) -> Column:
        rows, at, head = t["rows"], t["at"], t["head"]
        below = F.filter(F.slice(rows, at + 1, F.size(rows)), lambda r: F.size(r) == F.size(head))
        cells = lambda r: F.map_from_entries(F.filter(F.arrays_zip(head.alias("key"), r.alias("value")), lambda e, i: e["key"].isNotNull() & (F.array_position(head, e["key"]) == i + 1)))
        return _let(F.transform(below, cells), lambda x: F.when(F.size(x) > most, F.slice(x, 1, 1)).otherwise(x))

    def named(t: Column) -> Column:
        whole = F.struct(t["rows"].alias("rows"), t["at"].alias("at"), F.try_element_at(t["fields"], t["at"]).alias("head"))
        return F.when(t["at"] > 0, _let(whole, items)).otherwise(empty)

    fields = lambda r: F.struct(r.alias("rows"), F.transform(r, lambda x: F.transform(x, _field_of)).alias("fields"))
    return _let(rows, lambda r: _let(fields(r), lambda t: _let(F.struct(t["rows"].alias("rows"), t["fields"].alias("fields"), at_of(t["fields"]).alias("at")), named)))


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once: a lambda's variable, where a column would be computed again at each place."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def field_at(document: Column, path: str) -> Column:
    """The scalar at a dotted path of JSON text; null for invalid JSON."""
    return F.get_json_object(document, "$." + path)


def mask_secrets(document: Column) -> Column:
    """JSON text with the whole values of secret-like keys replaced, at any depth; text that is no JSON becomes null."""
    return _masked(document)


def _hide(value):
    if isinstance(value, dict):
        return {k: "***" if re.search(SECRET, k) else _hide(v) for k, v in value.items()}
    return [_hide(v) for v in value] if isinstance(value, list) else value


@F.pandas_udf(StringType())
def _masked(texts: pd.Series) -> pd.Series:
    def one(t):
        try:
            return json.dumps(_hide(json.loads(t)), ensure_ascii=False)
        except (TypeError, ValueError):
            return None

    return texts.map(one)


def _walk(value, key, out):
    if isinstance(value, dict):
        for k, v in value.items():
            if k == key and not isinstance(v, (dict, list)):
                out.append(str(v))
            _walk(v, key, out)
    elif isinstance(value, list):
        for v in value:
            _walk(v, key, out)


def values_for_key(document: Column, key: str) -> Column:
    """The scalar values of a key at any depth; Spark has no function for arbitrary depth."""

    @F.pandas_udf(ArrayType(StringType()))
    def found(texts: pd.Series) -> pd.Series:
        def one(t):
            out: list[str] = []
            try:
                _walk(json.loads(t), key, out)
            except (TypeError, ValueError):
                pass
            return out

        return texts.map(one)

    return found(document)


@F.pandas_udf(StringType())
def answer_json(texts: pd.Series) -> pd.Series:
    """The first balanced JSON object in a model's answer, thinking and fences left out; null if there is none."""

    def one(t):
        t = re.sub(r"(?s)<think>.*?</think>", "", t or "")
        for start in [m.start() for m in re.finditer(r"\{", t)]:
            try:
                return json.dumps(json.JSONDecoder().raw_decode(t[start:])[0], ensure_ascii=False, sort_keys=True)
            except ValueError:
                continue
        return None

    return texts.map(one)
