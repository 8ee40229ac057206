"""Dates, deadlines and periods. The present moment is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: First three letters of Russian months, in order.
MONTHS = ["янв", "фев", "мар", "апр", "мая", "июн", "июл", "авг", "сен", "окт", "ноя", "дек"]
#: Days to answer by kind of claim, and hours for follow-up events.
SLA_DAYS = {"defect": 10, "shortage": 3, "damage": 5, "wrong_item": 7, "surplus": 7}
SLA_DEFAULT_DAYS = 7
SLA_HOURS = {"reminder": 4, "supplier_decision": 4}


def _date(year: Column, month: Column, day: Column) -> Column:
    year = F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year)
    return F.try_to_timestamp(F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), F.lit("yyyy-MM-dd")).cast("date")


def parse_date(x: Column) -> Column:
    """A date from ISO, D.M.YYYY, D.M.YY, D/M/YYYY, D-M-YYYY or a day, Russian month word and year; null if there is none or it is not valid."""
    text = F.lower(F.trim(x))
    iso, dotted, words = r"^(\d{4})-(\d{1,2})-(\d{1,2})", r"^(\d{1,2})[./-](\d{1,2})[./-](\d{4}|\d{2})\b", r"^(\d{1,2})\s+(\p{L}+)\s+(\d{4})"
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.substring(F.regexp_extract(text, words, 2), 1, 3))
    month = F.when(F.regexp_extract(text, words, 2) == "май", 5).otherwise(month).cast("string")
    g = F.regexp_extract
    return F.when(text.rlike(iso), _date(g(text, iso, 1), g(text, iso, 2), g(text, iso, 3))).when(text.rlike(dotted), _date(g(text, dotted, 3), g(text, dotted, 2), g(text, dotted, 1))).when(text.rlike(words), _date(g(text, words, 3), month, g(text, words, 1)))


def normal_date(x: Column) -> Column:
    """DD.MM.YYYY where a date is found, else the text as it is."""
    return F.coalesce(F.date_format(parse_date(x), "dd.MM.yyyy"), x)


def dates_in(x: Column) -> Column:
    """The distinct numeric dates of a text, in order."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(r"\b\d{1,2}[./]\d{1,2}[./]\d{4}\b|\b\d{4}-\d{2}-\d{2}\b"), 0))


def date_variants(d: Column) -> Column:
    """The ways in which a date may be written."""
    return F.array(*[F.date_format(d, f) for f in ("dd.MM.yyyy", "d.M.yyyy", "dd.MM.yy", "yyyy-MM-dd", "dd/MM/yyyy")])


def date_grounded(d: Column, text: Column) -> Column:
    """Some variant of the date occurs in the text."""
    return F.exists(date_variants(d), lambda v: F.contains(text, v))


def year_week(ts: Column) -> Column:
    """Year and week of the year, weeks from Monday on, days before the first Monday in week 00."""
    week = F.floor((F.dayofyear(ts) + 6 - F.weekday(ts)) / 7)
    return F.concat(F.date_format(ts, "yyyy"), F.lit("-W"), F.lpad(week.cast("string"), 2, "0"))


def period(ts: Column, kind: str) -> Column:
    if kind == "week":
        return year_week(ts)
    return F.date_format(ts, {"day": "yyyy-MM-dd", "month": "yyyy-MM"}[kind])


def deadline(kind: Column, event_type: Column, received: Column, now: Column) -> Column:
    """Received time plus days by kind; for follow-up events now plus hours; none for internal mail."""
    days = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SLA_DAYS.items() for x in kv]), kind), F.lit(SLA_DEFAULT_DAYS))
    hours = F.try_element_at(F.create_map(*[F.lit(x) for kv in SLA_HOURS.items() for x in kv]), event_type)
    return F.when(event_type == "internal", F.lit(None).cast("timestamp")).when(hours.isNotNull(), now + F.make_dt_interval(hours=hours)).otherwise(received + F.make_dt_interval(days=days))


def hours_left(deadline_at: Column, now: Column) -> Column:
    return (F.unix_timestamp(deadline_at) - F.unix_timestamp(now)) / 3600.0


def priority_by_hours(left: Column, urgent: Column, followup: Column, critical: int = 4, warning: int = 24) -> Column:
    """critical, high, medium or normal by words, hours left and whether it follows up; without a deadline normal."""
    soon = max(72, 2 * warning)
    return F.when(urgent | (left <= critical), "critical").when(left <= warning, "high").when(left.isNotNull() & (followup | (left <= soon)), "medium").otherwise("normal")


def retry_seconds(attempt: Column, base: int = 300, most: int = 21600) -> Column:
    """Exponential backoff, at most six hours."""
    return F.least(base * F.pow(F.lit(2.0), F.greatest(attempt - 1, F.lit(0)).cast("double")), F.lit(float(most))).cast("long")


def internal_date(x: Column) -> Column:
    return F.try_to_timestamp(F.trim(x), F.lit("dd-MMM-yyyy HH:mm:ss Z"))
