"""Numbers, their checks, costs and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Words of products, which no document number holds.
PRODUCT_WORDS = r"(?iu)фильтр|масло|колодк|диск|ремень|свеч|насос|подшипник|амортизатор|рычаг|датчик|комплект"


def parse_number(x: Column) -> Column:
    """A double from text with spaces and a decimal comma; null if it is none."""
    return F.expr("try_cast(null as double)") if x is None else F.regexp_replace(F.regexp_replace(F.trim(x), r"[\s ]", ""), ",", ".").try_cast("double")


def check_price(x: Column) -> Column:
    """(value, error): a price over 0 and up to 10 million, currency signs ignored."""
    bare = F.regexp_replace(F.lower(x), r"(руб\.?|rub|р\.|₽|eur|usd|[€$])", "")
    v = parse_number(bare)
    error = F.when(bare.rlike(r"\p{L}"), "has_letters").when(v.isNull(), "not_a_number").when(v <= 0, "not_positive").when(v > 10_000_000, "too_large")
    return F.struct(F.when(error.isNull(), v).alias("value"), error.alias("error"))


def check_quantity(x: Column) -> Column:
    """(value, error): a quantity over 0 and up to 1000; units of pieces are ignored, other letters rejected."""
    bare = F.regexp_replace(F.lower(x), r"(шт|pcs|ед)\.?", "")
    v = parse_number(bare)
    error = F.when(bare.rlike(r"\p{L}"), "has_letters").when(v.isNull(), "not_a_number").when(v <= 0, "not_positive").when(v > 1000, "too_large")
    return F.struct(F.when(error.isNull(), v).alias("value"), error.alias("error"))


def check_document_number(x: Column) -> Column:
    """(value, error): up to 40 characters, with a digit, not a date, and not a product's name."""
    v = F.trim(x)
    error = F.when(F.coalesce(F.length(v), F.lit(0)) == 0, "missing").when(F.length(v) > 40, "too_long").when(~v.rlike(r"\d"), "no_digit").when(v.rlike(r"^\d{1,2}[./-]\d{1,2}[./-](\d{4}|\d{2})$"), "is_date").when(v.rlike(PRODUCT_WORDS), "is_product")
    return F.struct(F.when(error.isNull(), v).alias("value"), error.alias("error"))


def part_number_shape(x: Column) -> Column:
    """What is wrong with a part number: missing, email, date, phone or short_numeric; null if nothing."""
    v = F.trim(x)
    return F.when(F.coalesce(F.length(v), F.lit(0)) == 0, "missing").when(v.contains("@"), "email").when(v.rlike(r"^\d{1,2}[./-]\d{1,2}[./-]\d{2,4}$"), "date").when(v.rlike(r"^\+?[78][\s(-]*\d{3}[\s)-]*\d{3}[\s-]*\d{2}[\s-]*\d{2}$"), "phone").when(v.rlike(r"^\d{1,3}$"), "short_numeric")


def looks_like_price(x: Column) -> Column:
    v = F.trim(x)
    return v.rlike(r"^\d{1,3}([\s ]\d{3})+([.,]\d{1,2})?$") | v.rlike(r"^\d{3,}[.,]\d{2}$")


def cost(prompt: Column, completion: Column, price_in: Column, price_out: Column, per: float = 1e6) -> Column:
    """Money for tokens at prices for each ``per`` tokens."""
    return (prompt * price_in + completion * price_out) / F.lit(per)


def tokens_or_estimate(reported: Column, chars: Column, chars_each: float = 3.3) -> Column:
    """The reported tokens; where there are none, an estimate from the characters."""
    return F.coalesce(F.nullif(reported, F.lit(0)), F.floor(chars / chars_each))


def ratio(part: Column, whole: Column, empty: float | None = None) -> Column:
    """part / whole; ``empty`` where whole is 0."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(empty))


def percent(part: Column, whole: Column) -> Column:
    return F.round(100.0 * ratio(part, whole, 0.0), 2)


def risk_bucket(score: Column) -> Column:
    return F.when(score <= 20, "0-20").when(score <= 50, "21-50").when(score <= 80, "51-80").otherwise("81-100")


def profile_confidence(seen: Column, structured: Column, ready: Column) -> Column:
    """How far a sender's profile is trusted, from what was seen of it; at most 0.7."""
    return F.least(F.lit(0.7), 0.18 + 0.07 * seen + 0.08 * structured + 0.05 * ready)
