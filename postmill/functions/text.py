"""Text columns: normalising, templates, phrases, keys."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no meaning in a subject line.
SUBJECT_STOP = ["для", "по", "от", "на", "the", "and", "for", "of", "with"]


def norm(x: Column) -> Column:
    """No-break spaces become spaces; lower case."""
    return F.lower(F.replace(x, F.lit("\u00a0"), F.lit(" ")))


def clean_ws(x: Column, limit: int | None = None) -> Column:
    """White space folded and trimmed; cut to ``limit`` characters, the last an ellipsis."""
    folded = F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " "))
    if limit is None:
        return folded
    return F.when(F.length(folded) > limit, F.concat(F.rtrim(F.substring(folded, 1, limit - 1)), F.lit("…"))).otherwise(folded)


def subject_template(x: Column, stop: Sequence[str] = SUBJECT_STOP, words: int = 8) -> Column:
    """A subject without reply marks, long numbers, punctuation and stop words: its first words of three letters or more."""
    plain = F.regexp_replace(norm(F.coalesce(x, F.lit(""))), r"^(\s*(re|fw|fwd|отв|пер)\s*:)+", " ")
    plain = F.regexp_replace(F.regexp_replace(plain, r"[0-9]{5,12}", " "), r"[^\p{L}\p{N}]+", " ")
    kept = F.filter(F.split(F.trim(plain), " "), lambda w: (F.length(w) > 2) & ~w.isin(*stop))
    return F.concat_ws(" ", F.slice(kept, 1, words))


def phrase_score(x: Column, phrases: Sequence[str]) -> Column:
    """How many of the phrases the text contains, both normalised."""
    text = norm(F.coalesce(x, F.lit("")))
    return sum((text.contains(p.lower()).cast("int") for p in phrases), F.lit(0))


def phrase_scores(x: Column, lists: dict[str, Sequence[str]]) -> Column:
    """struct, for each list, of what ``phrase_score`` gives for it; a text passes once, in Arrow, and is normalised once for all lists."""
    names, asked = list(lists), [[p.lower() for p in phrases] for phrases in lists.values()]

    @F.arrow_udf(f"struct<{','.join(f'`{name}`:int' for name in names)}>")
    def scores(texts: pa.Array) -> pa.Array:
        low = [(t or "").replace("\u00a0", " ").lower() for t in texts.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([sum([p in t for p in phrases]) for t in low], pa.int32()) for phrases in asked], names)

    return scores(x)


def contains_any(x: Column, phrases: Sequence[str]) -> Column:
    return phrase_score(x, phrases) > 0


def email_domain(x: Column) -> Column:
    """The domain after the last @; empty without one."""
    return F.lower(F.regexp_extract(F.coalesce(x, F.lit("")), r"@([\w.-]+)[^@]*$", 1))


def addresses(*headers: Column) -> Column:
    """All distinct addresses of the header columns, in order, in lower case."""
    joined = F.concat_ws(" ", *headers)
    return F.array_distinct(F.transform(F.regexp_extract_all(joined, F.lit(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+"), 0), F.lower))


def in_domain(domain: Column, wanted: str) -> Column:
    """The domain itself or one of its subdomains."""
    return (domain == wanted) | domain.endswith("." + wanted)


def stable_hash(x: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix + ":"), F.substring(F.sha1(F.coalesce(x, F.lit(""))), 1, 16))


def event_hash(payload: Column) -> Column:
    """20 hex digits over the compact JSON of a struct; the struct fixes the order of keys."""
    return F.substring(F.sha1(F.to_json(payload)), 1, 20)


def evidence_norm(x: Column) -> Column:
    """For comparing evidence: one kind of e, one number sign, folded spaces."""
    return clean_ws(F.regexp_replace(F.translate(norm(x), "ё", "е"), "[№#]", "n"))


def identifier(x: Column) -> Column:
    """Without spaces and separators, for comparing numbers of parts and documents."""
    return F.regexp_replace(evidence_norm(x), r"[\s\-_/.,:;]", "")


def snippet(x: Column, limit: int = 300) -> Column:
    return F.substring(F.trim(F.translate(F.coalesce(x, F.lit("")), "\r\n", "  ")), 1, limit)


def around(x: Column, value: Column, radius: int = 80, limit: int = 320) -> Column:
    """The text around the first occurrence of a value; empty if there is none."""
    at = F.locate(value, x) if isinstance(value, str) else F.position(value, x)
    start = F.greatest(at - radius, F.lit(1))
    cut = F.substring(x, start, F.least(at - start + F.length(value) + radius, F.lit(limit)))
    return F.when((at > 0) & (F.length(value) > 0), cut).otherwise("")


def safe_filename(x: Column) -> Column:
    """A text as a file name: other characters as _, no . or _ at its ends, at most 120; event if nothing is left."""
    clean = F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), r"[^\p{L}\p{N}._-]", "_"), r"^[._]+|[._]+$", "")
    return F.when(F.length(clean) > 0, F.substring(clean, 1, 120)).otherwise("event")


def query_type(x: Column) -> Column:
    """What a search string looks like: unknown if empty, numeric, message_id, email, part_number (letters and digits) or text."""
    q = F.trim(x)
    return (
        F.when(F.coalesce(F.length(q), F.lit(0)) == 0, "unknown")
        .when(q.rlike(r"@") & q.rlike(r"[<>]"), "message_id")
        .when(q.rlike(r"^[\w.+-]+@[\w-]+\.[\w.-]+$"), "email")
        .when(q.rlike(r"^[^\s@]+@[^\s@]+$"), "message_id")
        .when(q.rlike(r"^[0-9]+$"), "numeric")
        .when(q.rlike(r"^(?=.*[0-9])(?=.*\p{L})[\p{L}0-9._/-]{3,40}$"), "part_number")
        .otherwise("text")
    )


def label_for(code: Column, labels: dict[str, str]) -> Column:
    """A label from a fixed table; the code itself where it is not listed."""
    pairs = [F.lit(x) for kv in labels.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), code), code)


def comment_for_export(x: Column) -> Column:
    """A comment of at most 200 characters; null if it is mostly digits or holds a long run of them."""
    text = clean_ws(x, 200)
    digits = F.length(F.regexp_replace(text, r"\D", ""))
    bad = (F.length(text) == 0) | text.rlike(r"\d{9,}") | (2 * digits > F.length(text))
    return F.when(~bad, text)
