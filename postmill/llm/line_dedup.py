"""Line dedup over overlapping windows of three consecutive lines, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm.scratch import broadcast_if_small, materialize, release, text_key

WINDOW = 3
#: What names a document: its id and the key of its whole text.
DOCUMENT = ["id", "t1", "t2"]
#: Line numbers, and ROW_NUMBERS more a document, up to which the table of cuts is broadcast: some 30 MB.
BROADCAST_NUMBERS, ROW_NUMBERS = 4_000_000, 12


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def _windows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, t1, t2, at, cover, h1, h2): the document, the position, the covered lines and a 128-bit hash of each window of non-blank lines."""
    rows = docs.select(F.col(id_col).alias("id"), *text_key(F.col(text_col)), lines_of(F.col(text_col)).alias("lines")).where("id is not null and size(lines) >= 3")
    rows = rows.select(*DOCUMENT, F.transform("lines", lambda x: F.trim(x)).alias("lines"))
    rows = rows.select(*DOCUMENT, "lines", F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: F.get("lines", i) != "").alias("full")).where(f"size(full) >= {WINDOW}")

    def window(i: Column) -> Column:
        at = [F.get("full", i + k) for k in range(WINDOW)]
        text = [F.get("lines", x) for x in at]
        return F.struct(at[0].alias("at"), F.array(*at).alias("cover"), F.xxhash64(*text).alias("h1"), F.xxhash64(F.lit(1), *text[::-1]).alias("h2"))

    return rows.select(*DOCUMENT, F.inline(F.transform(F.sequence(F.lit(0), F.size("full") - WINDOW), window)))


def repeated_lines(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, t1, t2, lines): for each document that has some, the positions of the lines covered by later occurrences of a window.

    An occurrence is later if the same three lines begin at a smaller (id, t1, t2, position). Counting and the first
    occurrence are partial aggregates, so a window that a third of all documents share costs one row a task.
    """
    windows = materialize(spark, _windows(docs, id_col, text_col), "windows")
    place = F.struct(*DOCUMENT, "at")
    first = windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("final")).where("first < final")
    first = materialize(spark, first.select("h1", "h2", "first"), "repeated")
    later = windows.join(broadcast_if_small(first), ["h1", "h2"]).where(place > F.col("first"))
    cuts = later.select(*DOCUMENT, F.explode("cover").alias("line")).groupBy(*DOCUMENT).agg(F.collect_set("line").alias("lines"))
    cuts = materialize(spark, cuts, "cuts")
    release(spark, windows, first)
    return cuts


def dedup_lines(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the covered lines cut out of ``text_col``, and the columns n_lines and n_removed after the others.

    Lines end at ``\\n`` and are compared without surrounding spaces; blank lines belong to no window and stay. The first
    occurrence of a window, by id, then text key, then position, is not removed by that window, so the first copy of every
    line survives somewhere. A document is an id with a text: rows that repeat both are one document, and rows that repeat
    an id with another text are documents of their own. A null text stays null with 0 lines; texts of fewer than three
    lines, and rows with a null id, stay as they are. Other columns pass through, except that columns named n_lines or
    n_removed are replaced. An empty table gives an empty table.
    """
    cut = repeated_lines(spark, docs, id_col, text_col)
    n = cut.agg(F.sum(F.size("lines") + F.lit(ROW_NUMBERS))).first()[0] or 0
    few = F.broadcast(cut) if n <= BROADCAST_NUMBERS else cut  # else a shuffled join
    kept_columns = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    rows = docs.select(F.struct(*kept_columns).alias("row"), F.col(id_col).alias("id"), *text_key(F.col(text_col))).join(few, DOCUMENT, "left")
    lines = lines_of(F.col(f"row.{text_col}"))
    places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("lines"))
    shorter = F.when(F.col("lines").isNull(), F.col(f"row.{text_col}")).otherwise(F.array_join(F.transform(places, lambda i: F.get(lines, i)), "\n"))
    columns = [shorter.alias(c) if c == text_col else F.col(f"row.{c}").alias(c) for c in kept_columns]
    count = F.when(F.col(f"row.{text_col}").isNull(), 0).otherwise(F.size(lines))
    return rows.select(*columns, count.cast("long").alias("n_lines"), F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_removed"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` without the covered lines; a document that loses all its text goes; n_chars, if there, follows the text.

    Rows that lose no line stay as they are, with null, empty and blank texts and null ids. Documents are told apart as in
    ``dedup_lines``; columns that ``docs`` has more pass through. An empty table gives an empty table.
    """
    out = dedup_lines(spark, docs).where("n_removed = 0 or trim(both ' \n' from text) <> ''")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(docs.columns)
