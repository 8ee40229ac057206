"""Benchmark decontamination: size-partitioned MinHash containment search, in DataFrame functions only.

A short item inside a long document has a Jaccard similarity near 0, which no banding of whole-document signatures can
find. So the sketch is of the item alone (containment MinHash): its minima under 24 hash orders, and a document is asked
which of them it holds, which estimates |item and document| / |item| whatever the document's length. Items are partitioned
by size: up to 24 shingles the sketch is the whole item and three quarters of it must be there; above that 3 of the 24
minima, which an item contained to three quarters misses once in 10^11. Candidates are verified by exact containment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm.scratch import broadcast_if_small, materialize, text_key

SHINGLE, MINIMA, NEEDED = 5, 24, 3
#: Size of all shingles of the items, in characters, up to which they are broadcast for the exact check.
BROADCAST_BYTES = 32 << 20


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def _grams(words: str, n: int, make) -> Column:
    """Each run of n words, as ``make`` of its words; null where there are fewer."""
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: make(*[F.get(words, i + k) for k in range(n)])))


def _hash(*words: Column) -> Column:
    return F.xxhash64(F.lit(len(words)), *words)


def _text(*words: Column) -> Column:
    return F.concat_ws(" ", *words)


def _item_grams(make) -> Column:
    """5-word shingles; of a shorter item the whole sequence."""
    out = _grams("words", SHINGLE, make)
    for n in range(1, SHINGLE):
        out = F.when(F.size("words") == n, _grams("words", n, make)).otherwise(out)
    return F.array_distinct(out)


def contaminated_pairs(spark: SparkSession, docs: DataFrame, items: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, item): every document and item with at least ``percent`` of the item's distinct shingles in the document.

    ``percent`` under 75 lowers the recall of the sketch. Null and wordless texts and null ids match nothing. Of an item
    with several texts each is an item of its own.
    """
    known = items.select(F.col(item_col).alias("item"), words_of(F.col(item_text_col)).alias("words")).where("item is not null and size(words) > 0")
    known = known.select("item", F.least(F.size("words"), F.lit(SHINGLE)).alias("gram"), _item_grams(_hash).alias("hashes"), _item_grams(_text).alias("grams"))
    known = materialize(spark, known, "items")
    small = F.size("hashes") <= MINIMA
    minima = F.transform(F.sequence(F.lit(1), F.lit(MINIMA)), lambda k: F.array_min(F.transform("hashes", lambda h: F.struct(F.xxhash64(h, k).alias("o"), h.alias("h"))))["h"])
    sketch = known.select("item", F.when(small, F.ceil(F.size("hashes") * percent / 100)).otherwise(NEEDED).alias("needed"), F.explode(F.when(small, F.col("hashes")).otherwise(minima)).alias("h"))
    sketch = materialize(spark, sketch.groupBy("item", "needed", "h").agg(F.count("*").alias("slots")), "sketch")
    lengths = [r.gram for r in known.select("gram").distinct().limit(SHINGLE).collect()]  # five numbers at most
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    words = texts.select("id", words_of(F.col("text")).alias("words"))
    if not lengths:
        return texts.join(known, F.lit(False)).select("id", "item")
    # all lengths in one pass over the documents; a hash covers its length, so lengths do not mix
    none = F.array().cast("array<bigint>")
    held = words.select("id", F.explode(F.concat(*[F.coalesce(_grams("words", n, _hash), none) for n in sorted(lengths)])).alias("h"))
    hits = held.join(broadcast_if_small(sketch), "h").select("id", "item", "needed", "slots", "h").distinct()
    candidates = materialize(spark, hits.groupBy("id", "item").agg(F.sum("slots").alias("slots"), F.min("needed").alias("needed")).where("slots >= needed").select("id", "item"), "candidates")
    found = texts.join(broadcast_if_small(candidates), "id").select("id", "item", words_of(F.col("text")).alias("words"))
    size = known.agg(F.sum(F.expr("aggregate(grams, 0L, (n, g) -> n + length(g) + 24)"))).first()[0] or 0
    exact = found.join(F.broadcast(known) if size <= BROADCAST_BYTES else known, "item")
    mine = _grams("words", SHINGLE, _text)
    for n in range(1, SHINGLE):
        mine = F.when(F.col("gram") == n, _grams("words", n, _text)).otherwise(mine)
    both = F.size(F.array_intersect("grams", mine))
    return exact.where(100 * both >= percent * F.size("grams")).select("id", "item").distinct()


def contamination(spark: SparkSession, docs: DataFrame, items: DataFrame, percent: int = 75) -> DataFrame:
    """(doc_id, contaminated, n_items, item_ids) for each row of ``docs``; item_ids is a sorted list as text, empty if none.

    Rows that repeat an id share their items; a row with a null id has none. Columns of ``docs`` and ``items`` other than
    doc_id, item_id and text are not read. Empty tables: no rows, or no item found.
    """
    pairs = materialize(spark, contaminated_pairs(spark, docs, items, percent), "leaks")
    listed = pairs.groupBy("id").agg(F.sort_array(F.collect_set("item")).alias("items"))  # at most the items of the benchmark
    out = docs.select("doc_id").join(listed.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    n = F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("long")
    return out.select("doc_id", (n > 0).alias("contaminated"), n.alias("n_items"), F.coalesce(F.array_join(F.col("items").cast("array<string>"), ","), F.lit("")).alias("item_ids"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text holds an item; columns as before.

    A text is judged by itself: another text under the same id changes nothing, rows that repeat a text go or stay
    together, and rows with a null id are judged like others. Null and wordless texts stay. An empty table gives an empty
    table; without items all rows stay.
    """
    keyed = docs.select(F.struct(*text_key(F.col("text"))).alias("key"), "text")
    gone = contaminated_pairs(spark, keyed, items, id_col="key").select("id.*").distinct()
    gone = broadcast_if_small(materialize(spark, gone, "gone"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), *text_key(F.col("text")))
    return rows.join(gone, ["t1", "t2"], "left_anti").select("row.*")
