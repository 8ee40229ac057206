"""An inverted index of identifiers: whole values and parts of them lead to cases, mail and outbox rows, without reading those.

A posting says that an entity's field holds a value. It lies once, under the normalised value, in a bucket by the hash of that
term, sorted by field and term. For parts of values there is a row for each trigram of an entity's field, with the buckets that
hold it. A lookup reads the trigrams' rows, and then the field's postings in those buckets alone. New postings are a new
segment, so that an append rewrites nothing; a merge makes one segment of all. A later segment may withdraw.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.functions.text import identifier

BUCKETS, GRAM = 64, 3
#: Files by which a bucket is cut, so that no task has a whole bucket; the last one has the trigrams.
CUTS = 4
#: Scores of a value that is what was asked, and of one that holds it.
EXACT, INSIDE = 100, 60
#: A posting has its value as the term; a row of a trigram (``whole`` false) has the buckets of the values that hold it and no id.
POSTING = "term string, whole boolean, entity string, id string, field string, live boolean, number long, places array<int>"
KEYS = ["bucket", "term", "entity", "id", "field"]


def postings(rows: DataFrame, entity: str, id_col: str, fields: dict[str, Column], live: bool = True) -> DataFrame:
    """(entity, id, field, term, live) for each field of each row; null and empty values and null ids have none.

    ``live`` false withdraws what earlier segments say of the same entity, id, field and value.
    """
    pairs = F.array(*[F.struct(F.lit(name).alias("field"), identifier(c.cast("string")).alias("term")) for name, c in fields.items()])
    every = rows.select(F.lit(entity).alias("entity"), F.col(id_col).cast("string").alias("id"), F.inline(pairs)).where("id is not null and length(term) > 0")
    return every.withColumn("live", F.lit(live))


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


class IdentifierIndex:
    """Segments under ``root``, a folder that all executors share: segment=<number>-<name>/bucket=<n>."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def _fs(self):
        return self._path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def segments(self) -> list[str]:
        """Complete segments, in the order of their numbers: those that have been renamed into place."""
        root = self._path(self.root)
        names = [s.getPath().getName() for s in self._fs().listStatus(root)] if self._fs().exists(root) else []
        return sorted(n for n in names if n.startswith("segment="))

    def _write(self, posts: DataFrame, number: int, name: str) -> None:
        """Postings with their last word (KEYS, said) as a segment; ``said`` is twice a number, and one more if it withdraws."""
        draft = f"{self.root}/.draft-{uuid.uuid4().hex}"
        cut = F.pmod(F.xxhash64("entity", "id"), F.lit(CUTS - 1)).cast("int")
        # one exchange: rows that repeat a posting meet in it, and what is written stays where it is
        last = posts.withColumn("cut", cut).repartition("bucket", "cut").groupBy("cut", *KEYS).agg(F.max("said").alias("said"))
        rows = _said(last).select("term", F.lit(True).alias("whole"), "entity", "id", "field", "live", "number", F.lit(None).cast("array<int>").alias("places"), "bucket")
        if name.startswith("merged-"):
            rows = rows.where("live")
        rows.sortWithinPartitions("bucket", "entity", "field", "term").write.partitionBy("bucket").parquet(draft)
        # a row a trigram and field, from the terms as they were written
        terms = self.spark.read.schema(POSTING + ", bucket int").parquet(draft).where(F.length("term") >= GRAM).select("entity", "field", "term", "bucket")
        grams = F.transform(F.sequence(F.lit(1), F.length("term") - GRAM + 1), lambda i: F.substring("term", i, F.lit(GRAM)))
        held = terms.select("entity", "field", F.col("bucket").alias("place"), F.explode(grams).alias("term")).distinct()
        rows = held.groupBy("entity", "field", "term").agg(F.sort_array(F.collect_list("place")).alias("places")).withColumn("bucket", bucket(F.col("term")))
        rows = rows.select("term", F.lit(False).alias("whole"), "entity", F.lit(None).cast("string").alias("id"), "field", F.lit(True).alias("live"), F.lit(number).cast("long").alias("number"), "places", "bucket")
        rows.repartition("bucket").sortWithinPartitions("bucket", "term").write.mode("append").partitionBy("bucket").parquet(draft)
        if not self._fs().rename(self._path(draft), self._path(f"{self.root}/segment={number:012d}-{name}")):
            raise RuntimeError("a segment could not be put into place")

    def append(self, *tables: DataFrame) -> None:
        """A new segment of all the postings; appends at the same time are both kept, in any order."""
        found = self.segments()
        number = int(found[-1].split("=")[1].split("-")[0]) + 1 if found else 1
        posts = reduce(DataFrame.unionByName, tables)
        said = F.lit(2 * number).cast("long") + F.when(F.col("live"), 0).otherwise(1)
        self._write(posts.select(bucket(F.col("term")).alias("bucket"), "term", "entity", "id", "field", said.alias("said")), number, uuid.uuid4().hex)

    def merge(self) -> None:
        """One segment instead of all that are there now; withdrawn postings go. A reader that began before has to begin again."""
        found = self.segments()
        if len(found) < 2:
            return
        posts = self._read(found).where("whole").select(*KEYS, _word().alias("said"))
        self._write(posts, int(found[-1].split("=")[1].split("-")[0]), "merged-" + uuid.uuid4().hex)
        for s in found:
            self._fs().delete(self._path(f"{self.root}/{s}"), True)

    def _read(self, segments: list[str]) -> DataFrame:
        if not segments:
            return self.spark.createDataFrame([], POSTING + ", bucket int")
        return self.spark.read.schema(POSTING + ", bucket int").option("basePath", self.root).parquet(*[f"{self.root}/{s}" for s in segments])

    def lookup(self, text: str, entities: list[str] | None = None, limit: int | None = 50) -> DataFrame:
        """(entity, id, field, value, score) whose value is, or holds, the text, both normalised: the best field of an entity, best first.

        Reads the bucket of the whole text, the rows of its trigrams, and of each field the postings in the buckets that hold
        all of these. A text shorter than a trigram is asked for whole values only; an empty one finds nothing.
        """
        grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length("a") - GRAM + 1, F.lit(1))), lambda i: F.substring("a", i, F.lit(GRAM)))
        asked = self.spark.range(1).select(identifier(F.lit(text)).alias("a")).select("a", bucket(F.col("a")).alias("b"), F.array_distinct(grams).alias("g"))
        asked = asked.select("a", "b", "g", F.transform("g", bucket).alias("gb")).first()
        whole, rows = asked.a, self._read(self.segments())
        if entities:
            rows = rows.where(F.col("entity").isin(entities))
        hits = rows.where((F.col("bucket") == asked.b) & (F.col("term") == whole) & F.col("whole") & (F.lit(whole) != ""))
        if len(whole) >= GRAM:
            listed = rows.where(F.col("bucket").isin(asked.gb) & F.col("term").isin(asked.g) & ~F.col("whole")).select("entity", "field", "term", "number", F.explode("places").alias("place"))
            # all trigrams of a value are in its own segment and bucket; a place is a number below BUCKETS, so this is a row a field
            held = listed.groupBy("entity", "field", "place", "number").agg(F.count_distinct("term").alias("n")).where(F.col("n") == len(asked.g))
            places = held.groupBy("entity", "field").agg(F.collect_set("place").alias("places")).collect()
            if places:
                within = reduce(Column.__or__, [(F.col("entity") == p.entity) & (F.col("field") == p.field) & F.col("bucket").isin(p.places) for p in places])
                hits = hits.unionByName(rows.where(F.col("bucket").isin(sorted({b for p in places for b in p.places})) & within & F.col("whole") & F.col("term").contains(whole) & (F.col("term") != whole)))
        score = F.when(F.col("term") == whole, EXACT).otherwise(INSIDE)
        best = _latest(hits).where("live").groupBy("entity", "id").agg(F.max_by(F.struct("field", F.col("term").alias("value"), score.alias("score")), F.struct(score, F.col("field"), F.col("term"))).alias("m"))
        out = best.select("entity", "id", "m.*")
        return out.orderBy(F.desc("score"), "entity", "id").limit(limit) if limit else out

    def lookup_many(self, asked: DataFrame, column: str) -> DataFrame:
        """``asked`` with (entity, id, field) for each value that equals its text, both normalised: a join by bucket and term."""
        terms = asked.withColumn("term", identifier(F.col(column).cast("string"))).withColumn("bucket", bucket(F.col("term")))
        wanted = self._read(self.segments()).where("whole").join(terms.select("bucket", "term").distinct(), ["bucket", "term"], "left_semi")
        rows = _latest(wanted).where("live").select("term", "bucket", "entity", F.col("id").alias("found_id"), "field")
        return terms.join(rows, ["bucket", "term"]).drop("bucket", "term")


def _word() -> Column:
    """What a segment says of a posting, as one number: of several the greatest counts, so a withdrawal before a repetition."""
    return F.col("number") * 2 + F.when(F.col("live"), 0).otherwise(1)


def _said(rows: DataFrame) -> DataFrame:
    return rows.withColumn("live", F.col("said") % 2 == 0).withColumn("number", F.shiftright("said", 1)).drop("said")


def _latest(rows: DataFrame) -> DataFrame:
    """The last word on each posting: of several segments the greatest number, a withdrawal before a repetition."""
    return _said(rows.groupBy(*KEYS).agg(F.max(_word()).alias("said")))
