"""Values with their places in a text: extraction, bad contexts, settled overlaps, one value a field.

An extractor finds (start, end, value) of its pattern anywhere in a text. Spans are rows; what decides on them are windows
over the spans of one text, behind one exchange of narrow rows: no text is shuffled, and none is searched once a value.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Kinds of spans: a label names its field, a guess has the shape of a value, a blocker is something else, a bad word warns of what follows.
LABEL, GUESS, BLOCK, BAD = "label", "guess", "block", "bad"
#: Characters before a value in which a bad word counts.
NEAR = 22
MARK = "\u0001"
MATCHES = "array<struct<x:int,n:int,hit:int,gap:int,value:string>>"


@dataclass(frozen=True)
class Extractor:
    """A pattern for a field; its first group, or the whole match without one, is the value, at the match's end unless ``leading``.

    Patterns match no empty text and look neither behind nor ahead, so that a value is found again in its own match.
    Two hints are for ``fields_of``: a pattern in ``small`` letters meets the text in small letters, and its value is what
    stands there in the text; ``needs`` are words in small letters of which any text with a match holds one.
    """

    field: str
    kind: str
    pattern: str
    score: int
    group: int = 1
    leading: bool = False
    small: bool = False
    needs: Sequence[str] = ()


def held(rows: DataFrame, *columns: str) -> DataFrame:
    """``rows`` with computed columns behind a generator, so that each use of one reads its value instead of computing it again."""
    others = [c for c in rows.columns if c not in columns]
    return rows.select(*others, F.inline(F.array(F.struct(*columns))))


def found(rows: DataFrame, id_col: str, text: Column, extractors: Sequence[Extractor]) -> DataFrame:
    """(id, t, field, kind, score, start, end, value): every match of every extractor; t is a hash of the text.

    An id with several texts has spans in each of them; rows that repeat an id and a text count once. Null texts and ids
    have none. Places are characters from 0, the end is exclusive.
    """
    texts = rows.select(F.col(id_col).alias("id"), F.translate(F.coalesce(text, F.lit("")), MARK, " ").alias("text")).where("id is not null")
    texts = held(texts, "text").withColumn("t", F.xxhash64("text"))

    def matches(x: int, e: Extractor) -> Column:
        # one pass of the pattern: a gap, a hit and its value, parted by marks, for each match; a lambda's name keeps them from being cut again
        cut = F.split(F.regexp_replace("text", e.pattern, f"{MARK}$0{MARK}${e.group}{MARK}"), MARK, -1)

        def shapes(p: Column) -> Column:
            n = F.floor(F.size(p) / 3).cast("int")
            one = lambda k: F.struct(F.lit(x).alias("x"), k.alias("n"), F.length(F.get(p, 3 * k + 1)).alias("hit"), F.length(F.get(p, 3 * k)).alias("gap"), F.get(p, 3 * k + 2).alias("value"))
            return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), one)).otherwise(F.array().cast(MATCHES))

        return F.get(F.transform(F.array(cut), shapes), F.lit(0))

    every = texts.select("id", "t", F.inline(F.concat(*[matches(x, e) for x, e in enumerate(extractors)])))
    every = every.repartition("id", "t").dropDuplicates(["id", "t", "x", "n"])
    pick = lambda name: F.element_at(F.array(*[F.lit(getattr(e, name)) for e in extractors]), F.col("x") + 1)
    end = F.sum(F.col("gap") + F.col("hit")).over(W.partitionBy("id", "t", "x").orderBy("n")).cast("int")
    spans = every.withColumn("start", end - F.when(pick("leading"), F.col("hit")).otherwise(F.length("value"))).where(F.length("value") > 0)
    return spans.select("id", "t", pick("field").alias("field"), pick("kind").alias("kind"), pick("score").alias("score"), "start", (F.col("start") + F.length("value")).alias("end"), "value")


def without_bad(spans: DataFrame, near: int = NEAR) -> DataFrame:
    """``spans`` without bad words, and without the values of a field that stand nowhere but after one of the field's bad words.

    A bad word counts where all of it is in the ``near`` characters before the value. Values are compared in lower case.
    """
    place = F.when(F.col("kind") == BAD, F.col("end")).otherwise(F.col("start"))
    before = W.partitionBy("id", "t", "field").orderBy(place, F.when(F.col("kind") == BAD, 0).otherwise(1)).rowsBetween(W.unboundedPreceding, 0)
    last = F.last(F.when(F.col("kind") == BAD, F.col("start")), ignorenulls=True).over(before)
    spans = spans.withColumn("clean", ~F.coalesce(last >= F.col("start") - near, F.lit(False))).where(F.col("kind") != BAD)
    anywhere = F.max("clean").over(W.partitionBy("id", "t", "field", F.lower("value")))
    return spans.withColumn("anywhere", anywhere).where("anywhere").drop("anywhere", "clean")


def settled(spans: DataFrame) -> DataFrame:
    """The spans that no better kept span overlaps. Better is a higher score, then the longer one, then the earlier, then the first by field and kind.

    Spans that hang together by overlaps form a cluster, found by a sweep over the starts; within one the best are taken
    in turn. Only clusters are gathered, and a cluster is as long as the spans that overlap in one place of a text.
    """
    sweep = W.partitionBy("id", "t").orderBy("start", "end", F.desc("score"), "field", "kind")
    reach = F.max("end").over(sweep.rowsBetween(W.unboundedPreceding, -1))
    spans = spans.withColumn("fresh", F.coalesce(F.col("start") >= reach, F.lit(True)).cast("int"))
    spans = spans.withColumn("cluster", F.sum("fresh").over(sweep.rowsBetween(W.unboundedPreceding, 0)))
    one = F.struct((-F.col("score")).alias("less"), (F.col("start") - F.col("end")).alias("size"), "start", "field", "kind", "end", "score", "value")
    groups = spans.groupBy("id", "t", "cluster").agg(F.sort_array(F.collect_list(one)).alias("spans"))
    apart = lambda kept, s: ~F.exists(kept, lambda k: (k["start"] < s["end"]) & (s["start"] < k["end"]))
    kept = F.aggregate("spans", F.slice("spans", 1, 0), lambda kept, s: F.when(apart(kept, s), F.concat(kept, F.array(s))).otherwise(kept))
    kept = F.when(F.size("spans") == 1, F.col("spans")).otherwise(kept)
    return groups.select("id", "t", F.inline(kept)).select("id", "t", "field", "kind", "score", "start", "end", "value")


def chosen(spans: DataFrame, fields: Sequence[str], **more: Column) -> DataFrame:
    """(id, t, one column a field, ``more`` aggregates): of each field the value with the best score, labels before guesses, the first in the text; blockers fill no field."""
    best = lambda f: F.max_by(F.when(F.col("field") == f, F.col("value")), F.when(F.col("field") == f, F.struct((F.col("kind") == LABEL).alias("label"), F.col("score").alias("score"), (-F.col("start")).alias("first"))))
    return spans.where(F.col("kind").isin(LABEL, GUESS)).groupBy("id", "t").agg(*[best(f).alias(f) for f in fields], *[c.alias(name) for name, c in more.items()])


def fields_of(text: Column, extractors: Sequence[Extractor], fields: Sequence[str], near: int = NEAR) -> Column:
    """struct, for each of ``fields``, of struct(value, n, labelled): what ``chosen`` takes from the settled spans, how many distinct values are left, and whether a label names one.

    The same rules as those of ``found``, ``without_bad``, ``settled`` and ``chosen`` for texts that are each by itself: the spans of a text
    never leave its task, so nothing is shuffled. A pattern is searched only where a word that it needs stands. Classes such as \\d and \\s are of ASCII.
    """
    rules = [(e.pattern, e.field, e.kind, e.score, e.group, e.small, tuple(e.needs)) for e in extractors]
    names, kinds, mark = list(fields), (LABEL, GUESS, BAD), MARK
    one = "struct<value:string,n:int,labelled:boolean>"

    def spans_of(text, compiled):
        low = text.lower()
        if len(low) != len(text):  # small letters keep their places
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        for pattern, field, kind, score, group, small, needs in compiled:
            if needs and not any(map(low.__contains__, needs)):
                continue
            for m in pattern.finditer(low if small else text):
                a, b = m.span(group)
                if a < b:
                    yield -score, a - b, a, field, kind, b, text[a:b]

    def settled_of(spans):
        bad = [s for s in spans if s[4] == kinds[2]]
        if bad:
            spans = [s for s in spans if s[4] != kinds[2]]
            clean = {(s[3], s[6].lower()) for s in spans if not any(x[3] == s[3] and x[5] <= s[2] and x[2] >= s[2] - near for x in bad)}
            spans = [s for s in spans if (s[3], s[6].lower()) in clean]
        starts, ends = [], []
        for s in sorted(spans):
            k = bisect.bisect_left(starts, s[5])  # kept spans before k begin before the end of this one
            if k == 0 or ends[k - 1] <= s[2]:
                starts.insert(k, s[2]), ends.insert(k, s[5])
                yield s

    @F.arrow_udf(f"struct<{','.join(f'`{f}`:{one}' for f in names)}>")
    def read(texts: pa.Array) -> pa.Array:
        compiled = [(re.compile(pattern, re.ASCII), *rest) for pattern, *rest in rules]
        rows = []
        for text in texts.to_pylist():
            best, values, labelled = {}, {}, set()
            for less, _, start, field, kind, _, value in settled_of(list(spans_of((text or "").replace(mark, " "), compiled))):
                if kind in kinds[:2]:
                    rank = (kind == kinds[0], -less, -start)
                    if field not in best or rank > best[field][0]:
                        best[field] = rank, value
                    values.setdefault(field, set()).add(value)
                    if rank[0]:
                        labelled.add(field)
            rows.append((best, values, labelled))
        columns = [
            pa.StructArray.from_arrays([pa.array([r[0][f][1] if f in r[0] else None for r in rows], pa.string()), pa.array([len(r[1].get(f, ())) for r in rows], pa.int32()), pa.array([f in r[2] for r in rows], pa.bool_())], ["value", "n", "labelled"])
            for f in names
        ]
        return pa.StructArray.from_arrays(columns, names)

    return read(text)
