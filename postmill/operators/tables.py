"""Relational building blocks: joins, ranks, pages, facets, merges."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Priorities from most to least urgent.
PRIORITIES = ["critical", "high", "medium", "normal", "low"]


def rank_of(x: Column, order: Sequence[str]) -> Column:
    """The place of a code in a fixed order, from 0; unknown codes and nulls come last."""
    return F.coalesce(reduce(lambda out, kv: out.when(x == kv[1], kv[0]), enumerate(order), F.when(F.lit(False), -1)), F.lit(len(order)))


def empty(x: Column) -> Column:
    return F.coalesce(F.trim(x), F.lit("")) == ""


def page(rows: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    """One page in the given order, which must be total; deep pages are better asked by key (``after``)."""
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def after(rows: DataFrame, key: str, seen: int, size: int) -> DataFrame:
    """The next rows after a key."""
    return rows.where(F.col(key) > seen).orderBy(key).limit(size)


def with_total(rows: DataFrame, whole: DataFrame) -> DataFrame:
    """Each row with the number of rows of ``whole``: one row is broadcast."""
    return rows.join(F.broadcast(whole.agg(F.count("*").alias("total"))), F.lit(True))


def facets(rows: DataFrame, named: dict[str, Column]) -> DataFrame:
    """(facet, n): how many rows meet each named predicate, in one pass over the rows."""
    counts = rows.agg(*[F.count_if(c).alias(k) for k, c in named.items()])
    return counts.unpivot([], list(named), "facet", "n")


def count_by(rows: DataFrame, *keys: str | Column) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def zero_filled(counts: DataFrame, key: str, values: Sequence[str], n: str = "n") -> DataFrame:
    """The counts with a row for every value of a fixed list, 0 where nothing was counted."""
    spark = counts.sparkSession
    known = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"place int, {key} string")
    return counts.join(F.broadcast(known), key, "right").select(key, "place", F.coalesce(F.col(n), F.lit(0)).alias(n))


def first_per(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1, place: str = "place") -> DataFrame:
    """The first n rows of each key in the given order, with their place."""
    return rows.withColumn(place, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(place) <= n)


def tiered_parent(children: DataFrame, parents: DataFrame, tiers: Sequence[str], child_id: str, parent_id: str) -> DataFrame:
    """(child, tier, parent): for each child the lowest parent id of the first tier whose key is equal and not null.

    Each tier is an equi-join against parents already reduced to one row a key, so no key fans out.
    """
    found = []
    for k, key in enumerate(tiers):
        lowest = parents.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(parent_id).alias("parent"))
        # the child itself may be the lowest of its key: then the second lowest is its parent
        second = parents.where(F.col(key).isNotNull()).join(lowest, key).where(F.col(parent_id) > F.col("parent")).groupBy(key).agg(F.min(parent_id).alias("next"))
        joined = children.join(lowest, key).join(second, key, "left")
        parent = F.when(F.col("parent") == F.col(child_id), F.col("next")).otherwise(F.col("parent"))
        found.append(joined.select(F.col(child_id).alias("child"), F.lit(k + 1).alias("tier"), parent.alias("parent")).where("parent is not null"))
    every = reduce(DataFrame.unionByName, found)
    return every.groupBy("child").agg(F.min(F.struct("tier", "parent")).alias("best")).select("child", "best.tier", "best.parent")


def related(rows: DataFrame, key: str, id_col: str, n: int = 20) -> DataFrame:
    """(id, other, place): for each row the first n other ids of its key.

    Only the first n + 1 ids of a key can be among them, so the join is against at most n + 1 rows a key.
    """
    heads = first_per(rows.where(F.col(key).isNotNull()).select(key, F.col(id_col).alias("other")), [key], [F.col("other")], n + 1, "head").drop("head")
    pairs = rows.select(key, F.col(id_col).alias("id")).join(heads, key).where("id <> other")
    return first_per(pairs, ["id"], [F.col("other")], n).select("id", "other", "place")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], rules: dict[str, Column]) -> DataFrame:
    """The table after a merge: rows of either side, each column by its rule over old.x and new.x.

    The result is a new snapshot; write it to a new folder, never over the one that is read.
    """
    a, b = old.alias("old"), new.alias("new")
    joined = a.join(b, [F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}")) for k in keys], "full_outer")
    return joined.select(*[F.coalesce(f"old.{k}", f"new.{k}").alias(k) for k in keys], *[c.alias(k) for k, c in rules.items()])


def reconcile(left: DataFrame, right: DataFrame, keys: Sequence[str], left_id: str, right_id: str) -> DataFrame:
    """Full outer join with a status: both, missing_right or missing_left."""
    status = F.when(F.col(left_id).isNull(), "missing_left").when(F.col(right_id).isNull(), "missing_right").otherwise("both")
    return left.join(right, list(keys), "full_outer").withColumn("status", status)


def changed_columns(fields: dict[str, tuple[Column, Column, Column]]) -> Column:
    """array<struct<field, before, proposed, accepted>> of the named (before, proposed, after) columns that the proposal changes."""
    one = lambda k, a, b, c: F.when(~a.eqNullSafe(b), F.struct(F.lit(k).alias("field"), a.alias("before"), b.alias("proposed"), (b.isNotNull() & b.eqNullSafe(c)).alias("accepted")))
    return F.array_compact(F.array(*[one(k, *columns) for k, columns in fields.items()]))


def changed_fields(before: Column, proposed: Column, after_: Column) -> Column:
    """map of field -> (before, proposed, after, changed, accepted) for fields that the proposal changes."""
    keys = F.array_sort(F.array_distinct(F.concat(F.map_keys(before), F.map_keys(proposed))))

    def one(k: Column) -> Column:
        old, new, final = F.try_element_at(before, k), F.try_element_at(proposed, k), F.try_element_at(after_, k)
        return F.struct(old.alias("before"), new.alias("proposed"), final.alias("after"), (~old.eqNullSafe(new)).alias("changed"), (new.isNotNull() & new.eqNullSafe(final)).alias("accepted"))

    return F.map_filter(F.map_from_arrays(keys, F.transform(keys, one)), lambda _, v: v["changed"])
