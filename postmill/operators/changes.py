"""Changes of state as new snapshots, and matches against small rule tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def patched(rows: DataFrame, log: DataFrame, key: str, column: str, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``column`` replaced by the newest entry of a change log (key, column, order columns), where there is one.

    Nulls in the log change nothing. The log is reduced to one row a key before the join, with partial aggregation.
    """
    last = log.where(F.col(column).isNotNull()).groupBy(key).agg(F.max_by(column, F.struct(*order)).alias("_patch"))
    new = [F.coalesce("_patch", c).alias(c) if c == column else F.col(c) for c in rows.columns]
    return rows.join(last, key, "left").select(*new)


def keep_newest(rows: DataFrame, id_col: str, k: int) -> DataFrame:
    """The rows with the k largest ids (which are distinct): a top-k of ids gives the bound, no window over all rows."""
    bound = rows.select(id_col).orderBy(F.desc(id_col)).limit(k).agg(F.min(id_col).alias("_bound"))
    return rows.join(F.broadcast(bound), F.col(id_col) >= F.col("_bound")).drop("_bound")  # one row


def unique_best(rows: DataFrame, key: str, score: str, id_col: str) -> DataFrame:
    """(key, best, ties): the id of a key's highest score; null where several rows share it, ties says how many."""
    levels = rows.groupBy(key, score).agg(F.count("*").alias("n"), F.min(id_col).alias("id"))
    top = levels.groupBy(key).agg(F.max(F.struct(score, "n", "id")).alias("m"))
    return top.select(key, F.when(F.col("m.n") == 1, F.col("m.id")).alias("best"), F.col("m.n").alias("ties"))


def suffixes(domain: Column) -> Column:
    """The domain and its parent domains, longest first."""
    parts = F.split(domain, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def match_domains(rows: DataFrame, domain: str, rules: DataFrame, value: str) -> DataFrame:
    """``rows`` with ``value`` of the longest rule (suffix, value) that is the domain or a parent of it; null without one.

    Distinct domains are matched by an equi-join on their suffixes, so that a common domain is matched once.
    """
    found = rows.select(domain).distinct().select(domain, F.posexplode(suffixes(F.col(domain))).alias("place", "suffix"))
    best = found.join(F.broadcast(rules), "suffix").groupBy(domain).agg(F.min_by(value, "place").alias(value))  # a fixed rule table
    return rows.join(best, domain, "left")


def phrases_found(rows: DataFrame, id_col: str, text: Column, phrases: Sequence[str]) -> DataFrame:
    """(id, phrase): the phrases of a fixed list that a text contains, case ignored."""
    low = F.lower(text)
    return rows.select(id_col, F.explode(F.array_compact(F.array(*[F.when(F.contains(low, F.lit(p.lower())), p) for p in phrases]))).alias("phrase"))


def tiered_price(model: Column, prices: dict[str, float], default: float) -> Column:
    """The price of a model by its name, else by the first listed name inside it, else the default."""
    exact = [(model == k, v) for k, v in prices.items()]
    partial = [(F.contains(model, F.lit(k)), v) for k, v in prices.items()]
    return reduce(lambda out, rule: out.when(*rule), exact + partial, F.when(F.lit(False), F.lit(default))).otherwise(F.lit(default))


def issue_codes(**rules: Column) -> Column:
    """An array of the names of the rules that hold; a null rule does not hold."""
    return F.array_compact(F.array(*[F.when(c, k) for k, c in rules.items()]))


def gaps(rows: DataFrame, folder: str, uid: str, on_left: Column, on_right: Column) -> DataFrame:
    """(folder, both, left_only, right_only): uids of a folder on either side, each uid counted once."""
    seen = rows.groupBy(folder, uid).agg(F.bool_or(on_left).alias("l"), F.bool_or(on_right).alias("r"))
    left, right = F.col("l"), F.col("r")
    return seen.groupBy(folder).agg(F.count_if(left & right).alias("both"), F.count_if(left & ~right).alias("left_only"), F.count_if(right & ~left).alias("right_only"))
