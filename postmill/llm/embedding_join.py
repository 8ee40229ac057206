"""Exact metric range join of embeddings.

Unit vectors under Euclidean distance are a metric: cosine >= c means distance <= r = sqrt(2 - 2c). Pivots, rows of the
same label, partition the vectors into cells by nearest pivot. If x lies in cell i and y in cell j within r of x, the
triangle inequality gives d(x, p_j) <= d(y, p_j) + r <= d(y, p_i) + r <= d(x, p_i) + 2r, and d(x, p_j) <= radius_j + r;
x is replicated to just the cells that meet both bounds. Each cell then joins on its own, as blocks of bounded size.
Equal vectors of a label are one class with a weight before that, so a vector with a third of all rows is one row of a cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm.components import connected_components
from postmill.llm.scratch import broadcast_if_small, materialize, release

#: Vectors a cell should have at home, and pivots at most (their broadcast is then at most MAX_PIVOTS vectors).
CELL, MAX_PIVOTS = 2048, 4096
#: Rows of a block at most, on average: a task compares two blocks, whatever the size of the cell.
BLOCK = 2048


def _place(pivots, radius: float, with_copies: bool):
    """Home cell and distance of each row; or, with ``pivots`` that know their cell's radius, also the copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pivots.value
        for batch in batches:
            label = batch.column(1).to_numpy()
            rows, cells, home, far = [], [], [], []
            for one in np.unique(label):
                at = np.flatnonzero(label == one)
                if one not in known:
                    found = (at, np.zeros(len(at), np.int64), np.ones(len(at), bool), np.zeros(len(at)))
                else:
                    centres, reach = known[one]
                    values = np.asarray(batch.column(2).take(pa.array(at)).flatten(), np.float64).reshape(len(at), -1)
                    values = values / np.linalg.norm(values, axis=1, keepdims=True)
                    apart = np.sqrt(np.maximum(0, 2 - 2 * values @ centres.T))
                    own = apart.argmin(1)
                    best = apart[np.arange(len(at)), own]
                    if with_copies:
                        close = (apart <= best[:, None] + 2 * radius + 1e-6) & (apart <= reach[None, :] + radius + 1e-6)
                        close[np.arange(len(at)), own] = True
                        r, c = np.nonzero(close)
                    else:
                        r, c = np.arange(len(at)), own
                    found = (at[r], c, own[r] == c, best[r])
                for into, what in zip((rows, cells, home, far), found):
                    into.append(what)
            if rows:
                taken = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(taken), batch.column(1).take(taken), batch.column(2).take(taken), pa.array(np.concatenate(cells), pa.int64()), pa.array(np.concatenate(home)), pa.array(np.concatenate(far)), batch.column(3).take(taken)], ["id", "label", "v", "cell", "home", "far", "weight"])

    return run


def _links_of_block(cosine: float):
    """Per block pair: each row's links (by weight) from home rows to the other side, and a spanning star of each local component."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        values = np.stack(part["v"].to_numpy()).astype(np.float64)
        values /= np.linalg.norm(values, axis=1, keepdims=True)
        ids, left, weight = part["id"].to_numpy(), part["left"].to_numpy(), part["weight"].to_numpy()
        one, two = np.flatnonzero(left), np.flatnonzero(~left)
        best = np.arange(len(part))  # position of the smallest id linked so far
        order = np.argsort(ids, kind="stable")
        rank = np.empty(len(part), np.int64)
        rank[order] = np.arange(len(part))
        count = np.zeros(len(part), np.int64)
        near = []
        for k in range(0, len(one), 512):
            rows = one[k : k + 512]
            hit = values[rows] @ values[two].T >= cosine
            hit &= ids[rows][:, None] != ids[two][None, :]
            count[rows] = hit @ weight[two]
            r, c = np.nonzero(hit)
            near.append((rows[r].astype(np.int32), two[c].astype(np.int32)))
        u, v = (np.concatenate(x) for x in zip(*near)) if near else (np.zeros(0, np.int32),) * 2
        best = rank.copy()
        while True:
            before = best.copy()
            low = np.minimum(best[u], best[v])
            np.minimum.at(best, u, low)
            np.minimum.at(best, v, low)
            best = np.minimum(best, best[order[best]])
            if (best == before).all():
                break
        out = pd.DataFrame({"id": ids, "root": ids[order[best]], "n": count})
        return out[(out["n"] > 0) | (out["root"] != out["id"])]

    return run


def _unit(column):
    """The embedding if it is usable: not null, no null or non-finite component, not zero; else null."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(column.isNotNull() & ~bad & F.exists(column, lambda x: x != 0), column)


def similar_embeddings(spark: SparkSession, vectors: DataFrame, cosine: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors``.

    Rows link where labels are equal and not null and the cosine in double precision is at least ``cosine``. Null, zero,
    or partly null or non-finite vectors link with nothing, nor do rows with a null id; vectors of different lengths never
    link. Ties are links. Rows that repeat an id: each other id counts once, by the first vector of the id (by value).
    Other columns are not read, so their names cannot clash. An empty table gives an empty table.
    """
    radius = float(np.sqrt(2 - 2 * cosine))
    all_rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("w"))
    usable = all_rows.withColumn("w", _unit(F.col("w"))).where(F.col("w").isNotNull() & F.col("label").isNotNull() & F.col("id").isNotNull())
    # a label and a length of vectors make one space
    spaces = usable.select("id", F.xxhash64("label", F.size("w")).alias("label"), F.col("w").alias("v"))
    again = spaces.groupBy("id").count().where("count > 1").select("id")
    if not again.isEmpty():
        first = spaces.join(again, "id").groupBy("id").agg(F.min(F.struct("v", "label")).alias("s")).select("id", "s.label", "s.v")
        spaces = spaces.join(again, "id", "left_anti").unionByName(first)
        spaces = materialize(spark, spaces, "first-of-id")
    spaces = spaces.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v")})
    same = ["label", "h1", "h2"]
    again = materialize(spark, spaces.groupBy(*same).agg(F.min("id").alias("rep"), F.count("*").alias("weight")).where("weight > 1"), "equal")
    classes = spaces.join(broadcast_if_small(again), same, "left").where("rep is null or rep = id")
    spaces, copies = materialize(spark, classes.select("id", "label", "v", F.coalesce("weight", F.lit(1)).alias("weight")), "vectors"), spaces.select("id", *same)
    sizes = materialize(spark, spaces.groupBy("label").agg(F.count("*").alias("n")), "sizes")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    cell = max(CELL, -(-total // MAX_PIVOTS))
    large = sizes.where(F.col("n") > cell).select("label", F.ceil(F.col("n") / cell).alias("pivots"))  # at most total / cell rows
    chosen = spaces.join(F.broadcast(large), "label").withColumn("slot", F.pmod(F.xxhash64("id"), F.col("pivots"))).groupBy("label", "slot").agg(F.min("id").alias("id"))
    rows = spaces.join(F.broadcast(chosen.select("id")), "id").select("label", "id", "v").collect()  # at most 2 * MAX_PIVOTS vectors
    known = {}
    for row in sorted(rows, key=lambda r: (r.label, r.id)):
        known.setdefault(row.label, []).append(row.v)
    known = {k: np.array(v, np.float64) for k, v in known.items()}
    known = {k: v / np.linalg.norm(v, axis=1, keepdims=True) for k, v in known.items()}
    shape = "id long, label long, v array<double>, cell long, home boolean, far double, weight long"
    plain = spark.sparkContext.broadcast({k: (v, np.zeros(len(v))) for k, v in known.items()})
    reach = spaces.where(F.col("label").isin(*known) if len(known) <= 100 else F.lit(True)).mapInArrow(_place(plain, radius, False), shape).groupBy("label", "cell").agg(F.max("far").alias("far"))
    wide = {k: (v, np.zeros(len(v))) for k, v in known.items()}
    for row in (reach.join(F.broadcast(large.select("label")), "label").collect() if known else []):  # one row a pivot
        wide[row.label][1][row.cell] = row.far
    placed = materialize(spark, spaces.mapInArrow(_place(spark.sparkContext.broadcast(wide), radius, True), shape).drop("far"), "cells")
    counts = placed.groupBy("label", "cell").agg(F.ceil(F.sum(F.col("home").cast("int")) / BLOCK).alias("nb"), F.ceil(F.count("*") / BLOCK).alias("nc")).where("nb > 0")
    cut = placed.join(broadcast_if_small(materialize(spark, counts, "blocks")), ["label", "cell"])
    slice_of = F.xxhash64("id", F.lit(7))
    left = cut.where("home").select("label", "cell", F.pmod(slice_of, F.col("nb")).alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("nc") - 1)).alias("c"), "id", "v", "weight", F.lit(True).alias("left"))
    right = cut.select("label", "cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)).alias("b"), F.pmod(slice_of, F.col("nc")).alias("c"), "id", "v", "weight", F.lit(False).alias("left"))
    found = left.union(right).groupBy("label", "cell", "b", "c").applyInPandas(_links_of_block(cosine), "id long, root long, n long")
    found = materialize(spark, found, "links")
    totals = found.groupBy("id").agg(F.sum("n").alias("n"))
    groups = connected_components(spark, found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    linked = materialize(spark, totals.join(groups, F.col("id") == F.col("node"), "full").select(F.coalesce("id", "node").alias("id"), "n", "component"), "linked")
    known_links = again.join(linked, F.col("rep") == F.col("id"), "left").select(*same, (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n"), F.coalesce("component", "rep").alias("component"))
    equal = copies.join(broadcast_if_small(materialize(spark, known_links, "equal-linked")), same).select("id", "n", "component")
    single = linked.join(again.select(F.col("rep").alias("id")), "id", "left_anti")
    release(spark, spaces, sizes, placed, found)
    out = all_rows.select("id").join(single.union(equal), "id", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
