"""Connected components of an edge table by minimum parents and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm.scratch import broadcast_if_small, materialize, release


def connected_components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a long, b long); component is the smallest node reachable.

    Self-links are ignored, repeated and reversed links count once; a null end drops the link. No links: an empty table.
    Links point from the larger to the smaller node. In a round each node takes its smallest neighbour as parent, its
    other neighbours are linked to that parent instead, and every link then jumps to its end's own parent. It ends when
    all links are stars; the rounds are logarithmic in the length of paths. The smallest neighbour is a partial aggregate,
    joined back, so that no node's links meet in one task: parents are broadcast while they are few, and else adaptive
    execution may split the joins.
    """
    links = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    old: list[DataFrame] = []
    while True:
        table = materialize(spark, links.groupBy("u").agg(F.min("v").alias("p")), "parents")
        parents = broadcast_if_small(table)
        lowest = links.select("u", "v").join(parents, "u")
        moved = lowest.select(F.when(F.col("v") == F.col("p"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("p").alias("y"), (F.col("v") != F.col("p")).alias("moved"))
        up = parents.select(F.col("u").alias("y"), F.col("p").alias("q"))
        jumped = moved.join(up, "y", "left").select("u", F.coalesce("q", "y").alias("v"), (F.col("moved") | F.col("q").isNotNull()).alias("open"))
        links = materialize(spark, jumped.groupBy("u", "v").agg(F.max("open").alias("open")), "links")
        release(spark, *old, table)
        old = [links]
        if links.where("open").isEmpty():
            break
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(links.select("v", F.col("v").alias("component")).distinct())
