"""Threads of mail: connected components of references, kept up to date as new references come."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.sources.versions import VersionedTable


def _written(df: DataFrame, folder: str) -> DataFrame:
    """``df`` written once under ``folder``, so that a round does not compute the rounds before it again."""
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _drop(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def components(edges: DataFrame, folder: str) -> DataFrame:
    """(node, component) for each end of ``edges`` (a, b) that differ; component is the lowest node that it is linked with, itself included.

    In a round each node points to its lowest neighbour, its other neighbours are linked to that one instead, and all links
    jump to where their ends point. Rounds are logarithmic in the length of chains; a node of very many references is
    reduced by a partial aggregate and never gathered. Null ends link nothing. Working tables lie in ``folder`` and go at the end of each round but the last.
    """
    links = _written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), folder)
    while True:
        low = links.groupBy("u").agg(F.min("v").alias("p"))
        # (u, v) becomes (v, p) for the neighbours that are not the lowest, and (u, p) for the one that is
        turned = links.join(low, "u").select(F.when(F.col("v") == F.col("p"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("p").alias("v"), (F.col("v") != F.col("p")).alias("open"))
        up = low.select(F.col("u").alias("v"), F.col("p").alias("q"))
        jumped = turned.join(up, "v", "left").select("u", F.coalesce("q", "v").alias("v"), (F.col("open") | F.col("q").isNotNull()).alias("open"))
        links = _written(jumped.groupBy("u", "v").agg(F.max("open").alias("open")), folder)
        if links.where("open").isEmpty():
            return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(links.select("v", F.col("v").alias("component")).distinct())
        links = links.select("u", "v")


class Threads:
    """Which thread a message belongs to, under ``root``: a versioned table of (node, component) that new references extend."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 32):
        self.spark, self.root = spark, root.rstrip("/")
        self.table = VersionedTable(spark, f"{self.root}/members", ["node"], buckets)

    def read(self) -> DataFrame:
        return self.table.read().select("node", "component")

    def extend(self, edges: DataFrame) -> int:
        """Take in references (a, b); an edge of a node to itself makes the node known. Gives the version.

        Known nodes stand for their threads: only these and the new references are looked at, and only nodes that come
        or whose thread gets another name are written. Taking in an edge again changes nothing, so a repeated batch is
        harmless, and the order and the cut of batches do not matter: a thread is named by its lowest node.
        """
        work = f"{self.root}/work-{uuid.uuid4().hex}"
        try:
            edges = _written(edges.select("a", "b").where("a is not null and b is not null").distinct(), work)
            nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
            known = self.read() if self.table.versions() else nodes.select("node", F.col("node").alias("component")).where("false")
            now = _written(nodes.join(known, "node", "left").select("node", F.coalesce("component", "node").alias("thread"), F.col("component").isNull().alias("new")), work)
            name = lambda end: now.select(F.col("node").alias(end), F.col("thread").alias(f"t{end}"))
            between = edges.join(name("a"), "a").join(name("b"), "b").select(F.col("ta").alias("a"), F.col("tb").alias("b"))
            merged = _written(components(between, work).where("node <> component").select(F.col("node").alias("thread"), F.col("component").alias("to")), work)
            moved = known.join(merged, known["component"] == merged["thread"]).select("node", F.col("to").alias("component"))
            come = now.where("new").join(merged, "thread", "left").select("node", F.coalesce("to", "thread").alias("component"))
            return self.table.upsert(_written(moved.unionByName(come), work))
        finally:
            _drop(self.spark, work)
