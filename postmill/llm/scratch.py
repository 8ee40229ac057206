"""Lineage cuts in the folder that all executors share, and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a narrow table (a few numbers a row) may be broadcast: at most some 30 MB.
BROADCAST_ROWS = 500_000
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a temporary folder only where that is unset (local tests)."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    return _LOCAL.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="postmill-"))


def materialize(spark: SparkSession, df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back, so that a lost executor costs no recomputation."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, counted first; else as it is, for a shuffled join.

    Meant for materialized tables of a few numbers a row; the count stops as soon as the bound is passed.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def release(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote and that nothing reads any more."""
    for df in frames:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, size: int = 1 << 20) -> None:
    """Bound Arrow batches of whole texts by bytes, where the session sets no bound of its own; a longer text is a batch of its own.

    The bound stays set, as results are computed after the operator returns; it changes no rows, only how many go to Python at once.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(size))


def text_key(text: Column) -> list[Column]:
    """Two 64-bit hashes, named t1 and t2, that stand for a whole text; null and empty texts have keys, too."""
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")]
