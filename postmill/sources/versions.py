"""A keyed table with versions: Parquet in hash buckets, a manifest a version, optimistic commits, differences of versions.

A commit rewrites the buckets of the keys that it changes and no others; the manifest names the folder, the number of rows
and a fingerprint of each bucket. The next version's manifest is created only if nobody has created it: the loser of a
race takes the winner's version as its base and repeats only the buckets that both have touched. Versions are compared by
fingerprints first, so that equal buckets are never read.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
#: How often a commit that loses the race for a version begins again.
TRIES = 20


class Conflict(RuntimeError):
    """A version was asked for that somebody else has written."""


class VersionedTable:
    """Rows by key under ``root``, a folder that all executors share. Key columns are not null; rows with a null key are refused."""

    def __init__(self, spark: SparkSession, root: str, key: list[str], buckets: int = BUCKETS):
        self.spark, self.root, self.key, self.buckets = spark, root.rstrip("/"), key, buckets

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def _fs(self):
        return self._path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        folder = self._path(f"{self.root}/versions")
        if not self._fs().exists(folder):
            return []
        return sorted(int(s.getPath().getName()[1:-5]) for s in self._fs().listStatus(folder) if s.getPath().getName().startswith("v"))

    def manifest(self, version: int | None = None) -> dict:
        """{version, schema, buckets: {bucket: {folder, rows, print}}}; version 0 is the empty table."""
        found = self.versions()
        version = (found[-1] if found else 0) if version is None else version
        if not version:
            return {"version": 0, "schema": None, "buckets": {}}
        text = self.spark.read.text(f"{self.root}/versions/v{version:012d}.json", wholetext=True).first()[0]
        return json.loads(text)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*[F.col(k) for k in self.key]), F.lit(self.buckets)).cast("int")

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a version, the latest if not given; of some buckets, if given."""
        m = self.manifest(version)
        return self._rows(m, sorted(map(int, m["buckets"])) if buckets is None else buckets)

    def _rows(self, m: dict, buckets: list[int]) -> DataFrame:
        from pyspark.sql.types import StructType

        if m["schema"] is None:
            raise ValueError("the table is empty")
        schema = StructType.fromJson(m["schema"])
        folders = [m["buckets"][str(b)]["folder"] for b in buckets if str(b) in m["buckets"]]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def where_key(self, *values) -> DataFrame:
        """The row of one key: only its bucket is read, and there only row groups that may hold the key."""
        m = self.manifest()
        one = self.spark.range(1).select(*[F.lit(v).cast(self._kind(m, k)).alias(k) for k, v in zip(self.key, values)])
        rows = self._rows(m, [one.select(self.bucket()).first()[0]])
        for k, v in zip(self.key, values):
            rows = rows.where(F.col(k) == F.lit(v))
        return rows

    def _kind(self, m: dict, column: str):
        from pyspark.sql.types import StructType

        return StructType.fromJson(m["schema"])[column].dataType

    def upsert(self, changes: DataFrame, gone: DataFrame | None = None) -> int:
        """Put rows by key and delete the keys of ``gone``; a key in both is put. Gives the new version, or the latest if nothing is asked.

        Of rows that repeat a key the greatest, column by column, stays. Columns are those of the first commit.
        """
        clash = next((c for c in ("_bucket", "_put") if c in changes.columns), None)
        if clash:
            raise ValueError(f"{clash} is no free name")
        if not changes.where(" or ".join(f"`{k}` is null" for k in self.key)).isEmpty():
            raise ValueError("a key is null")
        columns = changes.columns
        put = changes.groupBy(*self.key).agg(F.max(F.struct(*[F.col(c) for c in columns])).alias("r")).select("r.*", F.lit(True).alias("_put"))
        if gone is not None:
            keys = gone.select(*self.key).distinct().join(put.select(*self.key), self.key, "left_anti")
            put = put.unionByName(keys.withColumn("_put", F.lit(False)), allowMissingColumns=True)
        staged = f"{self.root}/staged/{uuid.uuid4().hex}"
        put.withColumn("_bucket", self.bucket()).repartition("_bucket", *self.key).write.partitionBy("_bucket").parquet(staged)
        asked = self.spark.read.schema(put.withColumn("_bucket", F.lit(0)).schema).parquet(staged)
        touched = sorted(r[0] for r in asked.select("_bucket").distinct().collect())  # a number a bucket
        done: dict[str, tuple[str | None, dict]] = {}  # bucket: (folder that it was made from, what was made)
        try:
            for _ in range(TRIES):
                base = self.manifest()
                if not touched:
                    return base["version"]
                old = {b: base["buckets"].get(str(b), {}).get("folder") for b in touched}
                again = [b for b in touched if str(b) not in done or done[str(b)][0] != old[b]]
                if again:
                    made = self._made(base, asked.where(F.col("_bucket").isin(again)), columns)
                    done |= {str(b): (old[b], made.get(str(b))) for b in again}
                merged = {b: x for b, x in (base["buckets"] | {b: x for b, (_, x) in done.items()}).items() if x}
                try:
                    return self._commit(base["version"] + 1, {"version": base["version"] + 1, "schema": base["schema"] or json.loads(changes.schema.json()), "buckets": merged})
                except Conflict:
                    continue
            raise Conflict(f"{TRIES} commits in turn were overtaken")
        finally:
            self._fs().delete(self._path(staged), True)

    def _made(self, base: dict, asked: DataFrame, columns: list[str]) -> dict:
        """Write the new state of the asked buckets; {bucket: {folder, rows, print}} of those that have rows."""
        put = asked.where("_put").select("_bucket", *columns)
        if base["schema"] is not None:
            touched = [r[0] for r in asked.select("_bucket").distinct().collect()]
            kept = self._rows(base, touched).select(self.bucket().alias("_bucket"), *columns).join(asked.select(*self.key), self.key, "left_anti")
            put = kept.select("_bucket", *columns).unionByName(put)
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        # a bucket is cut by key, too, so that no task has to write all of a large one
        put.repartition("_bucket", *self.key).sortWithinPartitions("_bucket", *self.key).write.partitionBy("_bucket").parquet(folder)
        schema = put.schema
        found = self.spark.read.schema(schema).parquet(folder).groupBy("_bucket").agg(F.count("*").alias("n"), fingerprint(columns).alias("p")).collect()
        return {str(r["_bucket"]): {"folder": f"{folder}/_bucket={r['_bucket']}", "rows": r["n"], "print": r["p"]} for r in found}

    def _commit(self, version: int, manifest: dict) -> int:
        target = self._path(f"{self.root}/versions/v{version:012d}.json")
        draft = self._path(f"{self.root}/versions/.{uuid.uuid4().hex}")
        fs = self._fs()
        out = fs.create(draft)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        options = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.spark._jsc.hadoopConfiguration())
        try:  # without OVERWRITE, a rename onto a file that is there fails
            none = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
            options.rename(fs.makeQualified(draft), fs.makeQualified(target), none)
        except Exception as e:
            fs.delete(draft, False)
            if "FileAlreadyExists" in str(e) or fs.exists(target):
                raise Conflict(f"version {version} is there") from e
            raise
        return version


def fingerprint(columns: list[str]) -> Column:
    """A text over all rows of a group, whatever their order: sums of two hashes of whole rows; a sum may wrap, but never fails."""
    part = lambda h, at: F.sum(F.shiftrightunsigned(h, at).bitwiseAND(F.lit(0xFFFFFFFF)).cast("decimal(20,0)"))
    h1, h2 = F.xxhash64(*columns), F.xxhash64(F.lit(1), *columns)
    return F.concat_ws("-", *[part(h, at).cast("string") for h in (h1, h2) for at in (0, 32)])


def changed_buckets(left: dict, right: dict) -> list[int]:
    """The buckets whose rows differ between two manifests; equal folders or equal fingerprints are equal rows."""
    same = lambda a, b: a is not None and b is not None and (a["folder"] == b["folder"] or (a["rows"], a["print"]) == (b["rows"], b["print"]))
    names = left["buckets"].keys() | right["buckets"].keys()
    return sorted(int(b) for b in names if not same(left["buckets"].get(b), right["buckets"].get(b)))


def difference(left: VersionedTable, right: VersionedTable, old: int | None = None, new: int | None = None) -> DataFrame:
    """(the key, change: added, removed or changed) between two versions of one table, or of two with the same key and buckets.

    Only buckets whose fingerprints differ are read, and of them the keys and a hash of the row.
    """
    if (left.key, left.buckets) != (right.key, right.buckets):
        raise ValueError("tables of other keys or buckets can't be compared")
    a, b = left.manifest(old), right.manifest(new)
    schema = a["schema"] or b["schema"]
    if schema is None:
        raise ValueError("both tables are empty")
    buckets = changed_buckets(a, b)
    columns = [f["name"] for f in schema["fields"]]
    part = lambda t, m: t._rows({"schema": schema} | {"buckets": m["buckets"]}, buckets).select(*left.key, F.struct(F.xxhash64(*columns), F.xxhash64(F.lit(1), *columns)).alias("h"))
    both = part(left, a).withColumnRenamed("h", "h1").join(part(right, b).withColumnRenamed("h", "h2"), left.key, "full")
    change = F.when(F.col("h1").isNull(), "added").when(F.col("h2").isNull(), "removed").when(F.col("h1") != F.col("h2"), "changed")
    return both.select(*left.key, change.alias("change")).where("change is not null")


def sanity(table: VersionedTable, version: int | None = None) -> DataFrame:
    """(bucket, problem): buckets whose rows are not what the manifest says: wrong_rows, wrong_content, foreign_key or repeated_key; no row, if all is well."""
    m = table.manifest(version)
    if m["schema"] is None:
        return table.spark.createDataFrame([], "bucket int, problem string")
    columns = [f["name"] for f in m["schema"]["fields"]]
    said = table.spark.createDataFrame([(int(b), x["rows"], x["print"]) for b, x in m["buckets"].items()], "bucket int, rows long, print string")
    parts = [table._rows(m, [int(b)]).withColumn("_at", F.lit(int(b))) for b in m["buckets"]]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    twice = every.groupBy("_at", *table.key).agg(F.count("*").alias("n")).groupBy(F.col("_at").alias("bucket")).agg(F.max("n").alias("most"))
    seen = every.groupBy(F.col("_at").alias("bucket")).agg(F.count("*").alias("n"), fingerprint(columns).alias("p"), F.bool_and(F.col("_at") == table.bucket()).alias("own"))
    both = said.join(seen, "bucket", "left").join(twice, "bucket", "left")
    problem = F.when(F.col("n").isNull() | (F.col("n") != F.col("rows")), "wrong_rows").when(F.col("p") != F.col("print"), "wrong_content").when(~F.col("own"), "foreign_key").when(F.col("most") > 1, "repeated_key")
    return both.select("bucket", problem.alias("problem")).where("problem is not null")
