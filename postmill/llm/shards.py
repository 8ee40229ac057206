"""Size-tiered shards of a table under versioned manifests, in DataFrame functions only.

Arrivals are appended as small immutable Parquet shards. Compaction merges runs of similarly sized shards into files of
up to the target size, and cuts shards of more than twice that at their row groups, without a shuffle. Readers see what
the latest manifest lists; a manifest is written aside and renamed into place. On file systems whose rename is atomic and
fails onto an existing file (HDFS, local disks) a commit is atomic, and of two writers one wins; object stores whose
rename is a copy give no such promise, and take one writer at a time.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MIB = 1 << 20


class ShardStore:
    """A store in the folder ``root``, any path that Spark can write."""

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = 128 * MIB, fan_in: int = 4):
        self.spark, self.root, self.target, self.fan_in = spark, root.rstrip("/"), target_bytes, fan_in
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def _fs(self):
        return self._path(self.root).getFileSystem(self._conf)

    def _files(self, folder: str) -> list[tuple[str, int]]:
        """(file, bytes) of the Parquet files of a folder."""
        found = self._fs().listStatus(self._path(folder))
        return sorted((str(f.getPath().toString()), int(f.getLen())) for f in found if f.getPath().getName().endswith(".parquet"))

    def versions(self) -> list[int]:
        folder = self._path(f"{self.root}/manifests")
        if not self._fs().exists(folder):
            return []
        names = [f.getPath().getName() for f in self._fs().listStatus(folder)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """The manifest of a version, the latest if not given; an empty one before the first commit."""
        versions = self.versions()
        if not versions:
            return {"version": 0, "schema": None, "shards": []}
        version = versions[-1] if version is None else version
        stream = self._fs().open(self._path(f"{self.root}/manifests/v{version:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _commit(self, base: dict, schema: str, shards: list[dict]) -> int:
        """Publish version base + 1; raises if another writer has published it."""
        version = base["version"] + 1
        aside = self._path(f"{self.root}/manifests/.{uuid.uuid4().hex}")
        stream = self._fs().create(aside, True)
        stream.write(bytearray(json.dumps({"version": version, "schema": schema, "shards": shards}).encode()))
        stream.close()
        none = self.spark.sparkContext._gateway.new_array(getattr(self._jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri() if ":" in self.root else self._fs().getUri(), self._conf)
        context.rename(aside, self._path(f"{self.root}/manifests/v{version:012d}.json"), none)
        return version

    def _write(self, rows: DataFrame) -> list[dict]:
        folder = f"{self.root}/shards/{uuid.uuid4().hex}"
        rows.write.option("compression", "zstd").parquet(folder)
        return [{"path": p, "bytes": n} for p, n in self._files(folder)]

    def append(self, rows: DataFrame) -> int:
        """Add an arrival as it is partitioned; gives the new version. An empty arrival adds no rows."""
        base = self.manifest()
        return self._commit(base, rows.schema.json(), base["shards"] + self._write(rows))

    def tier(self, n_bytes: int) -> int:
        """How many times ``fan_in`` goes into target / size: 0 at the target size, larger for smaller shards."""
        tier, size = 0, max(1, n_bytes)
        while size * self.fan_in <= self.target:
            tier, size = tier + 1, size * self.fan_in
        return tier

    def compact(self) -> int:
        """Merge tiers with at least ``fan_in`` shards until none has; one new version, the old one if nothing to do."""
        base = self.manifest()
        shards, merged = base["shards"], False
        large = [s for s in shards if s["bytes"] > 2 * self.target]
        parts = self._write(self._rows(base["schema"], large)) if large else []  # a file a split, as Spark reads them
        if len(parts) > len(large):
            self._same_count(base["schema"], parts, large)
            shards, merged = [s for s in shards if s not in large] + parts, True
        while True:
            tiers: dict[int, list[dict]] = {}
            for shard in shards:
                if shard["bytes"] <= self.target // 2:
                    tiers.setdefault(self.tier(shard["bytes"]), []).append(shard)
            run = next((tiers[t] for t in sorted(tiers, reverse=True) if len(tiers[t]) >= self.fan_in), None)
            if run is None:
                break
            # a tier goes as one job; its files become as many as the target size asks, fewer than before, as each is half of it at most
            total = sum(s["bytes"] for s in run)
            files = max(1, -(-total // self.target))
            new = self._write(self._rows(base["schema"], run).coalesce(files))
            self._same_count(base["schema"], new, run)
            taken = {s["path"] for s in run}
            shards, merged = [s for s in shards if s["path"] not in taken] + new, True
        return self._commit(base, base["schema"], shards) if merged else base["version"]

    def _rows(self, schema: str, shards: list[dict]) -> DataFrame:
        from pyspark.sql.types import StructType

        return self.spark.read.schema(StructType.fromJson(json.loads(schema))).parquet(*[s["path"] for s in shards])

    def _same_count(self, schema: str, new: list[dict], old: list[dict]) -> None:
        if self._rows(schema, new).count() != self._rows(schema, old).count():  # from the files' footers
            raise RuntimeError("a merge changed the number of rows; nothing was committed")

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the latest if not given."""
        found = self.manifest(version)
        if not found["shards"]:
            raise ValueError("the store is empty")
        return self._rows(found["schema"], found["shards"])

    def vacuum(self, keep: int = 1, hours: float = 24.0) -> int:
        """Delete shards that none of the last ``keep`` versions lists, and older manifests; gives the number of shards.

        Shards and manifests that no version lists, left by commits that failed, go once they are ``hours`` old.
        """
        versions = self.versions()
        live = {s["path"] for v in versions[-keep:] for s in self.manifest(v)["shards"]}
        dead = {s["path"] for v in versions[:-keep] for s in self.manifest(v)["shards"]} - live
        late = time.time() * 1000 - hours * 3_600_000
        fs, found = self._fs(), self._path(f"{self.root}/shards")
        files = fs.listFiles(found, True) if fs.exists(found) else None
        while files is not None and files.hasNext():
            f = files.next()
            name = str(f.getPath().toString())
            if name.endswith(".parquet") and name not in live and f.getModificationTime() <= late:
                dead.add(name)
        for path in dead:
            fs.delete(self._path(path), False)
        for f in fs.listStatus(self._path(f"{self.root}/manifests")) if versions else []:
            if f.getPath().getName().startswith(".") and f.getModificationTime() <= late:
                fs.delete(f.getPath(), False)
        for v in versions[:-keep]:
            fs.delete(self._path(f"{self.root}/manifests/v{v:012d}.json"), False)
        return len(dead)


def shard_in_arrivals(spark: SparkSession, rows: DataFrame, root: str, key: str, arrivals: int = 4, target_bytes: int = 128 * MIB) -> ShardStore:
    """A store of ``rows`` that came as ``arrivals`` batches (by a hash of ``key``; null keys come first), then compacted.

    The rows are read once and written into a folder an arrival; each folder is then committed as a version. Every row is
    stored once, whatever its nulls, length or repetition; column names are free. An empty table is a store whose version
    lists shards without rows.
    """
    store = ShardStore(spark, root, target_bytes)
    name = "arrival"
    while name in rows.columns:
        name += "_"
    folder = f"{store.root}/shards/{uuid.uuid4().hex}"
    numbered = rows.withColumn(name, F.coalesce(F.pmod(F.xxhash64(key), F.lit(arrivals)), F.lit(0)))
    numbered.write.option("compression", "zstd").partitionBy(name).parquet(folder)
    found = [store._files(f"{folder}/{name}={k}") if store._fs().exists(store._path(f"{folder}/{name}={k}")) else [] for k in range(arrivals)]
    for files in found if any(found) else []:
        base = store.manifest()
        store._commit(base, rows.schema.json(), base["shards"] + [{"path": p, "bytes": n} for p, n in files])
    if not any(found):
        store.append(rows)
    store.compact()
    store.vacuum()
    return store
