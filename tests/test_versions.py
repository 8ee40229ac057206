"""Versioned tables: upserts, races, untouched buckets, differences and the sanity pass."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from postmill.sources import versions as V

ROWS = "id long, name string, amount double"


def table(spark, tmp_path, name="t", buckets=8):
    return V.VersionedTable(spark, f"file://{tmp_path}/{name}", ["id"], buckets)


def content(df):
    return {r.id: (r.name, r.amount) for r in df.collect()}


def test_upserts_equal_a_dictionary(spark, tmp_path):
    draw, t, state = random.Random(1), table(spark, tmp_path), {}
    assert t.versions() == [] and t.manifest()["version"] == 0
    for n in range(1, 5):
        put = {draw.randrange(60): (draw.choice(["a", None, "é"]), draw.choice([None, 1.5, float("nan")])) for _ in range(20)}
        gone = [draw.randrange(60) for _ in range(6)]
        rows = spark.createDataFrame([(k, *v) for k, v in put.items()], ROWS)
        assert t.upsert(rows, spark.createDataFrame([(k, 1) for k in gone], "id long, other int")) == n
        state = {k: v for k, v in state.items() if k not in gone or k in put} | put
        assert str(sorted(content(t.read()).items())) == str(sorted(state.items()))
        assert V.sanity(t).count() == 0
    assert t.upsert(spark.createDataFrame([], ROWS)) == 4
    key = next(iter(state))
    assert [r.id for r in t.where_key(key).collect()] == [key] and t.where_key(999).count() == 0
    assert len(t.where_key(key).inputFiles()) < len(t.read().inputFiles())


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    t = table(spark, tmp_path, buckets=16)
    t.upsert(spark.range(500).select("id", F.lit("x").alias("name"), F.lit(1.0).alias("amount")))
    before = t.manifest()["buckets"]
    t.upsert(spark.createDataFrame([(7, "y", 2.0), (7, "z", 1.0), (9001, None, None)], ROWS))
    after = t.manifest()["buckets"]
    assert 1 <= sum(before[b]["folder"] != after[b]["folder"] for b in before) <= 2
    changed = {r.id: r.change for r in V.difference(t, t, 1, 2).collect()}
    assert changed == {7: "changed", 9001: "added"}
    assert len(V.changed_buckets(t.manifest(1), t.manifest(2))) <= 2 and V.difference(t, t, 2, 2).count() == 0
    assert content(t.where_key(7)) == {7: ("z", 1.0)}  # the greatest of rows that repeat a key
    t.upsert(spark.createDataFrame([], ROWS), spark.createDataFrame([(7,), (12345,)], "id long"))
    assert {r.id: r.change for r in V.difference(t, t, 1, 3).collect()} == {7: "removed", 9001: "added"}
    assert t.read(1).count() == 500 and t.read().count() == 500


def test_two_writers_lose_no_update(spark, tmp_path):
    t = table(spark, tmp_path, buckets=2)  # they meet in the same buckets
    t.upsert(spark.range(20).select("id", F.lit("0").alias("name"), F.lit(0.0).alias("amount")))
    failed = []

    def write(who):
        try:
            for k in range(3):
                table(spark, tmp_path, buckets=2).upsert(spark.createDataFrame([(100 * who + k, str(who), 1.0), (k, str(who), 2.0)], ROWS))
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=write, args=(w,)) for w in (1, 2)]
    [x.start() for x in threads]
    [x.join() for x in threads]
    assert not failed and t.versions()[-1] == 7
    rows = content(t.read())
    assert {100, 101, 102, 200, 201, 202} <= rows.keys() and len(rows) == 26 and V.sanity(t).count() == 0


def test_a_taken_version_is_a_conflict(spark, tmp_path):
    t = table(spark, tmp_path)
    t.upsert(spark.createDataFrame([(1, "a", 1.0)], ROWS))
    with pytest.raises(V.Conflict):
        t._commit(1, t.manifest())
    with pytest.raises(ValueError):
        t.upsert(spark.createDataFrame([(None, "a", 1.0)], ROWS))
    assert t.versions() == [1]


def test_equal_tables_are_equal_whatever_their_files(spark, tmp_path):
    rows = spark.range(300).select("id", F.col("id").cast("string").alias("name"), F.rand(3).alias("amount")).cache()
    a, b = table(spark, tmp_path, "a"), table(spark, tmp_path, "b")
    a.upsert(rows.repartition(3))
    b.upsert(rows.where("id < 100"))
    b.upsert(rows.where("id >= 100").orderBy(F.desc("id")))
    assert V.changed_buckets(a.manifest(), b.manifest()) == [] and V.difference(a, b).count() == 0
    b.upsert(spark.createDataFrame([(5, "other", 0.0)], ROWS))
    assert [(r.id, r.change) for r in V.difference(a, b).collect()] == [(5, "changed")]
    spark.createDataFrame([(5, "damaged", 0.0)], ROWS).write.mode("overwrite").parquet(b.manifest()["buckets"][str(V.changed_buckets(a.manifest(), b.manifest())[0])]["folder"])
    assert [r.problem for r in V.sanity(b).collect()] == ["wrong_rows"]
