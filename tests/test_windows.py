"""Windows of streams are issued once when they are closed, or at once and then corrected; both equal a batch over all rows."""

import datetime
import random

from pyspark.sql import functions as F

from postmill.streaming import cycle, flows

START = datetime.datetime(2024, 1, 1)
SCHEMA = "id long, at timestamp, user long, value double"


def events(seed=4, n=300):
    draw = random.Random(seed)
    # half of the rows are of user 1; times tie and rows repeat
    rows = [(k % 250, START + datetime.timedelta(minutes=15 * draw.randrange(900)), 1 if draw.random() < 0.5 else draw.randrange(2, 9), draw.choice([None, 1.0, 2.5])) for k in range(n)]
    return sorted(rows, key=lambda r: r[1])


def put(spark, rows, path):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def listed(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_closed_windows_of_any_split_equal_a_batch(spark, tmp_path):
    rows, found = events(), {}
    windows = lambda e: flows.tumbling(e, "6 hours", late="1 hour", keys=("user",))
    for name, cuts in {"one": [0, 300], "three": [0, 90, 91, 300]}.items():
        path, folder = str(tmp_path / name / "in"), str(tmp_path / name / "work")
        for a, b in zip(cuts, cuts[1:]):
            put(spark, rows[a:b], path)
            found[name] = listed(flows.closed_windows(flows.stream(spark, path), windows, folder, flush=b == 300))
    batch = spark.createDataFrame(rows, SCHEMA).groupBy(F.window("at", "6 hours").start.alias("start"), "user").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    assert found["one"] == found["three"] == listed(batch)


def test_open_windows_are_not_issued_and_state_is_dropped(spark, tmp_path):
    path, folder = str(tmp_path / "in"), str(tmp_path / "work")
    put(spark, events(), path)
    windows = lambda e: flows.tumbling(e, "6 hours", late="1 hour", keys=("user",))
    before = flows.closed_windows(flows.stream(spark, path), windows, folder)
    last = before.agg(F.max("start")).first()[0]
    assert last is None or last + datetime.timedelta(hours=6) <= events()[-1][1] - datetime.timedelta(hours=1)
    state = lambda: spark.read.format("statestore").load(f"{folder}/checkpoint").count()
    assert state() > 0
    flows.closed_windows(flows.stream(spark, path), windows, folder, flush=True)
    assert state() == 1  # the window of the row that flushes


def test_corrections_sum_up_to_a_batch(spark, tmp_path):
    path, folder = str(tmp_path / "in"), str(tmp_path / "changes")
    rows = events()
    random.Random(1).shuffle(rows)  # late rows of any age
    rows += [(1000, None, 1, 1.0), (1001, START, None, 2.0), (1002, START, None, None)]
    for a, b in ((0, 150), (150, 151), (151, 303), (303, 303)):
        if a < b:
            put(spark, rows[a:b], path)
        flows.corrections(flows.stream(spark, path), "12 hours", ("user",), folder)
    changes = spark.read.parquet(folder)
    summed = changes.groupBy("start", "user").agg(F.sum(F.col("n") - F.coalesce("old_n", F.lit(0))).alias("n"), F.sum(F.col("total") - F.coalesce("old_total", F.lit(0.0))).alias("total"))
    batch = spark.createDataFrame(rows, SCHEMA).where("at is not null").groupBy(F.window("at", "12 hours").start.alias("start"), "user").agg(F.count("*").alias("n"), F.coalesce(F.sum("value"), F.lit(0.0)).alias("total"))
    assert listed(summed) == listed(batch)
    last = changes.groupBy("start", "user").agg(F.max_by("n", "batch").alias("n"), F.max_by("total", "batch").alias("total"))
    assert listed(last) == listed(batch)
    old = {(r.start, r.user, r.n) for r in changes.collect()}
    assert all((r.start, r.user, r.old_n) in old for r in changes.where("old_n is not null").collect())  # what is taken back was issued


def test_the_lowest_of_equal_keys_stays(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    put(spark, [(5, START, 1, 2.0), (3, START, 1, 9.0), (3, START, 1, None), (7, START, None, 1.0), (8, START, None, 0.5)], path)
    flows.ingest(flows.stream(spark, path), out, str(tmp_path / "check"), ["user"])
    assert {(r.user, r.id, r.value) for r in spark.read.parquet(out).collect()} == {(1, 3, None), (None, 7, 1.0)}


def test_lines_of_a_repeated_batch_replace_themselves(spark, tmp_path):
    rows = spark.createDataFrame([(1,), (2,)], "id long")
    for number in (0, 1, 1):
        cycle.append_lines(rows, str(tmp_path / "log"), number)
    assert spark.read.json(str(tmp_path / "log")).count() == 4
