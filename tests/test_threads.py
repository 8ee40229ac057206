"""Threads that grow batch by batch, and late links of two streams, against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from postmill.operators.threads import Threads, components
from postmill.streaming import flows


def lowest(edges):
    top = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(top[a], top[b])
            if (top[a], top[b]) != (low, low):
                top[a] = top[b] = low
                changed = True
    return top


def graph():
    draw = random.Random(8)
    name = lambda: f"<m{draw.randrange(90):02d}@x>"
    edges = [(name(), name()) for _ in range(60)]
    edges += [(f"<c{k:02d}>", f"<c{k + 1:02d}>") for k in range(30)]  # a chain
    edges += [("<hub>", f"<s{k}>") for k in range(40)] + [("<alone>", "<alone>")]
    draw.shuffle(edges)
    return edges


def test_components(spark, tmp_path):
    edges = graph() + [(None, "<x>"), ("<y>", None)]
    df = spark.createDataFrame(edges + edges[:5], "a string, b string")
    got = {r.node: r.component for r in components(df, f"file://{tmp_path}/c").collect()}
    want = lowest([e for e in edges if None not in e])
    assert got == {k: v for k, v in want.items() if k != "<alone>" and any(k in e and e[0] != e[1] for e in edges)}
    assert components(df.where("false"), f"file://{tmp_path}/c").count() == 0


@pytest.mark.parametrize("parts", [1, 4])
def test_any_cut_into_batches_gives_the_same_threads(spark, tmp_path, parts):
    edges = graph()
    threads = Threads(spark, f"file://{tmp_path}/t", buckets=4)
    for k in range(parts):
        threads.extend(spark.createDataFrame(edges[k::parts] + [(None, "<z>")], "a string, b string"))
    version = threads.extend(spark.createDataFrame(edges[:9], "a string, b string"))  # a batch again
    assert {r.node: r.component for r in threads.read().collect()} == lowest(edges)
    assert version == parts  # nothing new was written
    assert threads.extend(spark.createDataFrame([], "a string, b string")) == version


def test_late_links_do_not_depend_on_the_order_of_files(spark, tmp_path):
    draw = random.Random(3)
    rows = [(draw.randrange(4), k, 1_700_000_000 + draw.randrange(40_000), draw.choice(["n", "r"])) for k in range(160)] + [(None, 900, 1_700_000_000, "n"), (None, 901, 1_700_000_000, "r")]
    want = sorted((a[1], b[1]) for a in rows for b in rows if a[3] == "n" and b[3] == "r" and a[0] == b[0] is not None and -3600 <= b[2] - a[2] <= 7200)
    for name, order in (("up", lambda r: r[1]), ("down", lambda r: -r[1])):
        folder = f"file://{tmp_path}/{name}"
        some = sorted(rows, key=order)
        for k in range(0, len(some), 45):
            spark.createDataFrame(some[k : k + 45], "who long, id long, at long, kind string").coalesce(1).write.mode("append").parquet(f"{folder}/in")
        side = lambda kind, as_, folder=folder: flows.stream(spark, f"{folder}/in", 1).where(F.col("kind") == kind).select("who", F.col("id").alias(f"{as_}_id"), F.timestamp_seconds("at").alias(f"{as_}_at"))
        flows.to_parquet(flows.late_links(side("n", "notice"), side("r", "return"), "who", "1 hour", "2 hours"), f"{folder}/out", f"{folder}/checkpoint")
        assert sorted((r.notice_id, r.return_id) for r in spark.read.parquet(f"{folder}/out").collect()) == want
