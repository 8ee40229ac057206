"""The stages and the whole pipeline on nulls, empty and very long texts, repeated ids and extra columns."""

import hashlib

import corpus_pipeline
from postmill.llm import decontaminate, line_dedup, near_dup, quality

DOCS = "doc_id long, text string, lang string, source string, n_chars long, t1 string, `key` int, id string"


def text(word, n=12):
    return " ".join(f"{word}{k}" for k in range(n))


def tables(spark, folder):
    """A folder of tables whose labels accept every document, and the texts that should be left, by id."""
    passage = "\n".join((text("p"), text("q"), text("r")))
    near = text("n", 60)
    rows = [
        (1, near), (2, near.replace("n59", "other")), (2, text("own")), (2, text("own")), (3, None), (4, ""), (None, text("none")), (5, passage + "\n" + text("five")), (6, passage + "\n" + text("six")),
        (7, text("long", 30_000)), (8, text("start") + " " + text("bench", 8) + " " + text("end")), (8, text("eight")), (9, text("bench", 8)), (10, " \n "),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 7, "y") for i, t in rows], DOCS)
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(1, 9)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, text("bench", 8)), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    left = [(1, near), (2, text("own")), (2, text("own")), (3, ""), (4, ""), (None, text("none")), (5, passage + "\n" + text("five")), (6, text("six")), (7, text("long", 30_000)), (8, text("eight")), (10, " \n ")]
    return docs, sorted((str(i), hashlib.sha256(t.encode()).hexdigest()) for i, t in left)


def test_pipeline_on_odd_rows(spark, tmp_path):
    folder = f"file://{tmp_path}/tables"
    _, want = tables(spark, folder)
    got = corpus_pipeline.run(spark, folder).collect()
    assert sorted((str(r.doc_id), r.decoded_sha256) for r in got) == want


def test_stages_keep_columns_and_empty_tables(spark, tmp_path):
    folder = f"file://{tmp_path}/tables"
    docs, _ = tables(spark, folder)
    labels, items = spark.read.parquet(f"{folder}/labels.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    stages = [lambda d: quality.keep_good(spark, d, labels), lambda d: line_dedup.drop_repeated_lines(spark, d), lambda d: near_dup.drop_near_duplicates(spark, d), lambda d: decontaminate.drop_contaminated(spark, d, items)]
    for stage in stages:
        assert stage(docs).columns == docs.columns
        assert stage(docs.limit(0)).count() == 0
