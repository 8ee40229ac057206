"""Near-dedup, line dedup, decontamination, shards and the pipeline against brute force and on edge cases."""

import random

import pytest
from pyspark.sql import functions as F

from postmill.llm import decontaminate, line_dedup, near_dup, queries, quality, shards
from postmill.llm.components import connected_components
from tests.llm.helpers import contained, near_groups, shingle_set, without_repeats

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{k}" for k in range(400)]


def some_text(draw, n):
    return " ".join(draw.choice(WORDS) for _ in range(n))


def corpus():
    """Texts with exact and near copies, a chain of edits, repeated passages, and odd cases."""
    draw = random.Random(5)
    texts = [some_text(draw, draw.randrange(1, 120)) for _ in range(40)]
    base = some_text(draw, 100).split()
    for _ in range(30):  # a large group of near copies, each edited in a few places
        copy = list(base)
        for _ in range(draw.randrange(1, 5)):
            copy[draw.randrange(100)] = draw.choice(WORDS)
        texts.append(" ".join(copy))
    chain = list(base)
    for k in range(0, 100, 4):  # drifts away from the base: linked through its neighbours only
        chain[k] = "x" + chain[k]
        texts.append(" ".join(chain))
    texts += [texts[3], texts[3].upper(), texts[3] + "  ", "one two three", "ONE two\tthree", "four", "", " \n ", None, some_text(draw, 30_000), "a" * 100_000]
    return dict(enumerate(texts))


def frame(spark, texts, **more):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts.items()]
    return spark.createDataFrame(rows, DOCS).select("*", *[F.lit(v).alias(k) for k, v in more.items()])


def test_near_duplicates_equal_brute_force(spark):
    texts = corpus()
    got = {r.doc_id: r for r in near_dup.near_duplicates(spark, frame(spark, texts, id=1, n=2, key=3, bands=4)).collect()}
    want = near_groups(texts)
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(shingle_set(t)) for i, t in texts.items()}
    assert all(r.kept == (r.component_id == r.doc_id) for r in got.values())


def test_near_duplicates_in_blocks_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "PAIRS", 3)
    monkeypatch.setattr(near_dup, "BLOCK", 4)
    texts = {i: t for i, t in corpus().items() if i < 95}
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(spark, frame(spark, texts)).collect()}
    assert got == near_groups(texts)


def test_near_duplicates_edge_rows(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f"), (3, None), (None, "a b c d e f"), (None, None), (4, "p q"), (5, "x y z v w u"), (2, "x y z v w u")]
    got = near_dup.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add((r.component_id, r.kept))
    assert by == {1: {(1, True)}, 2: {(1, False)}, 3: {(3, True)}, None: {(None, True)}, 4: {(4, True)}, 5: {(1, False)}}
    assert near_dup.near_duplicates(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_bands_of_a_set_use_both_ends():
    import numpy as np

    one = np.unique(near_dup.mix(np.arange(1, 200, dtype=np.uint64)))
    other = np.unique(np.append(one[:-10], near_dup.mix(np.arange(1000, 1010, dtype=np.uint64))))
    same = near_dup.bands(one) == near_dup.bands(other)
    assert same[: near_dup.BANDS // 2].any() and same[near_dup.BANDS // 2 :].any()


def test_components(spark):
    draw = random.Random(2)
    links = [(draw.randrange(60), draw.randrange(60)) for _ in range(40)] + [(k, k + 1) for k in range(100, 160)] + [(200, k) for k in range(201, 260)] + [(1, 1), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark, spark.createDataFrame(links, "a long, b long")).collect()}
    from tests.llm.helpers import smallest_reachable

    real = [(a, b) for a, b in links if a is not None and a != b]
    want = smallest_reachable({x for p in real for x in p}, real)
    assert got == want
    assert connected_components(spark, spark.createDataFrame([], "a long, b long")).count() == 0


def lines_corpus():
    draw = random.Random(9)
    passage = [some_text(draw, 20) for _ in range(5)]
    texts = {}
    for i in range(40):
        lines = [some_text(draw, draw.randrange(1, 8)) for _ in range(draw.randrange(0, 6))]
        if i % 3 == 0:
            at = draw.randrange(len(lines) + 1)
            lines[at:at] = passage if i % 2 else passage[1:]
        if i % 7 == 0:
            lines += ["", "  same ", "same", "same", " ", "same", "same"]
        texts[i] = "\n".join(lines)
    texts |= {50: None, 51: "", 52: "\n\n\n", 53: "a\nb", 54: texts[3], 55: "\n".join(some_text(draw, 3) for _ in range(5000))}
    return texts


def test_lines_equal_brute_force(spark):
    texts = lines_corpus()
    out = line_dedup.dedup_lines(spark, frame(spark, texts, lines=1, row=2, at=3, cover=4, n_lines=9))
    assert {r.doc_id: r.text for r in out.collect()} == without_repeats(texts)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "lines", "row", "at", "cover", "n_lines", "n_removed"]


def test_lines_edge_rows(spark):
    t = "a\nb\nc"
    rows = [(2, t), (1, t), (1, t), (None, t), (None, t), (3, "a\nb"), (4, None)]
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in line_dedup.dedup_lines(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(2, "", 3, 3), (1, t, 3, 0), (1, t, 3, 0), (None, t, 3, 0), (None, t, 3, 0), (3, "a\nb", 2, 0), (4, None, 0, 0)], key=str)
    assert line_dedup.dedup_lines(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_texts_under_one_id_are_cut_and_dropped_by_themselves(spark):
    rows = [(1, "a\nb\nc"), (2, "x\na\nb\nc"), (2, "p\nq\nr\ns"), (2, "p\nq\nr\ns")]
    got = sorted((r.doc_id, r.text) for r in line_dedup.dedup_lines(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, "a\nb\nc"), (2, "p\nq\nr\ns"), (2, "p\nq\nr\ns"), (2, "x")]
    own, other, third = "one two three four five six", "seven eight nine ten eleven twelve", "a b c d e f"
    rows = [(1, own, 0), (2, own, 1), (2, other, 2), (2, other, 3), (5, other, 4), (None, own, 5), (6, None, 6), (6, "", 7), (4, own, 8), (4, third, 9), (3, third, 10), (3, own, 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, t1 int").repartition(3)
    kept = sorted(r.t1 for r in near_dup.drop_near_duplicates(spark, docs).collect())
    assert kept == [0, 2, 3, 5, 6, 7, 10]
    items = spark.createDataFrame([(1, other)], "item_id long, text string")
    kept = sorted(r.t1 for r in decontaminate.drop_contaminated(spark, docs, items).collect())
    assert kept == [0, 1, 5, 6, 7, 8, 9, 10, 11]


def test_stage_drops_emptied_documents_and_counts_characters(spark):
    texts = {1: "a\nb\nc\nd", 2: "a\nb\nc", 3: "x\na\nb\nc", 4: "", 5: None}
    got = {r.doc_id: (r.text, r.n_chars) for r in line_dedup.drop_repeated_lines(spark, frame(spark, texts)).collect()}
    assert got == {1: ("a\nb\nc\nd", 7), 3: ("x", 1), 4: ("", 0), 5: (None, 0)}


def test_containment_equals_brute_force(spark):
    draw = random.Random(11)
    items = {i: some_text(draw, draw.randrange(1, 60)) for i in range(30)} | {30: None, 31: "", 32: "Zwei", 33: "drei, vier!"}
    texts = {}
    for i in range(60):
        words = some_text(draw, draw.randrange(0, 300)).split()
        if i % 2:
            part = (items[i % 30] or "").split()
            for _ in range(draw.randrange(0, 3)):
                part[draw.randrange(len(part))] = "edited"
            at = draw.randrange(len(words) + 1)
            words[at:at] = part
        texts[i] = ", ".join(words[:50]).upper() + " " + " \n".join(words[50:])
    texts |= {70: None, 71: "", 72: "eins (zwei)", 73: "drei-vier", 74: some_text(draw, 20_000) + " " + items[7]}
    benchmark = spark.createDataFrame(list(items.items()), "item_id long, text string").withColumn("words", F.lit(1)).withColumn("h", F.lit(2))
    docs = frame(spark, texts, item=1, words=2, h=3)
    got = {(r.id, r.item) for r in decontaminate.contaminated_pairs(spark, docs, benchmark).collect()}
    assert got == contained(texts, items)
    rows = {r.doc_id: r for r in decontaminate.contamination(spark, docs, benchmark).collect()}
    assert len(rows) == len(texts) and {i for i, r in rows.items() if r.contaminated} == {i for i, _ in got}
    assert all(r.n_items == len([x for x in r.item_ids.split(",") if x]) for r in rows.values())


def test_containment_of_empty_tables(spark):
    none_docs, none_items = spark.createDataFrame([], DOCS), spark.createDataFrame([], "item_id long, text string")
    docs, items = frame(spark, {1: "a b c d e f", 2: None}), spark.createDataFrame([(1, "a b c d e f"), (None, "a b")], "item_id long, text string")
    assert decontaminate.contamination(spark, none_docs, items).count() == 0
    assert [r.contaminated for r in decontaminate.contamination(spark, docs, none_items).orderBy("doc_id").collect()] == [False, False]
    assert [r.contaminated for r in decontaminate.contamination(spark, docs.union(docs), items).orderBy("doc_id").collect()] == [True, True, False, False]


def test_shards_round_trip_and_commits(spark, tmp_path):
    rows = frame(spark, lines_corpus() | {None: "x"}, path=1, bytes=2).repartition(12)
    root = f"file://{tmp_path}/store"
    store = shards.ShardStore(spark, root, target_bytes=1 << 20, fan_in=2)
    first = store.append(rows.where("doc_id < 20"))
    second = store.append(rows.where("doc_id >= 20 or doc_id is null"))
    before = len(store.manifest()["shards"])
    third = store.compact()
    assert (first, second, third) == (1, 2, 3) and store.versions() == [1, 2, 3]
    assert len(store.manifest()["shards"]) < before
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert same(store.read(), rows) and same(store.read(1), rows.where("doc_id < 20"))
    assert store.compact() == 3
    other = shards.ShardStore(spark, root)
    base = other.manifest()
    store.append(rows.limit(1))
    with pytest.raises(Exception, match="exist"):
        other._commit(base, base["schema"], [])
    assert store.vacuum() > 0 and store.versions() == [4] and store.read().count() == rows.count() + 1
    store._write(rows.limit(3))  # as a commit that failed leaves it
    assert store.vacuum() == 0 and store.vacuum(hours=-1) >= 1 and store.read().count() == rows.count() + 1
    whole = shards.shard_in_arrivals(spark, rows.withColumn("arrival", F.lit(7)), f"file://{tmp_path}/whole", "doc_id")
    assert same(whole.read(), rows.withColumn("arrival", F.lit(7)))
    assert whole.versions()[-1] == 4 or whole.versions()[-1] == 5
    empty = shards.shard_in_arrivals(spark, rows.limit(0), f"file://{tmp_path}/empty", "doc_id")
    assert empty.read().count() == 0 and empty.read().columns == rows.columns


def test_large_shards_are_cut_at_row_groups(spark, tmp_path):
    rows = spark.range(400_000).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("text")).coalesce(1)
    store = shards.ShardStore(spark, f"file://{tmp_path}/large", target_bytes=4 << 20)
    spark.sparkContext._jsc.hadoopConfiguration().set("parquet.block.size", str(1 << 20))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(4 << 20))
    try:
        store.append(rows)
        before = [s["bytes"] for s in store.manifest()["shards"]]
        store.compact()
    finally:
        spark.sparkContext._jsc.hadoopConfiguration().unset("parquet.block.size")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    after = [s["bytes"] for s in store.manifest()["shards"]]
    assert len(before) == 1 and len(after) > 1 and max(after) <= 8 << 20
    assert store.read().count() == 400_000 and store.read().distinct().count() == 400_000


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = queries.op4_quality(spark, sf).join(labels, "doc_id").where("held_out").collect()
    good = [r.predicted == 1 for r in rows if r.quality == 1]
    bad = [r.predicted == 0 for r in rows if r.quality == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) >= 0.8 * len(bad)
    assert docs.count() == queries.op4_quality(spark, sf).count()


def test_quality_scores_do_not_depend_on_partitions(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    docs = docs.union(docs.where("doc_id < 20").withColumn("text", F.concat(F.lit("zz "), "text")))  # ids with a second text
    one = sorted(tuple(r) for r in quality.score_quality(spark, docs.repartition(7, F.xxhash64("text")), labels.repartition(3)).collect())
    other = sorted(tuple(r) for r in quality.score_quality(spark, docs.coalesce(1).orderBy(F.desc("doc_id")), labels.coalesce(1)).collect())
    assert one == other


def test_quality_scores_equal_average_then_softmax():
    import numpy as np
    import pyarrow as pa

    draw = random.Random(6)
    texts = ["", "a", "žluťoučký kůň 🙂🙂", "a b", " \n ", "ž"] + [some_text(draw, draw.randrange(1, 60)) for _ in range(20)]
    found = quality.features(pa.array(texts))
    model = quality.fit([(k % 2, b, c) for k, (b, c, _) in enumerate(found)], epochs=2)
    got = quality.scores(pa.array(texts), *quality.folded(*model))
    vectors, out, bias = (x.astype(np.float64) for x in model)
    for k, (buckets, counts, n) in enumerate(found):
        mean = (counts[:, None] * vectors[buckets]).sum(0) / max(1, n)
        p = np.exp(mean @ out + bias)
        assert abs(p[1] / p.sum() - got[k]) < 1e-5
    alone = [quality.features(pa.array([t]))[0] for t in texts]  # a batch does not mix its texts
    assert all((a[0] == b[0]).all() and (a[1] == b[1]).all() and a[2] == b[2] for a, b in zip(alone, found))
    words = texts[2].split()
    assert found[2][2] == len(words) + len(words) - 1 + sum(len(texts[2]) - n + 1 for n in (2, 3, 4))  # code points, not bytes


def test_quality_edge_rows(spark):
    rows = [(1, "good words here"), (1, "good words here"), (None, "x"), (2, None), (3, ""), (4, "junk | " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("label", F.lit("z")).withColumn("id", F.lit(0))
    labels = spark.createDataFrame([(1, 1), (1, 1), (4, 0), (None, 1), (2, None), (3, 7)], "doc_id long, quality int")
    got = quality.score_quality(spark, docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert {r.held_out for r in got if r.doc_id is None} == {False}
    assert quality.score_quality(spark, docs.limit(0), labels.limit(0)).count() == 0
    kept = quality.keep_good(spark, frame(spark, {1: "a", 2: None}), labels.limit(0))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_pipeline_equals_brute_force(spark):
    import hashlib

    import public_tokenizers
    import tiktoken

    import corpus_pipeline
    from postmill.llm.bpe import read_ranks

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    accepted = {r.doc_id for r in quality.score_quality(spark, docs, labels).where("predicted = 1").collect()}
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id in accepted}
    cut = without_repeats(texts)
    texts = {i: t for i, t in cut.items() if t == texts[i] or t.strip(" \n")}
    groups = near_groups(texts)
    texts = {i: t for i, t in texts.items() if groups[i] == i}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    leaks = {i for i, _ in contained(texts, items)}
    texts = {i: t for i, t in texts.items() if i not in leaks}
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        codec = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(f.read()), special_tokens={})
    got = {r.doc_id: (list(r.ids), r.decoded_sha256) for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == {i: (codec.encode_ordinary(t), hashlib.sha256(t.encode()).hexdigest()) for i, t in texts.items()}


def test_recall_of_bands_near_the_threshold():
    """Of pairs of sets at a similarity of 0.75 to 0.80 all share a band."""
    import numpy as np

    draw = np.random.default_rng(8)
    for k in range(600):
        n = int(draw.integers(40, 400))
        common = -(-3 * n // 4) + int(draw.integers(0, max(1, n // 20)))
        values = near_dup.mix(draw.integers(0, 1 << 62, 2 * n, dtype=np.uint64))
        one = values[:n]
        extra = int(common / 0.75) - n if common / 0.75 > n else 0
        other = np.concatenate([one[:common], values[n : n + extra]])
        both = len(np.intersect1d(one, other)) / len(np.union1d(one, other))
        assert both >= 0.74
        assert both < 0.75 or (near_dup.bands(np.unique(one)) == near_dup.bands(np.unique(other))).any()
