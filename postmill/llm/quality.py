"""Quality classifier on supervised subword embeddings.

Hashed features of a text, its words, neighbouring word pairs (the xor of two word hashes, so a repeated word always
falls into one bucket) and character n-grams of 2 to 4 code points, have learned vectors; a document is the average of its
vectors, and a softmax over two classes reads it. Training is stochastic gradient descent in numpy on a bounded sample of
labelled rows, in an order that only their ids and texts decide, so partitions change no score. As the output is linear in the average, scoring needs one number a bucket, its vector times the difference of the two
class weights; whole texts are then scored by looking those numbers up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm.scratch import small_batches
from postmill.llm.word_sets import buffers, word_hashes

#: Buckets of the hashed features, and the number of dimensions of a vector.
BITS, DIMENSIONS = 18, 8
#: Labelled documents of each class that training takes, those of the smallest hash of their id.
SAMPLE_PER_CLASS = 1200
EPOCHS, STEP = 8, 40.0
ACCEPT = 0.7
_SHIFT = np.uint64(64 - BITS)
_SALT = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def _grams(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each family of features: the bucket of each feature, and n + 1 bounds of each text's features."""
    words, bounds = word_hashes(data, offsets, lower=False)
    yield ((words * _SALT[0]) >> _SHIFT).astype(np.int32), bounds
    pairs = ((words[1:] ^ words[:-1]) * _SALT[1] + _SALT[2]) >> _SHIFT
    yield _inner(pairs.astype(np.int32), bounds, 1)
    points, offsets = _code_points(data, offsets)
    for n in (2, 3, 4):
        if len(points) < n:
            yield np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
            continue
        code = points[: len(points) - n + 1] + np.uint32(n)
        for k in range(1, n):
            code *= np.uint32(0x01000193)
            code ^= points[k : len(points) - n + 1 + k]
        code *= np.uint32(0x9E3779B1)
        code ^= code >> np.uint32(15)
        code *= np.uint32(0x85EBCA6B)
        yield _inner((code >> np.uint32(32 - BITS)).astype(np.int32), offsets, n - 1)


def _code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of UTF-8 bytes, and the offsets of the texts counted in them."""
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4")
    if len(points) == len(data):
        return points, offsets
    return points, np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]


def _inner(codes: np.ndarray, bounds: np.ndarray, beyond: int) -> tuple[np.ndarray, np.ndarray]:
    """Without the features that reach from one text into the next; those get bucket -1 and no count."""
    if len(codes):
        for k in range(1, beyond + 1):
            at = bounds[1:-1] - k
            codes[at[(at >= 0) & (at < len(codes))]] = -1
    return codes, np.minimum(bounds, len(codes))


def features(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """For each text its distinct buckets, their counts, and the number of all its features."""
    data, offsets = buffers(texts)
    families = list(_grams(data, offsets))
    out = []
    for i in range(len(texts)):
        codes = np.concatenate([codes[bounds[i] : bounds[i + 1]] for codes, bounds in families])
        buckets, counts = np.unique(codes[codes >= 0], return_counts=True)
        out.append((buckets.astype(np.int32), counts.astype(np.int32), int(counts.sum())))
    return out


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = features(batch.column(1))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b.tobytes() for b, _, _ in found], pa.binary()), pa.array([c.tobytes() for _, c, _ in found], pa.binary()), batch.column(2), batch.column(3)], ["label", "buckets", "counts", "at", "id"])


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = EPOCHS, step: float = STEP, seed: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Learn the vectors, the softmax and its biases from (label, buckets, counts), in the order given and drawn by ``seed``.

    Without rows of both classes there is nothing to tell apart: all vectors are 0 and the biases name the only class.
    """
    labels = {label for label, _, _ in rows}
    if len(labels) < 2:
        lean = {frozenset(): 0.0, frozenset({0}): -5.0, frozenset({1}): 5.0}[frozenset(labels)]
        return np.zeros((1 << BITS, DIMENSIONS), np.float32), np.zeros((DIMENSIONS, 2), np.float32), np.array([0, lean], np.float32)
    draw = np.random.default_rng(seed)
    vectors = draw.normal(0, 0.1, (1 << BITS, DIMENSIONS)).astype(np.float32)
    out = draw.normal(0, 0.1, (DIMENSIONS, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    shares = [(counts / max(1, counts.sum())).astype(np.float32) for _, _, counts in rows]
    # a document's step is scaled by how much its own average moves, or long texts would hardly learn
    scale = [np.float32(1 / max(1e-6, float((s * s).sum()))) for s in shares]
    for epoch in range(epochs):
        rate = 1 - epoch / epochs
        for i in draw.permutation(len(rows)):
            label, buckets, _ = rows[i]
            share = shares[i]
            mean = share @ vectors[buckets]
            logits = mean @ out + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[label] -= 1
            back = out @ p
            out -= np.float32(0.2 * rate) * np.outer(mean, p)
            bias -= np.float32(0.02 * rate) * p
            vectors[buckets] -= np.float32(step * 0.02 * rate) * scale[i] * np.outer(share, back)
    return vectors, out, bias


def folded(vectors: np.ndarray, out: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, float]:
    """One number a bucket, and the bias of label 1: with two classes the softmax needs only the difference of the logits."""
    return (vectors @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def scores(texts: pa.Array, weights: np.ndarray, bias: float) -> np.ndarray:
    """The softmax probability of label 1 for each text; of an empty text by the bias alone."""
    data, offsets = buffers(texts)
    total, count = np.zeros(len(texts)), np.zeros(len(texts))
    table = np.append(weights, np.float32(0))  # the last number is for bucket -1
    for codes, bounds in _grams(data, offsets):
        some = np.flatnonzero(bounds[1:] > bounds[:-1])
        if len(some):
            total[some] += np.add.reduceat(table[codes], bounds[some], dtype=np.float64)
            count[some] += np.add.reduceat(codes >= 0, bounds[some], dtype=np.int64)
    return 1 / (1 + np.exp(-(total / np.maximum(1, count) + bias)))


def held_out(id_column: Column) -> Column:
    """Rows never learnt from: crc32(id as text) mod 4 is 2. A null id is not held out, and has no label."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, float]:
    """Weights and bias from a bounded sample: at most ``per_class`` labelled documents of either class.

    Ids that are labelled twice count with their smallest label; of an id with several texts the smallest text is learnt
    from; labels other than 0 and 1, and null ones, are left out. The sample is learnt in the order of the hash of its ids.
    """
    small_batches(spark)
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("id").isNotNull())
    known = known.where(~held_out(F.col("id"))).groupBy("id").agg(F.min("label").alias("label"))
    picked = [known.where(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(per_class) for k in (0, 1)]
    sample = F.broadcast(picked[0].union(picked[1]))  # at most 2 * per_class rows
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(sample, "id")
    rows = rows.groupBy("id", "label").agg(F.min("text").alias("text")).select("label", "text", F.xxhash64("id").alias("at"), "id")
    found = rows.mapInArrow(_featured, "label int, buckets binary, counts binary, at long, id long").collect()  # at most 2 * per_class rows
    found.sort(key=lambda r: (r["at"], r["id"]))
    return folded(*fit([(r.label, np.frombuffer(r.buckets, np.int32), np.frombuffer(r.counts, np.int32)) for r in found]))


def _scored(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = model.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores(batch.column(2), weights, bias))], ["doc_id", "held_out", "score"])

    return run


def score_quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``: score in 0 to 1, predicted 1 from a score of 0.7 on.

    Null and empty texts get the score of an empty average; very long texts are read whole; repeated rows and null ids
    are scored like others; no column but the text reaches the score. An empty table gives an empty table.
    """
    model = spark.sparkContext.broadcast(train(spark, docs, labels, id_col=id_col, text_col=text_col))  # 1 MB
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    scored = rows.mapInArrow(_scored(model), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= ACCEPT).cast("int"))


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, all columns as before.

    Null and empty texts are judged by the biases alone; repeated rows, null ids and very long texts are judged like
    others, and columns that ``docs`` has more pass through. An empty table gives an empty table.
    """
    model = spark.sparkContext.broadcast(train(spark, docs, labels))
    small_batches(spark)

    def accepted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = model.value
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text"))
            yield batch.filter(pa.array(scores(text, weights, bias) >= ACCEPT))

    return docs.mapInArrow(accepted, docs.schema)
