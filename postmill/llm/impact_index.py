"""Ranked lexical search over a bit-sliced impact index.

What a term adds to a document's score, its impact, is an integer. For a block of documents the index holds, for each
term, one bitmap of the documents for each bit of the impact. The scores of a query are sums of impacts: the bitmaps of
its terms are added by bitwise carry arithmetic, for all documents of the block at once, and give the bitmaps of the
bits of the scores. The k best are found by going down from the most significant of these, without any single score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postmill.llm.scratch import materialize, small_batches

#: Documents of a block, and the bytes of text after which a block ends early.
BLOCK, BLOCK_BYTES = 1 << 13, 64 << 20
#: Bytes of queries that are answered in one pass over the documents; more are answered in several passes.
QUERY_BYTES = 1 << 19
#: What separates terms becomes a space, A-Z become a-z; all bytes of other alphabets stay.
_TERMS = bytes(32 if b < 0x30 or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """The maximal runs of ASCII letters, digits and characters beyond ASCII, only A-Z lower-cased; null has none."""
    return (text or "").encode().translate(_TERMS).split()


def weight(n_docs: int, df: int) -> int:
    """floor(1000 * ln((2N + 2) / (2 df + 1)))."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, n: np.ndarray, w: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """w * ((10^9 tf) div (1000 tf + 8 m)) with m = 100 - 90 + (90 n N) div L."""
    m = 100 - 90 + (90 * n * n_docs) // max(n_terms, 1)
    return w * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


def slices(docs: np.ndarray, values: np.ndarray, words: int) -> list[np.ndarray]:
    """Bitmaps (64-bit words, a bit a document) of the bits of positive ``values``, the least significant first."""
    out = []
    place, bit = docs >> 6, np.uint64(1) << (docs & 63).astype(np.uint64)
    for k in range(int(values.max(initial=0)).bit_length()):
        on = (values >> k) & 1 == 1
        row = np.zeros(words, np.uint64)
        np.bitwise_or.at(row, place[on], bit[on])
        out.append(row)
    return out


def add(total: list[np.ndarray], more: list[np.ndarray]) -> list[np.ndarray]:
    """The slices of the sums of two sliced numbers: full adders on whole bitmaps, the carry rippling upwards."""
    if len(total) < len(more):
        total, more = more, total
    out, carry = [], None
    for k, a in enumerate(total):
        if k < len(more):
            b = more[k]
            either = a ^ b
            both = a & b
            if carry is None:
                out.append(either)
                carry = both
            else:
                out.append(either ^ carry)
                carry = both | (either & carry)
        elif carry is None or not carry.any():
            return out + total[k:]
        else:
            out.append(a ^ carry)
            carry = a & carry
    return [*out, carry] if carry is not None and carry.any() else out


def _members(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def top(score: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of the k greatest scores above 0, the lowest documents first among equal scores; unsorted."""
    if not score:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sure = np.zeros_like(score[0])  # certainly among the k best
    open_ = np.bitwise_or.reduce(score)  # still equal in all bits seen
    for row in reversed(score):
        with_bit = open_ & row
        n = int(np.bitwise_count(sure | with_bit).sum())
        if n > k:
            open_ = with_bit
        else:
            sure |= with_bit
            open_ = open_ & ~row
            if n == k:
                break
    best = _members(sure)
    if len(best) < k:
        best = np.concatenate([best, _members(open_)[: k - len(best)]])
    values = np.zeros(len(best), np.int64)
    for j, row in enumerate(score):
        values |= ((row[best >> 6] >> (best & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64) << j
    return best, values


def _counted(known: dict[bytes, int]):
    """(term, df, docs, length) rows: for each known term its documents in the task, and one row of the documents and all their terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(known), np.int64)
        docs = length = 0
        for batch in batches:
            for text in batch.column(0):
                found = terms(text.as_py())
                docs, length = docs + bool(found), length + len(found)
                df[list({known[t] for t in known.keys() & found})] += 1
        seen = np.flatnonzero(df)
        yield pa.record_batch([pa.array([*seen.tolist(), -1], pa.int64()), pa.array([*df[seen].tolist(), 0], pa.int64()), pa.array([0] * len(seen) + [docs], pa.int64()), pa.array([0] * len(seen) + [length], pa.int64())], ["term", "df", "docs", "length"])

    return run


def _searched(known: dict[bytes, int], weights: np.ndarray, asked: dict[int, list[int]], n_docs: int, n_terms: int, k: int):
    def answer(ids: list[int], sizes: list[int], found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        order = np.argsort(np.array(ids, np.int64), kind="stable")  # a lower place is a lower id
        rank = np.empty(len(ids), np.int64)
        rank[order] = np.arange(len(ids))
        doc = np.repeat(rank, [len(f) for f in found])
        code = np.concatenate(found)
        pair, tf = np.unique(code * len(ids) + doc, return_counts=True)
        code, doc = pair // len(ids), pair % len(ids)
        impact = impacts(tf, np.array(sizes, np.int64)[order][doc], weights[code], n_docs, n_terms)
        words = (len(ids) + 63) // 64
        bounds = np.searchsorted(code, np.arange(len(known) + 1))
        index = [slices(doc[a:b], impact[a:b], words) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        rows: list[tuple] = []
        for item, mine in asked.items():
            total: list[np.ndarray] = []
            for t in mine:
                total = add(total, index[t])
            best, score = top(total, k)
            rows += zip([item] * len(best), np.array(ids, np.int64)[order][best].tolist(), score.tolist())
        columns = list(zip(*rows)) if rows else [(), (), ()]
        yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], ["item_id", "doc_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        sizes: list[int] = []
        found: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                all_terms = terms(text.as_py())
                codes = np.fromiter(map(known.get, all_terms, repeat(-1)), np.int64, len(all_terms))
                ids.append(i)
                sizes.append(len(all_terms))
                found.append(codes[codes >= 0])
                size += len(all_terms)
                if len(ids) >= BLOCK or 8 * size >= BLOCK_BYTES:
                    yield from answer(ids, sizes, found)
                    ids, sizes, found, size = [], [], [], 0
        if ids:
            yield from answer(ids, sizes, found)

    return run


def _passes(spark: SparkSession, items: DataFrame, item_col: str, text_col: str) -> Iterator[dict[int, set[bytes]]]:
    """Queries as sets of terms, in as many parts as have at most about QUERY_BYTES each; each item in one part."""
    queries = items.select(F.col(item_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).where("i is not null")
    size = queries.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = size // QUERY_BYTES + 1
    for part in range(parts):
        out: dict[int, set[bytes]] = {}
        for r in queries.where(F.pmod(F.xxhash64("i"), F.lit(parts)) == part).collect():  # bounded by QUERY_BYTES
            out.setdefault(r.i, set()).update(terms(r.t))
        if out:
            yield out


def ranked_search(spark: SparkSession, docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): for each item the k documents with the highest score above 0, equal scores by id.

    Terms are those of ``terms``, an item's terms count once; weights, lengths and impacts are those of ``weight`` and
    ``impacts``, over all documents. An item without terms, or whose terms are nowhere, has no rows; several rows of an
    item are one query of all their terms. Null texts have no terms. Rows with a null id count in the statistics but
    are not returned; rows that repeat an id are documents of their own. Rows with a null item are no query. Other
    columns are not read. Without documents or items: no rows.
    Two passes over the documents for every ``QUERY_BYTES`` of queries, without a shuffle of documents or postings: one
    for the counts, one that indexes block after block and sends the k best of each block and item. The sizes of all
    lists on the driver are bounded by that of the queries of a pass.
    """
    small_batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    answers = []
    for asked in _passes(spark, items, item_col, item_text_col):
        known = {t: c for c, t in enumerate(sorted(set().union(*asked.values())))}
        rows = texts.select("text").mapInArrow(_counted(known), "term long, df long, docs long, length long").groupBy("term").agg(*[F.sum(c).alias(c) for c in ("df", "docs", "length")]).collect()
        df, n_docs, n_terms = np.zeros(len(known), np.int64), 0, 0
        for r in rows:  # a row a term of the queries, at most
            if r.term < 0:
                n_docs, n_terms = r.docs, r.length
            else:
                df[r.term] = r.df
        weights = np.array([weight(n_docs, int(n)) for n in df], np.int64)
        coded = {i: sorted(known[t] for t in mine) for i, mine in asked.items()}
        best = texts.where("doc_id is not null").mapInArrow(_searched(known, weights, coded, n_docs, n_terms, k), "item_id long, doc_id long, score long")
        answers.append(materialize(spark, best, "best"))
    if not answers:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    best = answers[0]
    for more in answers[1:]:
        best = best.union(more)
    by = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return best.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
