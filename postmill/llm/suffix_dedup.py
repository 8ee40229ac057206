"""Removal of repeated byte strings by a suffix array that bucket-pointer refinement sorts, distributed over buckets.

A string of 50 bytes has one anchor: of its 35 16-grams the leftmost with the lowest hash. Equal strings have equal
anchors, so the anchors are the initial buckets that Spark deals out; anchors that only one document has are settled at once.

1. Anchors of all texts, distinct in a batch, meet by their hash; those of several documents are reported to their documents.
2. Each document sends, for each such anchor, the stretch of its text that the strings of this anchor cover, once for equal
   stretches of a group of documents; the later ones of these are removed without asking.
3. In a bucket the suffixes of all stretches are sorted by bucket-pointer refinement: buckets of 8-grams first; then each
   bucket of several suffixes is sorted by the bucket pointers of the suffixes 8, 16 and 18 bytes later, which are as
   deep as the refinement before has made them: 8, 16, 32 and 50 bytes. Buckets of one suffix are never sorted again.
   The smallest document of a bucket keeps its string, the others lose theirs.
4. The spans of a document are united.

Skew: a batch sends an anchor or a stretch once, whatever the number of its documents; anchors of very many documents are
dealt out by whole strings instead, as their stretches may all differ. Exact copies of a text are one text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm.scratch import broadcast_if_small, materialize, release, shared_dir, small_batches, text_key
from postmill.llm.word_sets import mix

LENGTH, GRAM = 50, 16
GRAMS = LENGTH - GRAM + 1
#: Bytes of text of a batch, of a group of documents and of a bucket of anchors; and the least number of groups and buckets.
BATCH, GROUP, BUCKET, LEAST = 16 << 20, 4 << 20, 2 << 20, 64
#: Documents that an anchor must have to be dealt out by whole strings; more in a larger corpus, so that at most 2^22 anchors have them.
HOT = 2048
#: Size in bytes up to which the spans of all documents are broadcast to the texts.
BROADCAST_BYTES = 32 << 20
_CHUNK = 1 << 15
_TIMES = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1)]


def _buffers(texts: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after the other, and their n + 1 offsets."""
    texts = [t.as_py() for t in texts]
    data = [t.encode() if isinstance(t, str) else t or b"" for t in texts]
    return np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in data], dtype=np.int64)])


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, hash): ranges of starts of 50-byte strings, each within a text, and the hash of the 16-gram that anchors them."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if len(data) < LENGTH:
        return none
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    open_ = np.zeros(len(data) + 1, np.int32)
    np.add.at(open_, np.maximum(offsets[1:] - LENGTH + 1, offsets[:-1]), 1)  # strings that start here would cross the end of the text
    np.add.at(open_, offsets[1:], -1)
    crosses = np.cumsum(open_[:-1], dtype=np.int32) > 0
    eight = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))
    for a in range(0, len(data) - LENGTH + 1, _CHUNK):
        b = min(a + _CHUNK, len(data) - LENGTH + 1)
        four = np.ndarray((b - a + LENGTH - 4,), "<u4", data, a, (1,)).copy()
        n = b - a + GRAMS - 1
        x = four[:n] * _TIMES[0]
        for k in (1, 2, 3):
            x += four[4 * k : 4 * k + n] * _TIMES[k]
        x ^= x >> np.uint32(15)
        x *= _TIMES[4]
        x &= np.uint32(0xFFFF0000)
        x |= np.arange(n, dtype=np.uint32)  # equal hashes: the leftmost
        step = 1
        while 2 * step <= GRAMS:
            x = np.minimum(x[:-step], x[step:])
            step *= 2
        x = np.minimum(x[: b - a], x[GRAMS - step : GRAMS - step + b - a])
        at = (x & np.uint32(0xFFFF)).astype(np.int64)
        at[crosses[a:b]] = -1
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        last = np.append(first[1:], b - a) - 1
        real = at[first] >= 0
        first, last = first[real], last[real]
        gram = a + at[first]
        out.append((a + first, a + last, mix(mix(eight[gram] + np.uint64(1)) + eight[gram + 8])))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else none


def _texts_of(offsets: np.ndarray, positions: np.ndarray) -> np.ndarray:
    return np.searchsorted(offsets, positions, "right") - 1


def _split(by: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """(value, the columns as bytes) for each value of ``by``."""
    if not len(by):
        return
    order = np.argsort(by, kind="stable")
    by = by[order]
    columns = [c[order] for c in columns]
    starts = np.flatnonzero(np.concatenate([[True], by[1:] != by[:-1]]))
    for a, b in zip(starts.tolist(), np.append(starts[1:], len(by)).tolist()):
        yield int(by[a]), *(c[a:b].tobytes() for c in columns)


def _table(rows: list[tuple], names: list[str]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.table({n: pa.array(c, pa.int64() if n in "bg" else pa.binary()) for n, c in zip(names, columns)})


def _joined(table: pa.Table, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(x for x in table.column(name).to_pylist() if x is not None), kind)


def _anchored(buckets: int):
    """Anchors of whole batches of texts by bucket: (hash, document, documents of the batch that have it); 0 documents: others have been named before."""

    def rows(keys: list[int], texts: list) -> Iterator[pa.RecordBatch]:
        data, offsets = _buffers(texts)
        first, _, h = anchors(data, offsets)
        text = _texts_of(offsets, first)
        order = np.lexsort((text, h))
        h, text = h[order], text[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (text[1:] != text[:-1])]) if len(h) else np.zeros(0, bool)
        h, text = h[new], text[new]
        key = np.array(keys, np.int64)[text]
        lead = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
        docs = np.zeros(len(h), np.uint16)
        docs[lead] = np.minimum(np.diff(np.append(np.flatnonzero(lead), len(h))), 65535)
        bucket = np.where(lead, (h >> np.uint64(20)).astype(np.int64) % buckets, key % buckets)
        order = np.argsort(key, kind="stable")  # repeated keys side by side take little room
        found = list(_split(bucket[order], h[order], key[order], docs[order]))
        yield from _table(found, ["b", "hash", "key", "docs"]).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, texts, size = [], [], 0
        for batch in batches:
            keys += batch.column(0).to_pylist()
            texts += batch.column(1)
            size += batch.column(1).nbytes
            if size >= BATCH:
                yield from rows(keys, texts)
                keys, texts, size = [], [], 0
        if keys:
            yield from rows(keys, texts)

    return run


def _shared(groups: int, hot: int):
    """Anchors of several documents, by group of documents; those of at least ``hot`` documents also under group -1."""

    def run(table: pa.Table) -> pa.Table:
        h, key, docs = _joined(table, "hash", np.uint64), _joined(table, "key", np.int64), _joined(table, "docs", np.uint16)
        lead = docs > 0
        names, place = np.unique(h[lead], return_inverse=True)
        total = np.bincount(place, docs[lead], len(names))
        told = ~lead
        told[lead] = total[place] >= 2
        key, mark = key[told], (h[told] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        order = np.argsort(key, kind="stable")
        rows = list(_split(key[order] % groups, key[order], mark[order]))
        many = names[total >= hot]
        return _table(rows + [(-1, None, many.tobytes())] * (len(many) > 0), ["g", "key", "mark"])

    return run


def _stretches(buckets: int, hot: np.ndarray):
    """The stretches of a group's documents around shared anchors, by bucket; without data: spans that are removed."""

    def run(texts: pa.Table, told: pa.Table) -> pa.Table:
        names = ["b", "id", "key", "at", "which", "size", "data"]
        if not told.num_rows or not texts.num_rows:
            return _table([], names)
        order = np.lexsort((texts.column("key").to_numpy(), texts.column("id").to_numpy()))
        texts = texts.take(pa.array(order))
        ids, keys = texts.column("id").to_numpy(), texts.column("key").to_numpy()
        data, offsets = _buffers(texts.column("text"))
        first, last, h = anchors(data, offsets)
        text = _texts_of(offsets, first)
        # asked: pairs of a key and a mark; a wrong pair by chance costs a little work only
        distinct, place = np.unique(keys, return_inverse=True)
        asked_key, mark = _joined(told, "key", np.int64), _joined(told, "mark", np.uint32)
        asked = np.unique((np.searchsorted(distinct, asked_key).astype(np.uint64) << np.uint64(32)) | mark)
        mine = (place[text].astype(np.uint64) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))
        found = np.searchsorted(asked, mine)
        hit = (found < len(asked)) & (asked[np.minimum(found, len(asked) - 1)] == mine)
        first, last, h, text = first[hit], last[hit], h[hit], text[hit]
        many = np.isin(h, hot)
        bucket = (h >> np.uint64(20)).astype(np.int64) % buckets
        if many.any():  # each string for itself
            width = np.where(many, last - first + 1, 1)
            row = np.repeat(np.arange(len(first)), width)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(width) - width, width)
            first = first[row] + nth
            last = np.where(many[row], first, last[row])
            bucket, text, many = bucket[row], text[row], many[row]
        known: dict[bytes, int] = {}
        raw = data.tobytes()
        which = np.fromiter((known.setdefault(raw[a:b], len(known)) for a, b in zip(first.tolist(), (last + LENGTH).tolist())), np.int64, len(first))
        lead = np.full(len(known), -1, np.int64)
        lead[which[::-1]] = text[::-1]  # texts ascend by id: the first one is the smallest
        stretch = list(known)
        bucket_of = np.zeros(len(known), np.int64)
        bucket_of[which] = bucket
        of_many = np.zeros(len(known), bool)
        of_many[which] = many
        for k in np.flatnonzero(of_many):
            bucket_of[k] = zlib.crc32(stretch[k]) % buckets
        later = ids[text] > ids[lead[which]]
        at = first - offsets[text]
        rows = []
        for b, i, k, a, n in _split(keys[text[later]] % buckets, ids[text[later]], keys[text[later]], at[later], (last - first + LENGTH)[later]):
            rows.append((b, i, k, a, None, n, None))
        sent = np.flatnonzero(~later)
        sent = sent[np.argsort(which[sent], kind="stable")]
        size = np.array([len(x) for x in stretch], np.int64)
        by = np.argsort(bucket_of, kind="stable")
        of_bucket = {b: np.frombuffer(x, np.int64) for b, x in _split(bucket_of[by], by)}
        place = np.empty(len(stretch), np.int64)
        for x in of_bucket.values():
            place[x] = np.arange(len(x))
        for b, i, k, a, w in _split(bucket_of[which[sent]], ids[text[sent]], keys[text[sent]], at[sent], place[which[sent]]):
            rows.append((b, i, k, a, w, size[of_bucket[b]].tobytes(), b"".join(stretch[x] for x in of_bucket[b])))
        return _table(rows, names)

    return run


def refine(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes, first): the starts of all 50-byte strings that occur more than once, sorted, and where a new string begins.

    ``ends`` has for each byte the end of its stretch; strings do not cross it. A suffix's pointer is the place at which its
    bucket begins in the suffix array; a refinement sorts by the pointers of later suffixes and writes the new pointers back.
    """
    none = np.zeros(0, np.int64), np.zeros(0, bool)
    room = ends - np.arange(len(data))
    pointer = np.zeros(len(data), np.int64)
    suffixes = np.flatnonzero(room >= 8)
    if not len(suffixes):
        return none
    key = np.ndarray((len(data) - 7,), ">u8", data, 0, (1,))[suffixes].astype(np.uint64)
    order = np.argsort(key)
    suffixes, key = suffixes[order], key[order]
    first = np.concatenate([[True], key[1:] != key[:-1]])
    pointer[suffixes] = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
    for later, depth in ((8, 16), (16, 32), (18, 50)):
        several = ~(first & np.append(first[1:], True))
        suffixes = suffixes[several & (room[suffixes] >= depth)]
        if not len(suffixes):
            return none
        key = (pointer[suffixes] << 32) | pointer[suffixes + later]
        order = np.argsort(key)
        suffixes, key = suffixes[order], key[order]
        first = np.concatenate([[True], key[1:] != key[:-1]])
        place = np.arange(len(key))
        old = key >> 32
        begin = np.maximum.accumulate(np.where(np.concatenate([[True], old[1:] != old[:-1]]), place, 0))
        pointer[suffixes] = old + np.maximum.accumulate(np.where(first, place, 0)) - begin
    several = ~(first & np.append(first[1:], True))
    return suffixes[several], first[several]


def _removed(groups: int):
    """Spans that the documents of a bucket lose, by group of documents."""

    def run(table: pa.Table) -> pa.Table:
        names = ["g", "id", "key", "at", "size"]
        sure = table.filter(pa.compute.is_null(table.column("data")))
        sent = table.filter(pa.compute.is_valid(table.column("data")))
        spans = [tuple(_joined(sure, n, np.int64) for n in names[1:])]
        known: dict[bytes, int] = {}
        which = []
        for w, n, data in zip(*(sent.column(c).to_pylist() for c in ("which", "size", "data"))):
            end = np.cumsum(np.frombuffer(n, np.int64)).tolist()
            mine = np.fromiter((known.setdefault(data[a:b], len(known)) for a, b in zip([0, *end[:-1]], end)), np.int64, len(end))
            which.append(mine[np.frombuffer(w, np.int64)])
        if which:
            which = np.concatenate(which)
            ids, keys, at = (_joined(sent, n, np.int64) for n in ("id", "key", "at"))
            size = np.array([len(x) for x in known], np.int64)
            start = np.cumsum(size) - size
            lowest = np.full(len(size), np.iinfo(np.int64).max)
            np.minimum.at(lowest, which, ids)
            stretch = np.repeat(np.arange(len(size)), size)
            suffixes, first = refine(np.frombuffer(b"".join(known), np.uint8), (start + size)[stretch])
            keeper = np.full(len(stretch), np.iinfo(np.int64).max)  # the smallest document that has the string
            if len(suffixes):
                begin = np.flatnonzero(first)
                least = np.minimum.reduceat(lowest[stretch[suffixes]], begin)
                keeper[suffixes] = np.repeat(least, np.diff(np.append(begin, len(suffixes))))
            least = np.minimum(np.minimum.reduceat(keeper, start), lowest)
            asked = np.flatnonzero(ids > least[which])
            windows = size[which[asked]] - LENGTH + 1
            row = np.repeat(asked, windows)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
            gone = np.minimum(keeper[start[which[row]] + nth], lowest[which[row]]) < ids[row]
            row, nth = row[gone], nth[gone]
            if len(row):
                new = np.concatenate([[True], (row[1:] != row[:-1]) | (nth[1:] != nth[:-1] + 1)])
                head, tail = row[new], np.append(nth[np.append(new[1:], True)], [])
                spans.append((ids[head], keys[head], at[head] + nth[new], tail - nth[new] + LENGTH))
        ids, keys, at, size = (np.concatenate(x).astype(np.int64) for x in zip(*spans))
        order = np.lexsort((at, keys))
        ids, keys, at, size = ids[order], keys[order], at[order], size[order]
        return _table(list(_split(keys % groups, ids, keys, at, size)), names)

    return run


def _united(table: pa.Table) -> pa.Table:
    """(id, key, cuts): for each document its maximal removed runs, as starts and ends."""
    ids, keys, at, size = (_joined(table, n, np.int64) for n in ("id", "key", "at", "size"))
    order = np.lexsort((at, ids, keys))
    ids, keys, at, size = ids[order], keys[order], at[order], size[order]
    other = np.concatenate([[False], (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])])
    lift = np.cumsum(other) * (int((at + size).max(initial=0)) + 1)  # documents one after the other
    end = np.maximum.accumulate(lift + at + size)
    new = np.concatenate([[True], (lift + at)[1:] > end[:-1]]) | other
    head = np.flatnonzero(new)
    cut = np.stack([at[head], end[np.append(head[1:], len(at)) - 1] - lift[head]], 1)
    begin = np.flatnonzero(np.concatenate([[True], other[head][1:]])) if len(head) else head
    stop = np.append(begin[1:], len(head))
    return pa.table({"id": pa.array(ids[head[begin]]), "key": pa.array(keys[head[begin]]), "cuts": pa.array([cut[a:b].tobytes() for a, b in zip(begin.tolist(), stop.tolist())], pa.binary())})


def _digest(with_text: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, text, copy, cuts in zip(*(c.to_pylist() for c in batch.columns)):
                text = (text or "").encode()
                spans = [[0, len(text)]] if copy else np.frombuffer(cuts, np.int64).reshape(-1, 2).tolist() if cuts else []
                kept = b"".join(text[a:b] for a, b in zip([0, *(s[1] for s in spans)], [*(s[0] for s in spans), len(text)]))
                rows.append([i, len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), *([kept, spans] if with_text else [])])
            columns = list(zip(*rows)) if rows else [()] * (7 if with_text else 5)
            kinds = [*[pa.int64()] * 4, pa.string(), pa.binary(), pa.list_(pa.list_(pa.int64()))]
            yield pa.record_batch([pa.array(c, kind) for c, kind in zip(columns, kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"][: len(columns)])

    return run


def remove_repeats(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with ``with_text`` also kept (bytes) and spans.

    A byte goes if a 50-byte string over it also starts in a document with a smaller id; texts are UTF-8 bytes, strings
    stay within a text and are judged on the input. Null and short texts lose nothing. Rows that repeat an id are judged by
    their own texts and never against each other; rows with a null id lose nothing and take nothing away. Other columns are
    not read. An empty table gives an empty table.
    """
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.select("id", "text", F.octet_length("text").alias("n"), *text_key(F.col("text")))
    long = rows.where(f"id is not null and n >= {LENGTH}")
    names = materialize(spark, long.select("id", "n", "t1", "t2"), "names")
    classes = materialize(spark, names.groupBy("t1", "t2", "n").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("t1", "t2", "n", "lo"), "copies")
    total = names.agg(F.sum(F.col("n").cast("long"))).first()[0] or 0
    groups, buckets, hot = max(LEAST, total // GROUP), max(LEAST, total // BUCKET), max(HOT, total >> 26)

    texts = long.join(broadcast_if_small(classes), ["t1", "t2", "n"], "left").where("lo is null or lo = id")
    texts = texts.select("id", F.xxhash64("id", "t1", "t2").alias("key"), "text")
    found = texts.select("key", "text").mapInArrow(_anchored(buckets), "b long, hash binary, key binary, docs binary")
    told = materialize(spark, found.groupBy("b").applyInArrow(_shared(groups, hot), "g long, key binary, mark binary"), "shared")
    many = np.concatenate([np.zeros(0, np.uint64), *[np.frombuffer(r.mark, np.uint64) for r in told.where("g = -1").select("mark").collect()]])  # 32 MB at most
    left = texts.withColumn("g", F.pmod("key", F.lit(groups))).groupBy("g")
    sent = left.cogroup(told.where("g >= 0").groupBy("g")).applyInArrow(_stretches(buckets, many), "b long, id binary, key binary, at binary, which binary, size binary, data binary")
    spans = sent.groupBy("b").applyInArrow(_removed(groups), "g long, id binary, key binary, at binary, size binary")
    cuts = materialize(spark, spans.groupBy("g").applyInArrow(_united, "id long, key long, cuts binary"), "cuts")
    release(spark, names, told)
    size = cuts.agg(F.sum(F.octet_length("cuts") + 40)).first()[0] or 0
    keyed = rows.withColumn("key", F.xxhash64("id", "t1", "t2")).join(F.broadcast(cuts) if size <= BROADCAST_BYTES else cuts, ["id", "key"], "left")
    judged = keyed.join(broadcast_if_small(classes), ["t1", "t2", "n"], "left").select("id", "text", F.coalesce(F.col("lo") < F.col("id"), F.lit(False)).alias("copy"), "cuts")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary, spans array<array<long>>" if with_text else "")
    return judged.mapInArrow(_digest(with_text), schema)
