"""Maximal periodic runs of words, over a harmonic grid with prefix hashes.

A run of period q and length >= max(6, 4q) has equal words at t and t + q for at least max(6, 4q) - q consecutive t. So a
grid with that spacing for every q, which is harmonic (n/3 + n/6 + n/9 ...: n log n points), meets each run. For all pairs
of a period and a grid point at once, and for all texts of a batch, a binary search over prefix hashes finds how far the
words before and after t equal those q later. What it finds is verified on the words, and counts once with its smallest period.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm.scratch import small_batches
from postmill.llm.word_sets import mix

#: Least length of a run in words, and in periods.
WORDS, PERIODS = 6, 4
#: Pairs of a period and a grid point that are in memory at once.
PAIRS = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)


def planted(words: list[bytes], doc_id: int) -> list[bytes]:
    """The words, from some word on replaced by a repetition in a tenth of the documents, as the crc32 of the id says."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def _pairs(sizes: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Chunks of (text, position in the batch, period), periods ascending: every grid point of each period of each text."""
    q, top = 1, int(sizes.max(initial=0)) // PERIODS
    while q <= top:
        # as many periods as fit, by the points of all texts that are long enough for the first of them
        texts = np.flatnonzero(sizes >= max(WORDS, PERIODS * q))
        n, step = sizes[texts], max(WORDS, PERIODS * q) - q
        room = max(1, PAIRS // max(1, int((n // step + 1).sum())))
        periods = np.arange(q, min(top, q + room - 1) + 1)
        for some in np.array_split(texts, max(1, len(texts) * len(periods) // PAIRS)):
            which, period = (x.ravel() for x in np.meshgrid(some, periods, indexing="ij"))
            long = sizes[which] >= np.maximum(WORDS, PERIODS * period)
            which, period = which[long], period[long]
            step = np.maximum(WORDS, PERIODS * period) - period
            points = (sizes[which] - period - 1) // step + 1
            for a, b in _cuts(points):
                k = np.repeat(np.arange(a, b), points[a:b])
                nth = np.arange(len(k)) - np.repeat(np.cumsum(points[a:b]) - points[a:b], points[a:b])
                yield which[k], starts[which[k]] + nth * step[k], period[k]
        q = int(periods[-1]) + 1


def _cuts(counts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about PAIRS in total each; one row at least."""
    ends, a = np.cumsum(counts), 0
    while a < len(counts):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PAIRS, "right")))
        yield a, b
        a = b


def _reach(same, most: np.ndarray) -> np.ndarray:
    """The greatest e <= most with same(e), for all rows at once; same(0) holds and same falls only once."""
    low, high = np.zeros_like(most), most.copy()
    while (low < high).any():
        middle = (low + high + 1) // 2
        good = same(middle)
        low, high = np.where(good, middle, low), np.where(good, high, middle - 1)
    return low


def find_runs(codes: np.ndarray, sizes: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
    """{text: its runs (start, length, period), sorted} for texts whose word codes lie one after the other in ``codes``.

    Texts without runs are left out; no texts give an empty dict.
    """
    starts = np.cumsum(sizes) - sizes
    power = np.full(len(codes) + 1, _BASE)
    power[0] = 1
    power = np.multiply.accumulate(power)
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(codes.astype(np.uint64) + np.uint64(1)) * power[:-1], dtype=np.uint64)])
    found: dict[tuple[int, int], int] = {}  # (first, end) in the batch: smallest period
    for text, t, q in _pairs(sizes, starts):
        hit = codes[t] == codes[t + q]
        text, t, q = text[hit], t[hit], q[hit]
        if not len(t):
            continue
        scale, begin, end = power[q], starts[text], starts[text] + sizes[text]

        def after(e, t=t, q=q, scale=scale):
            return (prefix[t + e] - prefix[t]) * scale == prefix[t + q + e] - prefix[t + q]

        def before(e, t=t, q=q, scale=scale):
            return (prefix[t] - prefix[t - e]) * scale == prefix[t + q] - prefix[t + q - e]

        right, left = _reach(after, end - t - q), _reach(before, t - begin)
        first, stop = t - left, t + q + right
        whole = stop - first >= np.maximum(WORDS, PERIODS * q)
        for a, b, k in np.unique(np.stack([first[whole], stop[whole], q[whole]], 1), axis=0).tolist():
            found.setdefault((a, b), k)  # periods ascend from chunk to chunk and within one
    out: dict[int, list[tuple[int, int, int]]] = {}
    text_of = np.searchsorted(starts, np.array([a for a, _ in found], np.int64), "right") - 1 if found else ()
    wrong: set[int] = set()  # texts in which two different stretches have one hash
    for ((a, b), q), k in zip(found.items(), map(int, text_of)):
        first, end = int(starts[k]), int(starts[k] + sizes[k])
        equal = np.array_equal(codes[a : b - q], codes[a + q : b])
        if equal and (a == first or codes[a - 1] != codes[a - 1 + q]) and (b == end or codes[b] != codes[b - q]):
            out.setdefault(k, []).append((a - first, b - a, q))
        else:
            wrong.add(k)
    for k in wrong:
        text = codes[int(starts[k]) : int(starts[k] + sizes[k])]
        out[k] = [r for q in range(1, len(text) // PERIODS + 1) for r in _plain(text, q)]
    return {k: sorted(v, key=lambda r: (r[0], r[2])) for k, v in out.items() if v}


def _plain(codes: np.ndarray, q: int) -> list[tuple[int, int, int]]:
    """Runs with smallest period q of one text, by comparing all its words."""
    same = np.concatenate([[False], codes[:-q] == codes[q:], [False]])
    edges = np.flatnonzero(same[1:] != same[:-1]).reshape(-1, 2)
    runs = [(int(a), int(b - a + q), q) for a, b in edges if b - a + q >= max(WORDS, PERIODS * q)]
    return [r for r in runs if not any(np.array_equal(codes[r[0] : r[0] + r[1] - p], codes[r[0] + p : r[0] + r[1]]) for p in range(1, q))]


def _best(runs: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    best = runs[0]
    for run in runs[1:]:  # sorted by start, then period: a tie stays with the earlier one
        if run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def _judged(plant: bool, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = [t.as_py().encode() if t.is_valid else b"" for t in batch.column(1)]
            words = [t.split() for t in texts]  # at \x20 and \x09-\x0D
            if plant:
                words = [w if i is None else planted(w, i) for w, i in zip(words, ids)]
            sizes = np.array([len(w) for w in words], np.int64)
            known: dict[bytes, int] = {}
            codes = np.fromiter((known.setdefault(w, len(known)) for text in words for w in text), np.int64, int(sizes.sum()))
            runs = find_runs(codes, sizes)
            rows = []
            for k, (i, w) in enumerate(zip(ids, words)):
                mine = runs.get(k, [])
                kept = np.ones(len(w), bool)
                for start, length, q in mine:
                    kept[start + q : start + length] = False
                best = _best(mine) if mine else None
                listed = "".join(f"{a},{b},{q}\n" for a, b, q in mine)
                text = b" ".join(w if not mine else [w[j] for j in np.flatnonzero(kept)])
                row = [i, len(mine), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(text).hexdigest()]
                rows.append(row + ([mine, text.decode()] if with_text else []))
            columns = list(zip(*rows)) if rows else [()] * (10 if with_text else 8)
            kinds = [*[pa.int64()] * 6, pa.string(), pa.string()]
            arrays = [pa.array(c, kind) for c, kind in zip(columns, kinds)]
            if with_text:
                run_kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
                arrays.append(pa.array([[dict(zip(("start", "length", "period"), r)) for r in x] for x in columns[8]], pa.list_(run_kind)))
                arrays.append(pa.array(columns[9], pa.string()))
            yield pa.record_batch(arrays, COLUMNS + (["runs", "collapsed"] if with_text else []))

    return run


def periodic_runs(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plant: bool = False, with_text: bool = False) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_runs, the run with the greatest length / period (start, length, period,
    exponent_milli; ties: smallest start, then period), runs_sha256 and collapsed_sha256; with ``with_text`` also runs and collapsed.

    Words are separated by \\x20 and \\x09-\\x0D and compared byte by byte. A run is a stretch of words with smallest period q
    and a length of at least max(6, 4q) that no neighbouring word extends; collapsed is the text without the words that a
    run holds after its first q ones, joined by one space. ``plant`` first replaces the end of a tenth of the texts by a
    repetition (see ``planted``). A null text has no words; without runs the four numbers are null and the hashes are those
    of the empty list and of all words. Rows with a null id are judged, too, but never planted; rows that repeat an id
    are judged one by one, whatever their order. Other columns are not read. An empty table gives an empty table.
    One pass without a shuffle; long texts are worked on in chunks of ``PAIRS`` grid points.
    """
    small_batches(spark)
    schema = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    if with_text:
        schema += ", runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(_judged(plant, with_text), schema)
