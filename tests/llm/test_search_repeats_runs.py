"""Ranked search, removal of repeated strings and periodic runs against brute force, on odd rows as well."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from postmill.llm import impact_index, periodic, suffix_dedup
from tests.llm.test_documents import corpus, frame

EMPTY = "doc_id long, text string"


def sha(data):
    return hashlib.sha256(data).hexdigest()


# --- ranked search


def plain_terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def ranked(rows, items, k=10):
    """{item: [(doc, score)]} for (id, text) rows, by scoring every row."""
    counts = [(i, Counter(plain_terms(t))) for i, t in rows]
    n_docs = sum(bool(c) for _, c in counts)
    length = sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = {}
    for item in {i for i, _ in items if i is not None}:
        asked = {t for i, text in items if i == item for t in plain_terms(text)}
        scores = []
        for i, c in counts:
            m = 10 + 90 * c.total() * n_docs // length if length else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in asked if t in c)
            if score > 0 and i is not None:
                scores.append((i, score))
        if scores:
            out[item] = sorted(scores, key=lambda x: (-x[1], x[0]))[:k]
    return out


def found(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r.item_id, r.rank)):
        assert r.rank == len(out[r.item_id]) + 1
        out[r.item_id].append((r.doc_id, r.score))
    return dict(out)


def test_search_equals_scoring_all_rows(spark, monkeypatch):
    rows = list(corpus().items()) + [(3, "w1 w1 w2"), (3, "w1 w1 w2"), (None, "w1 w5 w9"), (-7, "Größe W1\x00w2-w3_w4"), (900, "größe GRÖßE")]
    items = [(1, "w1 w2 w3 w1"), (2, "W7,w8;w9 größe"), (3, None), (4, "nowhere"), (5, ""), (6, "w1 " * 50), (6, "x10 w20"), (None, "w1"), (-1, "w4 one two three four")]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, score long, rank int")
    asked = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id long")
    want = ranked(rows, items)
    assert found(impact_index.ranked_search(spark, docs.repartition(5), asked)) == want
    monkeypatch.setattr(impact_index, "QUERY_BYTES", 64)  # several passes
    assert found(impact_index.ranked_search(spark, docs, asked, k=3)) == ranked(rows, items, 3)


def test_search_of_empty_tables(spark):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert impact_index.ranked_search(spark, spark.createDataFrame([], EMPTY), items).count() == 0
    assert impact_index.ranked_search(spark, spark.createDataFrame([(1, "a b")], EMPTY), items.where("false")).count() == 0
    assert impact_index.ranked_search(spark, spark.createDataFrame([(1, None)], EMPTY), items).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_sliced_sums_and_tops(seed):
    draw = random.Random(seed)
    n = draw.randrange(1, 300)
    total, score = np.zeros(n, np.int64), []
    for _ in range(draw.randrange(0, 9)):
        docs = np.array(sorted(draw.sample(range(n), draw.randrange(n + 1))), np.int64)
        values = np.array([draw.randrange(draw.choice([1, 3, 1 << 33])) for _ in docs], np.int64)
        total[docs] += values
        score = impact_index.add(score, impact_index.slices(docs, values, (n + 63) // 64))
    best, values = impact_index.top(score, 10)
    assert sorted(zip((-values).tolist(), best.tolist())) == sorted((-v, i) for i, v in enumerate(total.tolist()) if v > 0)[:10]


# --- repeated strings


def cut(rows):
    """[(id, n_bytes, n_removed, spans, kept)] by looking up every 50-byte string."""
    data = [(i, (t or "").encode()) for i, t in rows]
    least = {}
    for i, d in data:
        for k in range(len(d) - 49) if i is not None else ():
            least[d[k : k + 50]] = min(i, least.get(d[k : k + 50], i))
    out = []
    for i, d in data:
        gone = np.zeros(len(d) + 1, bool)
        for k in range(len(d) - 49) if i is not None else ():
            if least[d[k : k + 50]] < i:
                gone[k : k + 50] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[False], gone])))
        spans = [[int(a), int(b)] for a, b in edges.reshape(-1, 2)]
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((i, len(d), len(d) - len(kept), len(spans), sha(kept)))
    return Counter(out)


def repeats():
    """Texts that share passages of 49 to 400 bytes at all offsets, periodic texts, long runs, other alphabets, copies and odd ids."""
    draw = random.Random(4)
    noise = lambda n: "".join(draw.choice("abcdefghij klmnop") for _ in range(n))
    shared = [noise(n) for n in (49, 50, 51, 60, 120, 400)] + ["é€" * 30, "ab" * 40, "x" * 90]
    rows = []
    for i in range(60):
        parts = [noise(draw.randrange(0, 90))]
        for _ in range(draw.randrange(0, 5)):
            parts += [draw.choice(shared), noise(draw.randrange(0, 30))]
        rows.append((draw.randrange(-50, 1000), "".join(parts)))
    base = noise(300)
    for i in range(30):
        at = draw.randrange(300)
        rows.append((2000 + i, base[:at] + "#" + base[at + 1 :]))
    rows += [(5000 + i, f"{noise(20)}{shared[4]}{noise(20)}") for i in range(40)]  # one passage, other borders
    rows += [(7, None), (8, ""), (9, "short"), (None, shared[5]), (None, None), (6000, "y" * 5000), (6001, "y" * 70 + "z"), (6002, "y" * 5000)]
    rows += [rows[0], rows[1], (rows[2][0], rows[3][1]), (4000, rows[5][1]), (-99, rows[6][1]), (4001, rows[5][1])]
    return rows


def removed(df):
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


@pytest.mark.parametrize("hot", [2048, 3])
def test_repeats_equal_lookup_of_all_strings(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "LEAST", 3)
    monkeypatch.setattr(suffix_dedup, "GROUP", 3000)
    monkeypatch.setattr(suffix_dedup, "BUCKET", 3000)
    rows = repeats()
    docs = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id long, text string, id long, key long, n int").repartition(7)
    assert removed(suffix_dedup.remove_repeats(spark, docs)) == cut(rows)


def test_repeats_with_texts_and_shuffled_spans(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BROADCAST_BYTES", 0)
    rows = repeats()
    out = suffix_dedup.remove_repeats(spark, spark.createDataFrame(rows, EMPTY), with_text=True)
    got = out.collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == cut(rows)
    assert all(sha(bytes(r.kept)) == r.kept_sha256 and len(r.spans) == r.n_spans and sum(b - a for a, b in r.spans) == r.n_removed for r in got)


def test_repeats_of_empty_tables(spark):
    assert suffix_dedup.remove_repeats(spark, spark.createDataFrame([], EMPTY)).count() == 0
    rows = [(1, None), (2, ""), (3, "a")]
    assert removed(suffix_dedup.remove_repeats(spark, spark.createDataFrame(rows, EMPTY))) == cut(rows)


@pytest.mark.parametrize("seed", range(30))
def test_refinement_sorts_all_repeated_strings(seed):
    draw = random.Random(seed)
    parts = [bytes(draw.choice(b"ab") for _ in range(draw.randrange(150))) for _ in range(4)] + [b"abcabc" * draw.randrange(1, 30), b"q" * 60, b"q" * 130]
    base = bytes(draw.choice(b"abcdef") for _ in range(120))
    parts += [base[draw.randrange(40) : draw.randrange(60, 120)] for _ in range(5)]
    data, sizes = b"".join(parts), [len(p) for p in parts]
    ends = np.repeat(np.cumsum(sizes), sizes)
    places = defaultdict(list)
    for k in range(len(data)):
        if k + 50 <= ends[k]:
            places[data[k : k + 50]].append(k)
    suffixes, first = suffix_dedup.refine(np.frombuffer(data, np.uint8), ends)
    got = defaultdict(list)
    for k, c in zip(suffixes.tolist(), np.cumsum(first).tolist()):
        got[c].append(k)
    assert [sorted(v) for _, v in sorted(got.items())] == [v for _, v in sorted(places.items()) if len(v) > 1]


# --- periodic runs


def plain_runs(words):
    out, n = [], len(words)
    for q in range(1, n // 4 + 1):
        at = 0
        while at + q < n:
            end = at
            while end + q < n and words[end] == words[end + q]:
                end += 1
            size = end - at + q
            if size >= max(6, 4 * q) and not any(words[at : at + size - p] == words[at + p : at + size] for p in range(1, q)):
                out.append((at, size, q))
            at = max(end, at + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(i, text, plant):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    n = len(words)
    if plant and i is not None and n and zlib.crc32(str(i).encode()) % 10 == 0:
        g = zlib.crc32(str(i).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
    runs = plain_runs(words)
    gone = {k for a, size, q in runs for k in range(a + q, a + size)}
    best = min(runs, key=lambda r: (-(r[1] / r[2]), r[0], r[2])) if runs else (None,) * 3
    milli = 1000 * best[1] // best[2] if runs else None
    return (i, len(runs), *best, milli, sha("".join(f"{a},{b},{q}\n" for a, b, q in runs).encode()), sha(b" ".join(w for k, w in enumerate(words) if k not in gone)))


def periodic_rows():
    draw = random.Random(9)
    rows = [(i, t) for i, t in corpus().items() if len(t or "") < 20_000]
    for i in range(200, 330):
        words = [draw.choice(["a", "b", "é", "Ab", "w" * 9]) for _ in range(draw.randrange(0, 90))]
        p = draw.randrange(1, 9)
        rows.append((i, draw.choice([" ", "\n", "\t \r"]).join(words + words[-p:] * draw.randrange(0, 9))))
    rows += [(-3, "x " * 3000), (5, "a b " * 40), (5, "a b " * 40), (5, "other"), (None, "a b c " * 8), (None, None), (400, " a a\x0b a\x0c a a a \x1f a"), (401, "a" * 60_000)]
    return rows


@pytest.mark.parametrize("plant", [True, False])
def test_runs_equal_brute_force(spark, plant):
    rows = periodic_rows()
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, start long, words long").repartition(3)
    got = Counter(tuple(r) for r in periodic.periodic_runs(spark, docs, plant=plant).collect())
    assert got == Counter(plain_row(i, t, plant) for i, t in rows)


def test_runs_and_collapsed_texts(spark):
    rows = [(1, "x a b a b a b a b y"), (2, None)]
    one, two = sorted(periodic.periodic_runs(spark, spark.createDataFrame(rows, EMPTY), with_text=True).collect())
    assert [tuple(r) for r in one.runs] == [(1, 8, 2)] and one.collapsed == "x a b y" and one.exponent_milli == 4000
    assert two.runs == [] and two.collapsed == "" and two.start is None and two.runs_sha256 == sha(b"")
    assert periodic.periodic_runs(spark, spark.createDataFrame([], EMPTY)).count() == 0


@pytest.mark.parametrize("pairs", [1, 13, 1 << 20])
def test_runs_do_not_depend_on_chunks(monkeypatch, pairs):
    monkeypatch.setattr(periodic, "PAIRS", pairs)
    draw = random.Random(pairs)
    texts = [[draw.randrange(draw.choice([1, 2, 3, 9])) for _ in range(draw.choice([0, 1, 6, 70]))] for _ in range(30)]
    texts += [[k % p for k in range(100)] for p in (1, 5, 25, 26)]
    codes = np.array([w for t in texts for w in t], np.int64)
    got = periodic.find_runs(codes, np.array([len(t) for t in texts], np.int64))
    assert got == {k: runs for k, t in enumerate(texts) if (runs := plain_runs(t))}


def test_equal_hashes_of_other_words_are_seen(monkeypatch):
    monkeypatch.setattr(periodic, "mix", lambda x: x * np.uint64(0))  # all words hash alike
    words = [1, 2, 1, 2, 1, 2, 1, 2, 3, 4, 4, 4, 4, 4, 4, 5]
    assert periodic.find_runs(np.array(words), np.array([len(words)])) == {0: plain_runs(words)}
