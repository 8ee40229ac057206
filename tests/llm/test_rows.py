"""Embeddings, revisits, BPE, URLs and HTML against brute force and on edge cases."""

import datetime
import hashlib
import math
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from postmill.llm import bpe, embedding_join, html_text, revisits, url_filter
from tests.llm.helpers import smallest_reachable


def brute_vectors(rows, cosine):
    good = {}
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good[i] = (label, np.array(v, np.float64) / np.linalg.norm(np.array(v, np.float64)))
    links = [(a, b) for a in good for b in good if a < b and good[a][0] == good[b][0] and len(good[a][1]) == len(good[b][1]) and good[a][1] @ good[b][1] >= cosine]
    return links, smallest_reachable([i for i, _, _ in rows if i is not None], links)


@pytest.mark.parametrize("cell, block", [(2048, 2048), (16, 7)])
def test_embeddings_equal_brute_force(spark, monkeypatch, cell, block):
    monkeypatch.setattr(embedding_join, "CELL", cell)
    monkeypatch.setattr(embedding_join, "BLOCK", block)
    draw = np.random.default_rng(3)
    rows, i = [], 0
    for label in (0, 1):
        for _ in range(40):
            centre = draw.normal(size=8)
            for _ in range(int(draw.integers(1, 5))):
                rows.append((i, [float(x) for x in (centre + draw.normal(size=8) * 0.12).astype(np.float32)], label))
                i += 1
    hot = draw.normal(size=8)
    for _ in range(60):  # a third of the label in one place
        rows.append((i, [float(x) for x in (hot * draw.uniform(0.5, 2)).astype(np.float32)], 1))
        i += 1
    rows += [(i + 1, None, 1), (i + 2, [0.0] * 8, 1), (i + 3, [1.0, None] + [0.0] * 6, 1), (i + 4, [float("nan")] * 8, 1), (i + 5, rows[0][1], None), (i + 6, [1.0, 2.0], 1), (i + 7, [float("inf")] + [0.0] * 7, 0), (i + 8, [2.0, 4.0], 1)]
    rows += [(i + 20 + k, rows[k % 3][1], rows[k % 3][2]) for k in range(40)]  # equal vectors
    links, top = brute_vectors(rows, 0.98)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("id", F.lit(1)).withColumn("cell", F.lit(2)).withColumn("v", F.lit(3))
    got = {r.vec_id: r for r in embedding_join.similar_embeddings(spark, df.repartition(3)).collect()}
    assert len(got) == len(rows)
    assert {k: r.n_links for k, r in got.items()} == {k: sum(k in p for p in links) for k in got}
    assert {k: r.component_id for k, r in got.items()} == top
    assert all(r.kept == (r.component_id == r.vec_id) for r in got.values())


def test_embeddings_edge_rows(spark):
    shape = "vec_id long, embedding array<float>, label int"
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [1.0, 0.0], 0), (None, [1.0, 0.0], 0), (3, [1.0, 0.0], 1)]
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in embedding_join.similar_embeddings(spark, spark.createDataFrame(rows, shape)).collect())
    assert got == [("1", 1, "1", True), ("1", 1, "1", True), ("2", 1, "1", False), ("3", 0, "3", True), ("None", 0, "None", True)]
    assert embedding_join.similar_embeddings(spark, spark.createDataFrame([], shape)).count() == 0


def codec():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return bpe.Codec(f.read(), public_tokenizers.PATTERN)


def test_bpe_equals_the_reference_library_and_round_trips(spark):
    mine = codec()
    other = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=mine.ranks, special_tokens={})
    draw = random.Random(4)
    texts = ["", None, " ", "a" * 20_000, "don't  stop\n\n\tnow", "日本語 ünïcödé 🙂🙂", "<unk><s>▁x", "\x00\x01\x7f", " \r\n ", "<|endoftext|>", "12345 67"]
    texts += ["".join(chr(draw.choice([draw.randrange(1, 0xD7FF), draw.randrange(32, 127), 32, 10])) for _ in range(draw.randrange(80))) for _ in range(300)]
    for t in texts:
        ids = np.frombuffer(mine.encode(t or ""), "<u4").tolist()
        assert ids == other.encode_ordinary(t or "")
        assert mine.decode(mine.encode(t or "")) == (t or "").encode()
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "x"), (1, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(1)).withColumn("n_tokens", F.lit("c"))
    got = bpe.tokenize(spark, df, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True).collect()
    assert len(got) == len(rows)
    wanted = sorted((str(i), other.encode_ordinary(t or "")) for i, t in rows)
    assert sorted((str(r.doc_id), list(r.ids)) for r in got) == wanted
    for r in got:
        ids = np.array(r.ids, "<u4")
        assert len(ids) == r.n_tokens and hashlib.sha256(ids.tobytes()).hexdigest() == r.ids_sha256
        assert hashlib.sha256(mine.decode(ids.tobytes())).hexdigest() == r.decoded_sha256
    wanted = sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t in rows)
    assert sorted(r.decoded_sha256 for r in got) == wanted
    assert bpe.tokenize(spark, df.limit(0), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).count() == 0


def test_ranks_with_gaps_are_refused():
    with pytest.raises(ValueError):
        bpe.serialise({b"a": 0, b"b": 2})


def brute_rule(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = rest
    for c in "/?#":
        host = host.split(c)[0]
    path = rest[len(host) :].split("?")[0].split("#")[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(name + start, says) for name, start, says in url_filter.RULES if (host == name or host.endswith("." + name)) and path.startswith(start)]
    rule, verdict = max(fits, key=lambda r: len(r[0]), default=(None, None))
    return host, path, rule, verdict


def test_urls_equal_brute_force(spark):
    urls = ["http://A.Example.COM/en/x?y#z", "https://www.example.com/en/", "http://www.example.com/de/", "http://x.net/es/1", "http://net/fr/", "http://anet/fr/", "http://com", "http://com/", "http://a.org?x=/en/", "x://example.com#/en/", "no scheme", "", None, "http://", "HTTP://ÄÖ.example.com/en", "http://u:p@www.example.com:80/en/", "a://b://example.com/en/", "http://h.net/es/" + "x" * 50_000, "http://line\nbreak.net/es/"]
    rows = list(enumerate(urls)) + [(None, urls[0]), (0, urls[0])]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit(1)).withColumn("rule", F.lit(2))
    got = sorted(((r.page_id, r.host, r.path, r.rule) for r in url_filter.judge_urls(spark, df).collect()), key=str)
    assert got == sorted(((i, *brute_rule(u)[:3]) for i, u in rows), key=str)
    for r in url_filter.judge_urls(spark, df).collect():
        ruled = {str(x[:3]): x[3] for x in map(brute_rule, urls)}[str((r.host, r.path, r.rule))]
        assert r.verdict == (ruled or ("block" if r.score >= 0.5 else "allow"))
    assert url_filter.judge_urls(spark, df.limit(0)).count() == 0


def described(spark, urls):
    rows = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "at long, url string")
    return url_filter._described(rows, "at").orderBy("at").toArrow().combine_chunks().to_batches()[0]


def test_trees_judge_hosts_that_they_have_not_seen(spark):
    urls, labels = url_filter.labelled_urls()
    late = np.array([int(hashlib.md5(u.split("/")[2].encode()).hexdigest(), 16) % 4 == 0 for u in urls])  # by host
    assert not {u.split("/")[2] for u, x in zip(urls, late) if x} & {u.split("/")[2] for u, x in zip(urls, late) if not x}
    model, rates = url_filter.train(spark, [u for u, x in zip(urls, late) if not x], labels[~late])
    x = url_filter.matrix(described(spark, urls), rates)
    right = ((model.predict(x) >= 0.5) == labels)[late].mean()
    assert x.shape[1] == len(url_filter.FEATURES) and right >= 0.88
    single = 0  # the best that one cut through one feature does, even with all labels known
    for column in x.T:
        for cut in np.unique(column):
            share = ((column <= cut) == labels).mean()
            single = max(single, share, 1 - share)
    assert single <= right - 0.1
    gains = dict(zip(url_filter.FEATURES, model.gains / model.gains.sum()))
    assert max(gains.values()) < 0.5 and sum(g > 0.02 for g in gains.values()) >= 6, gains


def test_neither_hyphen_nor_its_absence_decides(spark):
    urls = [f"https://{host}{path}" for host in ("bbc-news.example.org", "health-care.example.org", "old-town-library.example.net") for path in ("/world/spring-festival-report", "/about", "/")]
    bad = ["http://casino-win.example.org/en/4033.html", "http://free-bets.example.net/de/51", "https://luckyspin77.top/go?aff=991&sub=3&clk=8a7f12", "http://jackpotcash.click/offer/8812/click?cid=55aa91&pid=9&src=mail&z=771"]
    df = spark.createDataFrame([(k, u) for k, u in enumerate(urls + bad)], "page_id long, url string")
    got = {r.page_id: r for r in url_filter.judge_urls(spark, df, rules=()).collect()}
    assert [u for k, u in enumerate(urls + bad) if (got[k].verdict == "block") != (u in bad)] == []


def test_features_equal_plain_python(spark):
    urls = ["http://A.b-c.Example.com/x/9//y.html?a=1&b==2#q=3", "none", "", "x://h9?k=v", "http://ä.ö/ü?z"] + url_filter.labelled_urls()[0][:50]
    got = url_filter.matrix(described(spark, urls), {"com": 0.25, "Example.com": 0.1, "example.com": 0.75})
    for row, u in zip(got, urls):
        host, path = brute_rule(u)[:2]
        query = u.split("#")[0].split("://", 1)[-1].partition("?")[2] if "://" in u else ""
        entropy = lambda t: -sum(t.count(c) / len(t) * math.log2(t.count(c) / len(t)) for c in set(t)) if t else 0.0
        ratio = lambda t: sum(c in "0123456789" for c in t) / max(1, len(t))
        parts = host.split(".")
        want = [len(u), len(host), len(path), len([x for x in path.split("/") if x]), ratio(u), ratio(host), ratio(path), query.count("="), host.count("-"), len(parts), max(map(len, parts)), entropy(host.encode()), entropy(u.encode()), {"com": 0.25}.get(parts[-1], 0.5), {"example.com": 0.75}.get(".".join(["", *parts][-2:]), 0.5)]
        assert np.allclose(row, want), (u, row, want)


PAGE = """<!DOCTYPE html><html><head><title>t</title><script>var x="</p>";</script><style>p{}</style></head><body>
<header><h1>Site</h1><p>Welcome to the site of all sites</p></header><nav><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></nav>
<div class="cookie-notice">We use cookies.</div><div class="ad">Buy this thing now, it is cheap</div><!-- <p>gone</p> -->
<article><h1>A   title &amp; more</h1><p>First <b>bold</b>word,&nbsp;then&#8212;dash<br>next.<p>Short.<ul><li>One</li><li>Two</li></ul>
<aside>See also this</aside><form><label>Mail</label><input name="x > y"></form><table><tr><td>c1</td><td>c2</td></tr></table></article>
<section id="comments"><p>A long reader comment that goes on and on about nothing in particular, as they do.</p></section>
<div class="sidebar"><p>Popular</p></div><footer>&copy; us</footer></body></html>"""


def test_html(spark):
    tree = html_text.train()
    assert html_text.main_text(PAGE, tree) == "A title & more\nFirst boldword, then—dash next.\nShort.\nOne\nTwo\nc1\nc2"
    plain = "<div><a href=1>Home</a> <a href=2>About</a></div><div>" + "word " * 40 + "</div><p>Brief.</p><p>" + "more " * 40 + "&lt;end&gt;</p>"
    assert html_text.main_text(plain, tree) == ("word " * 40).strip() + "\nBrief.\n" + ("more " * 40) + "<end>"
    assert html_text.main_text("", tree) == "" and html_text.main_text("just text", tree) == "just text"
    odd = "<article><p title=it's>one <span style='display: none'>no</span> two</p><p>a<i hidden>x</i>b <a href='x>y'>link</a> c</p></article>"
    assert html_text.main_text(odd, tree) == "one two\nab link c"
    rows = [(1, "u", PAGE), (1, "u", PAGE), (None, None, None), (2, "u", ""), (3, "u", "<article>" + "<p>x y</p>" * 20_000), (4, "u", "<article><p>cut off &am"), (5, "u", "<script>never closed")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("n_chars", F.lit(2))
    got = {r.page_id: r for r in html_text.extract_pages(spark, df).collect()}
    assert html_text.extract_pages(spark, df).count() == len(rows)
    assert got[3].text == "\n".join(["x y"] * 20_000) and got[3].n_chars == 4 * 20_000 - 1
    assert got[None].text == "" and got[2].text == "" and got[4].text == "cut off &am" and got[5].text == ""
    assert html_text.extract_pages(spark, df.limit(0)).count() == 0


RECORD = "record_id long, type string, url string, ts timestamp, etag string, last_modified string, headers map<string,string>, payload_digest string"


def at(hours):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=hours)


def test_revisits(spark):
    rows = [
        (1, "response", "http://www.A.org/x/?utm_source=1", at(0), '"e1"', "d1", {"ETag": '"e1"', "Content-Type": "text/html", "Age": "1"}, "p1"),
        (2, "response", "https://a.org/x#frag", at(50), 'W/"e2"', None, {"Content-Length": "9"}, "p2"),
        (3, "revisit", "https://a.org:443/x", at(1), 'W/"e1"', "other", {"age": "7", "CONTENT-TYPE": "none", "Date": "now"}, None),
        (4, "revisit", "https://a.org/x/", at(100), '"e2"', None, None, None),
        (5, "revisit", "https://a.org/x/", at(100), '"e1"', None, None, None),
        (6, "revisit", "https://a.org/x/", at(100), None, "d1", None, None),
        (7, "revisit", "https://a.org/x/", at(100), None, None, None, "p2"),
        (8, "revisit", "https://a.org/x/", at(100), None, None, None, None),
        (9, "revisit", "https://b.org/", at(100), '"e1"', None, None, None),
        (10, "revisit", None, at(100), '"e1"', None, None, None),
        (11, "revisit", "https://a.org/x", None, '"e1"', None, None, None),
        (12, "request", "https://a.org/x", at(3), None, None, None, None),
        (13, "revisit", "https://a.org/x", at(-1), '"e1"', None, None, None),
        (2, "revisit", "https://a.org/x", at(50), '"e2"', None, None, None),
        (3, "revisit", "https://a.org:443/x", at(1), 'W/"e1"', "other", {"age": "7", "CONTENT-TYPE": "none", "Date": "now"}, None),
    ]
    df = spark.createDataFrame(rows, RECORD).withColumn("block", F.lit(1)).withColumn("full", F.lit(2)).withColumn("status", F.lit(3))
    got = revisits.resolve_revisits(df).collect()
    assert len(got) == 12
    by = {r.record_id: r for r in got}
    assert {k: (r.status, r.response_id) for k, r in by.items()} == {2: ("resolved", 2), 3: ("resolved", 1), 4: ("resolved", 2), 5: ("mismatch", 2), 6: ("mismatch", 2), 7: ("resolved", 2), 8: ("no_validator", 2), 9: ("no_response", None), 10: ("no_response", None), 11: ("no_response", None), 13: ("no_response", None)}
    assert by[3].headers == {"etag": '"e1"', "content-type": "text/html", "age": "7", "date": "now"} and by[3].payload_digest == "p1"
    assert by[4].headers == {"content-length": "9"} and by[5].headers is None
    assert revisits.resolve_revisits(df.limit(0)).count() == 0
    hot = [(k, "response" if k % 50 == 0 else "revisit", "http://h.org/", at(k), '"x"', None, None, "p") for k in range(500)]
    late = {r.record_id: r.response_id for r in revisits.resolve_revisits(spark.createDataFrame(hot, RECORD)).collect()}
    assert late == {k: k // 50 * 50 for k in range(500) if k % 50}


def test_canonical_urls(spark):
    rows = [("http://a.org/?x=/", "a.org?x=/"), ("http://a.org/?x=", "a.org?x="), ("https://a.org:80/", "a.org:80"), ("http://a.org:443", "a.org:443"), ("HTTP://www.A.org:80/B/?utm_a=1&c=2&utm_d", "a.org/B?c=2"), ("https://u@a.org:443/x/y/#z", "a.org/x/y"), ("a.org:80/x", "a.org:80/x"), ("http://a.org//", "a.org/"), ("", ""), (None, None), ("http://a.org/" + "x" * 50_000 + "/", "a.org/" + "x" * 50_000)]
    got = spark.createDataFrame(rows, "url string, want string").select("want", revisits.canonical_url(F.col("url")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_revisits_of_one_url_in_one_second(spark):
    hot = [(k, "response" if k % 70 == 3 else "revisit", "http://h.org/", at(0), '"x"', None, None, "p") for k in range(400)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # many blocks of the one second
    try:
        got = {r.record_id: r.response_id for r in revisits.resolve_revisits(spark.createDataFrame(hot, RECORD)).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {k: (k - 3) // 70 * 70 + 3 if k >= 3 else None for k in range(400) if k % 70 != 3}
