"""URL filter: explicit host and path rules first, then gradient-boosted trees on lexical features.

The features are columns, but for entropy, which is one pass over the bytes of an Arrow batch. The labelled URLs are made
up from the fixed values below, as no table labels URLs: both classes have hosts with and without hyphens, digits and
subdomains, paths of numbers and of words, and parameters, so that no feature tells the classes apart by itself.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm.scratch import small_batches
from postmill.llm.word_sets import buffers

#: Fixed values of the labelled URLs: parts of host names, by label (1: block), and forms of hosts, paths and suffixes with
#: their shares. In a form, w is a part of a name, s a word of a path, n a number, k a short number and x a hexadecimal run.
PARTS = {
    1: "casino bet slots bonus poker pills meds cheap loan cash win lucky deals free offer click track ads pop cams date replica crypto spin jackpot fast rich promo".split(),
    0: "news library garden sailing club college museum weather recipe history city music travel health maps science river school paper notes open north book farm bike cook radio forum".split(),
}
WORDS = "spring garden council budget report winter festival bridge opening guide reading letters history water harbour evening market lesson summer review".split()
HOSTS = {
    1: [("w-w", 35), ("w-w-w", 10), ("w-w-k", 10), ("wwk", 15), ("xx", 10), ("ww", 10), ("w.w-w", 10)],
    0: [("w", 22), ("ww", 27), ("w-w", 16), ("w-w-w", 10), ("w.ww", 10), ("wk", 5), ("w-k", 5), ("ww.w", 5)],
}
FRONTS = [("", 55), ("www.", 20), ("m.", 12), ("blog.", 13)]
PATHS = {
    "numbers": [("/s/n.html", 20), ("/s/n", 20), ("/s/n/", 15), ("/s/n?page=k&ref=s", 20), ("/s/n?utm_source=s", 15), ("/s/n#s", 10)],
    "tracking": [("/s?aff=n&sub=k&clk=xx", 40), ("/s/n/s?cid=xx&pid=k&src=s&z=n", 40), ("/?bonus=n&id=k&u=xx&r=n", 20)],
    "words": [("/s/s-s-s", 30), ("/s/n/s-s", 15), ("/s", 15), ("/", 15), ("/s/s/s.html", 15), ("/s?q=s", 10)],
}
#: Shares of the kinds of paths by label and by whether the host has a hyphen.
KINDS = {
    (1, True): [("numbers", 77), ("tracking", 20), ("words", 3)], (1, False): [("tracking", 80), ("numbers", 10), ("words", 10)],
    (0, True): [("words", 90), ("numbers", 7), ("tracking", 3)], (0, False): [("numbers", 55), ("words", 40), ("tracking", 5)],
}
SUFFIXES = {
    1: [("example.com", 25), ("example.net", 20), ("example.org", 20), ("top", 12), ("click", 8), ("com", 10), ("info", 5)],
    0: [("example.com", 25), ("example.net", 20), ("example.org", 20), ("org", 15), ("edu", 5), ("com", 10), ("info", 5)],
}
URLS_PER_LABEL, URLS_PER_HOST = 1600, 4
#: Labelled URLs with the same suffix or domain from which on it has a rate of its own.
OFTEN = 10 * URLS_PER_HOST
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))

FEATURES = ["length", "host_length", "path_length", "depth", "digits", "host_digits", "path_digits", "parameters", "hyphens", "host_parts", "longest_part", "host_entropy", "entropy", "suffix_rate", "domain_rate"]


def labelled_urls(seed: int = 5) -> tuple[list[str], np.ndarray]:
    """A small training table, drawn by ``seed`` from the fixed values: some URLs of each of many hosts."""
    draw = np.random.default_rng(seed)

    def pick(shares):
        return shares[int(draw.choice(len(shares), p=np.array([n for _, n in shares]) / sum(n for _, n in shares)))][0]

    def filled(form: str, label: int) -> str:
        made = {"w": lambda: draw.choice(PARTS[label]), "s": lambda: draw.choice(WORDS), "n": lambda: str(draw.integers(10, 9999)), "k": lambda: str(draw.integers(1, 99)), "x": lambda: f"{draw.integers(1 << 12, 1 << 16):x}"}
        literal = {"page": "page", "ref": "ref", "utm_source": "utm_source", "aff": "aff", "sub": "sub", "clk": "clk", "cid": "cid", "pid": "pid", "src": "src", "bonus": "bonus", "html": "html"}
        out, at = [], 0
        while at < len(form):
            name = next((k for k in literal if form.startswith(k, at)), None)
            out.append(name or (made[form[at]]() if form[at] in made else form[at]))
            at += len(name or form[at])
        return "".join(out)

    urls, labels = [], []
    for label in (1, 0):
        for _ in range(URLS_PER_LABEL // URLS_PER_HOST):
            host = f"{pick(FRONTS)}{filled(pick(HOSTS[label]), label)}.{pick(SUFFIXES[label])}"
            for _ in range(URLS_PER_HOST):
                path = filled(pick(PATHS[pick(KINDS[label, '-' in host])]), label)
                urls.append(f"{draw.choice(['http', 'https'])}://{host}{path}")
                labels.append(label)
    return urls, np.array(labels, float)


class BoostedTrees:
    """Gradient boosting of regression trees on the logistic loss, exact splits, for small training tables."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.3, leaf: int = 8):
        self.rounds, self.depth, self.rate, self.leaf = rounds, depth, rate, leaf

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        self.trees, margin = [], np.full(len(y), self.base)
        self.gains = np.zeros(x.shape[1])  # by feature, over all splits
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            tree = self._grow(x, y - p, p * (1 - p), self.depth)
            self.trees.append(tree)
            margin += self.rate * self._apply(tree, x)
        return self

    def _grow(self, x, g, h, depth):
        value = g.sum() / (h.sum() + 1)
        best = (1e-6, None, None)
        if depth:
            for j in range(x.shape[1]):
                order = np.argsort(x[:, j], kind="stable")
                gs, hs, xs = g[order].cumsum(), h[order].cumsum(), x[order, j]
                at = np.flatnonzero(xs[1:] > xs[:-1]) + 1
                at = at[(at >= self.leaf) & (at <= len(xs) - self.leaf)]
                if len(at):
                    a, b = gs[at - 1], hs[at - 1]
                    gain = a**2 / (b + 1) + (gs[-1] - a) ** 2 / (hs[-1] - b + 1) - gs[-1] ** 2 / (hs[-1] + 1)
                    k = gain.argmax()
                    if gain[k] > best[0]:
                        best = (gain[k], j, (xs[at[k]] + xs[at[k] - 1]) / 2)
        if best[1] is None:
            return value
        low = x[:, best[1]] <= best[2]
        self.gains[best[1]] += best[0]
        return best[1], best[2], self._grow(x[low], g[low], h[low], depth - 1), self._grow(x[~low], g[~low], h[~low], depth - 1)

    def _apply(self, tree, x):
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        low = x[:, tree[0]] <= tree[1]
        out = np.empty(len(x))
        out[low], out[~low] = self._apply(tree[2], x[low]), self._apply(tree[3], x[~low])
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1."""
        return 1 / (1 + np.exp(-(self.base + self.rate * sum(self._apply(t, x) for t in self.trees))))


def lexical(url: Column) -> tuple[list[Column], list[Column], list[Column]]:
    """Host, path and query; the features that columns can express, in the order of FEATURES; suffix and domain of the host."""
    host, path = host_and_path(url)
    query = F.regexp_extract(url, r"(?s)://[^?#]*\?([^#]*)", 1)
    digits = lambda x: F.length(x) - F.length(F.translate(x, "0123456789", ""))
    parts = F.split(F.col("host"), r"\.")
    ratio = lambda x: F.when(F.length(x) > 0, digits(x) / F.length(x)).otherwise(0.0)
    numbers = [
        F.length(url), F.length("host"), F.length("path"), F.size(F.array_remove(F.split("path", "/"), "")), ratio(url), ratio(F.col("host")), ratio(F.col("path")),
        F.length("query") - F.length(F.translate("query", "=", "")), F.length("host") - F.length(F.translate("host", "-", "")), F.size(parts), F.array_max(F.transform(parts, F.length)),
    ]
    return [host.alias("host"), path.alias("path"), query.alias("query")], [c.cast("double").alias(n) for c, n in zip(numbers, FEATURES)], [F.element_at(parts, -1).alias("suffix"), F.array_join(F.slice(F.concat(F.array(F.lit("")), parts), -2, 2), ".").alias("domain")]


def _described(urls: DataFrame, *more: str) -> DataFrame:
    """``urls`` (url and ``more``) with host, path, suffix, domain and an array of the features that are columns."""
    cut, numbers, ends = lexical(F.coalesce("url", F.lit("")))
    return urls.select(*more, "url", *cut).select(*more, "url", "host", "path", *ends, F.array(*numbers).alias("numbers"))


def entropies(texts: pa.Array) -> np.ndarray:
    """Shannon entropy of each text's bytes; 0 for null and empty ones."""
    data, offsets = buffers(texts)
    out = np.zeros(len(texts))
    for k in range(0, len(texts), 1024):
        ends = offsets[k : k + 1025]
        sizes = np.diff(ends)
        counts = np.bincount(np.repeat(np.arange(len(sizes)), sizes) * 256 + data[ends[0] : ends[-1]], minlength=256 * len(sizes)).reshape(-1, 256)
        share = counts / np.maximum(1, sizes)[:, None]
        out[k : k + 1024] = -(share * np.log2(np.where(share > 0, share, 1))).sum(1)
    return np.maximum(0, out)


def matrix(batch: pa.RecordBatch, rates: dict[str, float]) -> np.ndarray:
    """The features of a batch of described URLs."""
    numbers = np.asarray(batch.column("numbers").flatten(), np.float64).reshape(batch.num_rows, -1)
    ends = [np.array([rates.get(x, 0.5) for x in batch.column(name).to_pylist()], float) for name in ("suffix", "domain")]
    return np.column_stack([numbers, entropies(batch.column("host")), entropies(batch.column("url")), *ends])


def train(spark: SparkSession, urls: Sequence[str], labels) -> tuple[BoostedTrees, dict[str, float]]:
    """The trees, and the smoothed block rates of suffixes and domains (the two last parts of a host).

    Only ends seen often enough to be shared by many hosts have a rate, or the rate of a host's own domain would give its label away.
    """
    rows = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "at long, url string")
    found = _described(rows, "at").orderBy("at").toArrow().combine_chunks().to_batches()[0]  # the training table, as long as given
    labels = np.asarray(labels, float)
    counts: dict[str, list[float]] = {}
    for name in ("suffix", "domain"):
        for end, label in zip(found.column(name).to_pylist(), labels):
            one = counts.setdefault(end, [1.0, 2.0])
            one[0] += label
            one[1] += 1
    rates = {k: a / n for k, (a, n) in counts.items() if n >= OFTEN}
    return BoostedTrees().fit(matrix(found, rates), labels), rates


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, path; both empty without ``://``."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    cut = r"(?s)://([^/?#]*)([^?#]*)"
    return F.coalesce(F.translate(F.regexp_extract(url, cut, 1), upper, lower), F.lit("")), F.coalesce(F.regexp_extract(url, cut, 2), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits host (or a parent domain) and path, and its verdict; nulls if none fits."""
    fits, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, start, says in sorted(rules, key=lambda r: len(r[0] + r[1])):
        hit = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        fits, verdict = F.when(hit, name + start).otherwise(fits), F.when(hit, says).otherwise(verdict)
    return fits, verdict


def _judge(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, rates = model.value
        for batch in batches:
            score = trees.predict(matrix(batch, rates)) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("page_id", "host", "path", "rule", "verdict")), pa.array(score)], ["page_id", "host", "path", "rule", "verdict", "score"])

    return run


def judge_urls(spark: SparkSession, pages: DataFrame, rules=RULES, urls: Sequence[str] | None = None, labels=None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for each row of ``pages``.

    The longest fitting rule decides; else the trees, trained from ``urls`` and ``labels`` (the built-in table if not
    given): block at a score of 0.5 or more. A null, empty or scheme-less url has an empty host and path, no rule, and
    the trees' verdict on an empty host. Very long urls are read whole; repeated rows and null ids are judged like others;
    other columns are not read. An empty table gives an empty table.
    """
    if urls is None:
        urls, labels = labelled_urls()
    model = spark.sparkContext.broadcast(train(spark, urls, labels))  # some kilobytes
    small_batches(spark)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    rows = _described(rows, "page_id").withColumns({"rule": rule, "verdict": verdict})
    judged = rows.mapInArrow(_judge(model), "page_id long, host string, path string, rule string, verdict string, score double")
    return judged.withColumn("verdict", F.coalesce("verdict", F.when(F.col("score") >= 0.5, "block").otherwise("allow")))
