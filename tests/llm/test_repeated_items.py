"""Benchmarks that repeat an item_id with another text."""

import pytest

from postmill.llm import decontaminate
from tests.llm.helpers import contained


def words(name, n):
    return " ".join(f"{name}{k}" for k in range(n))


@pytest.mark.parametrize("turned", [False, True])
def test_each_text_of_an_item_counts(spark, turned):
    items = [(i, words(f"{kind}{i}x", n)) for i in range(8) for kind, n in (("short", 8), ("long", 28), ("longer", 90))]
    parts = {kind: {i: words(f"{kind}{i}x", n) for i in range(8)} for kind, n in (("short", 8), ("long", 28), ("longer", 90))}
    texts = {}
    for i in range(8):
        texts |= {10 * i: parts["short"][i] + " and " + words(f"long{i}x", 10), 10 * i + 1: words(f"long{i}x", 10), 10 * i + 2: parts["long"][i] + " and " + words(f"longer{i}x", 20), 10 * i + 3: words(f"longer{i}x", 85)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    benchmark = spark.createDataFrame(items[::-1] if turned else items, "item_id long, text string")
    want = set().union(*(contained(texts, part) for part in parts.values()))
    rows = decontaminate.contaminated_pairs(spark, docs, benchmark).collect()
    assert len(rows) == len(want) == 24 and {(r.id, r.item) for r in rows} == want
