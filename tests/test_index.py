"""The identifier index against a scan of the values."""

import random
import re

from pyspark.sql import functions as F

from postmill.operators import index as I


def normal(x):
    return re.sub(r"[\s\-_/.,:;]", "", re.sub(r"\s+", " ", re.sub("[№#]", "n", (x or "").lower().replace(" ", " ").replace("ё", "е"))).strip())


def scan(rows, text):
    """{(entity, id): (score, field)} of the rows (entity, id, field, value) whose value is or holds the text."""
    asked, out = normal(text), {}
    for entity, key, field, value in rows:
        have = normal(value)
        if asked and have and key is not None and (have == asked or (len(asked) >= 3 and asked in have)):
            found = (100 if have == asked else 60, field, have)
            out[entity, str(key)] = max(out.get((entity, str(key)), (0, "", "")), found)
    return {k: v[:2] for k, v in out.items()}


def table(draw, entity, n):
    value = lambda: draw.choice([None, "", "A-1", f"AB-{draw.randrange(40)}", f"№ {draw.randrange(300)}/Ё", "same value for all", f"<m{draw.randrange(50)}@x.ru>"])
    return [(entity, draw.choice([None, *range(30)]), value(), value()) for _ in range(n)]


def flat(rows):
    return [(e, i, f, v) for e, i, a, b in rows for f, v in (("number", a), ("note", b))]


def posted(spark, rows, **more):
    df = spark.createDataFrame(rows, "entity string, key long, a string, b string")
    return I.postings(df, rows[0][0], "key", {"number": F.col("a"), "note": F.col("b")}, **more)


def test_lookups_equal_a_scan_after_appends_and_merge(spark, tmp_path):
    draw = random.Random(6)
    index = I.IdentifierIndex(spark, f"file://{tmp_path}/i")
    assert index.lookup("x").count() == 0
    cases, mail = table(draw, "case", 60), table(draw, "mail", 60)
    index.append(posted(spark, cases), posted(spark, mail))
    later = table(draw, "case", 40)
    index.append(posted(spark, later))
    asked = ["AB-1", "ab 12", "A", "A-1", "12", "№ 7", "n7/е", "SAME  value", "same", "@x.ru", "nothing", "", "-", "12е"]
    for _ in range(2):
        for text in asked:
            got = {(r.entity, r.id): (r.score, r.field) for r in index.lookup(text, limit=None).collect()}
            assert got == scan(flat(cases + mail + later), text), text
        index.merge()
        assert len(index.segments()) == 1
    only = index.lookup("AB-1", ["mail"], limit=2).collect()
    assert all(r.entity == "mail" for r in only) and len(only) <= 2


def test_withdrawn_postings_are_gone(spark, tmp_path):
    index = I.IdentifierIndex(spark, f"file://{tmp_path}/w")
    index.append(posted(spark, [("case", 1, "K-771", None), ("case", 2, "K-771", None)]))
    index.append(posted(spark, [("case", 1, "K-771", None)], live=False), posted(spark, [("case", 1, "K-772", None)]))
    for _ in range(2):
        assert [r.id for r in index.lookup("k771").collect()] == ["2"]
        assert [r.id for r in index.lookup("K-77", limit=None).orderBy("id").collect()] == ["1", "2"]
        index.merge()
    index.append(posted(spark, [("case", 1, "K-771", None)]))
    assert sorted(r.id for r in index.lookup("k771").collect()) == ["1", "2"]


def test_a_lookup_reads_the_asked_buckets_only(spark, tmp_path):
    index = I.IdentifierIndex(spark, f"file://{tmp_path}/b")
    index.append(posted(spark, [("case", k, f"N{k:05d}", None) for k in range(500)]))
    plan = index.lookup("N00042")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert "In(term" in plan.split("PushedFilters")[1] or "EqualTo(term" in plan.split("PushedFilters")[1]
    read = index._read(index.segments()).where(F.col("bucket") == 3).select(F.input_file_name()).distinct().collect()
    assert 1 <= len(read) <= I.CUTS
    many = index.lookup_many(spark.createDataFrame([("n-00007",), ("n00499",), ("zz",), (None,)], "ask string"), "ask")
    assert sorted((r.ask, r.entity, r.found_id, r.field) for r in many.collect()) == [("n-00007", "case", "7", "number"), ("n00499", "case", "499", "number")]


def test_a_value_is_one_row_whatever_its_length(spark, tmp_path):
    index = I.IdentifierIndex(spark, f"file://{tmp_path}/r")
    rows = [("case", k, f"N-{k:05d}/{k:05d}", None) for k in range(3000)]
    index.append(posted(spark, rows), posted(spark, rows))
    read = index._read(index.segments())
    assert read.where("whole").count() == 3000 and read.count() < 6000
    assert [r.id for r in index.lookup("2999/02999").collect()] == ["2999"]
    assert {r.id for r in index.lookup("0100/", limit=None).collect()} == {str(k) for k in range(3000) if "0100" in f"n{k:05d}{k:05d}"}
