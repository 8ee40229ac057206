"""All links of a page are counted."""

import duckdb

from postmill.plans import texts


def test_page_with_many_links(spark, tmp_path):
    html = " ".join(f'<a href="https://a.org/{k}">x</a>' for k in range(2500)) + '<a href="https://a.org/7">again</a>'
    rows = [(1, "http://b.org/", html), (2, "http://b.org/", None), (3, None, "no link")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted(map(tuple, texts.links_extract(spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert got == sorted(con.execute(texts.SQL["links_extract"]).fetchall()) == [(1, 2501), (2, 1), (3, 0)]
