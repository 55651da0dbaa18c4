"""Character references of pages, with and without their semicolons."""

import duckdb

from sieveworks import queries
from sieveworks.functions import html

TEXTS = ["a &amp; b", "a &amp", "a &am", "a &", "&lt;b&gt", "&quot;x&quo", "&#x27;y&#x2", "&ampx; z", "R&D &amp;amp; S"]


def test_page_texts_with_cut_references_equal_their_sql(spark, tmp_path):
    pages = [(i, "https://example.com/", f"<html><head><title>{t}</title></head><body><h1>{t}</h1><p>end</p></body></html>") for i, t in enumerate(TEXTS)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    df = queries.QUERIES["page_texts"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.sql(f"SELECT {', '.join(df.columns)} FROM ({queries.SQL['page_texts']})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)


def test_references_without_semicolon_are_read_as_asked():
    assert html.visible("a &amp b &copy 1 &lt;&#38;") == "a & b © 1 <&"
    assert html.visible("a &amp b &copy 1 &lt;&#38;", loose=False) == "a &amp b &copy 1 <&"
    assert html.visible('<img alt="x &amp y &amp; z"> &am', loose=False) == " &am\n[image: x &amp y & z]"
