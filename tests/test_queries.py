import os

import pytest

import __spark_entry__ as entry
from vellumtide.operators import markdown, pageset
from vellumtide.plans import catalog

SF = "/root/testdata/sf0.001"
FAST = ["words", "pdf_roundtrip", "search_hits", "heading_levels", "labels_asof", "inherited_attr", "form_fill", "select_pages", "insert_range", "cell_escape", "label_roman", "display_transform"]


@pytest.mark.parametrize("name", FAST)
def test_query_against_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    a, b = catalog.QUERIES[name](spark, SF).toPandas(), c.sql(catalog.ORACLES[name]).df()
    assert sorted(a) == sorted(b) and len(a) == len(b)
    cols = sorted(a)
    a, b = (x[cols].sort_values(cols, ignore_index=True) for x in (a, b))
    for k in cols:
        assert ((a[k] == b[k]) | (a[k].isna() & b[k].isna())).all(), k


def test_entry_and_names(spark):
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
    assert entry.entry(spark).limit(1).count() == 1


def test_page_sets(spark):
    p = spark.createDataFrame([("d", i, f"p{i}") for i in range(4)], "doc_id string, pno long, t string")
    names = lambda df: [r["t"] for r in df.orderBy("pno").collect()]
    assert names(pageset.copy(p, 1, 0)) == ["p1", "p0", "p1", "p2", "p3"]
    assert names(pageset.new_page(p, 2, t="new")) == ["p0", "p1", "new", "p2", "p3"]
    assert names(pageset.insert(p, p, 3, 2, 1)) == ["p0", "p3", "p2", "p1", "p2", "p3"]
    assert pageset.page_at(p, 9).count() == 0


def test_markdown_pieces():
    assert markdown.join_text("日", "本") == "日本" and markdown.join_text("a", "b") == "a b"
    assert markdown.list_item("• x") == "- x" and markdown.list_item("3) y") == "3. y" and markdown.list_item("3.5 z") is None
    assert markdown.emphasize(" b ", 18) == " ***b*** "


def test_streaming_ingest(spark, tmp_path):
    from vellumtide.sources.pdfwriter import text_document
    from vellumtide.streaming.ingest import ingest

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.pdf").write_bytes(text_document([[(40, 20, 10, "hello")]]))
    q = ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert [r["text"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["hello\n"]
