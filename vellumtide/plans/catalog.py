"""All queries of the document engine, by name, with the SQL that must give the same rows.

The tables hold no PDF files, so each query sets its operator on stand-in rows: texts become typeset pages or real PDF bytes; orders, customers and conversations stand for
pages, labels, trees and outlines."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellumtide.functions import geometry as G
from vellumtide.functions import text as T
from vellumtide.operators import layout, markdown, pageset, structure, tables
from vellumtide.sources import readers, typesetter
from vellumtide.sources.filesource import FileSource
from vellumtide.sources.pagesource import PageSource

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


# --- layout --------------------------------------------------------------------------------------------------------

_LINES = r"""
WITH l0 AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS txt, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS ln FROM documents),
l AS (SELECT doc_id, ln, txt, CASE WHEN ln = 0 THEN 20.0::DOUBLE WHEN ln % 7 = 3 THEN 14.0::DOUBLE ELSE 10.0::DOUBLE END AS size, (12 * ln + 12)::DOUBLE AS y, length(txt) AS n FROM l0 WHERE length(txt) > 0),
b0 AS (SELECT *, CASE WHEN y - lag(y) OVER w > 1.5::DOUBLE * greatest(lag(size) OVER w, size) OR lag(y) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY ln)),
b1 AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY ln) - 1 AS block_no FROM b0),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, block_no ORDER BY ln) - 1 AS line_no FROM b1)
"""

_WORDS = (
    _LINES
    + r""",
p AS (SELECT *, unnest(string_split(txt, ' ')) AS word, generate_subscripts(string_split(txt, ' '), 1) AS k FROM b),
q AS (SELECT *, sum(length(word) + 1) OVER (PARTITION BY doc_id, ln ORDER BY k) - length(word) - 1 AS off FROM p)
SELECT doc_id, 0::INT AS pno, 40 + off * (size / 2) AS x0, y - 0.8::DOUBLE * size AS y0, 40 + (off + length(word)) * (size / 2) AS x1, y + 0.2::DOUBLE * size AS y1, word,
  block_no::BIGINT AS block_no, line_no::BIGINT AS line_no, row_number() OVER (PARTITION BY doc_id, ln ORDER BY k) - 1 AS word_no
FROM q WHERE word <> ''
"""
)


@query(_WORDS)
def words(spark, sf_dir):
    return layout.words(typesetter.pages(docs(spark, sf_dir)))


@query(_WORDS)
def pdf_roundtrip(spark, sf_dir):
    """Texts written as PDF files, parsed again, interpreted and split into words."""
    return layout.words(readers.parse(typesetter.files(docs(spark, sf_dir))))


@query(
    _LINES
    + """SELECT d.doc_id, 0::INT AS pno, coalesce(t, '') AS text FROM documents d LEFT JOIN
    (SELECT doc_id, string_agg(rtrim(txt, ' ') || chr(10), '' ORDER BY ln) AS t FROM b GROUP BY doc_id) x ON x.doc_id = d.doc_id"""
)
def page_text(spark, sf_dir):
    return layout.page_text(typesetter.pages(docs(spark, sf_dir)))


@query(
    _LINES
    + """SELECT doc_id, 0::INT AS pno, 40::DOUBLE AS x0, min(y - 0.8::DOUBLE * size) AS y0, max(40 + n * (size / 2)) AS x1, max(y + 0.2::DOUBLE * size) AS y1,
    string_agg(trim(txt, ' '), chr(10) ORDER BY ln) AS text, block_no::BIGINT AS block_no, 0::INT AS type FROM b GROUP BY doc_id, block_no"""
)
def blocks(spark, sf_dir):
    return layout.blocks(typesetter.pages(docs(spark, sf_dir)))


@query(
    _LINES
    + """SELECT doc_id, 0::INT AS pno, block_no::BIGINT AS block_no, line_no::BIGINT AS line_no, 0::BIGINT AS span_no, 40::DOUBLE AS x0, y - 0.8::DOUBLE * size AS y0, 40 + n * (size / 2) AS x1,
    y + 0.2::DOUBLE * size AS y1, 40::DOUBLE AS origin_x, y AS origin_y, size, 'Helvetica' AS font, 0::INT AS flags, txt AS text, 1::DOUBLE AS dir_x, 0::DOUBLE AS dir_y, 0::INT AS wmode FROM b"""
)
def spans_dict(spark, sf_dir):
    return layout.spans(typesetter.pages(docs(spark, sf_dir)))


@query(
    _LINES
    + """SELECT doc_id, 0::INT AS pno, row_number() OVER (PARTITION BY doc_id ORDER BY ln) - 1 AS line_no, (1 + (n - length(replace(txt, ' ', ''))) // 8)::INT AS segments,
    40 + n * (size / 2) + ((n - length(replace(txt, ' ', ''))) // 8) * 4 * size AS x1, y FROM b"""
)
def segments(spark, sf_dir):
    """Lines with a wide gap before every eighth space."""
    return layout.line_segments(typesetter.pages(docs(spark, sf_dir), wide_every=8))


@query(
    _LINES
    + """, h0 AS (SELECT *, unnest(string_split(lower(txt), 'the')) AS part, generate_subscripts(string_split(lower(txt), 'the'), 1) AS k FROM b),
    h AS (SELECT *, sum(length(part) + 3) OVER (PARTITION BY doc_id, ln ORDER BY k) - 3 AS off, count(*) OVER (PARTITION BY doc_id, ln) AS m FROM h0)
    SELECT doc_id, 0::INT AS pno, row_number() OVER (PARTITION BY doc_id ORDER BY ln, k) - 1 AS hit_no, 40 + off * (size / 2) AS x0, y - 0.8::DOUBLE * size AS y0, 40 + (off + 3) * (size / 2) AS x1, y + 0.2::DOUBLE * size AS y1
    FROM h WHERE k < m"""
)
def search_hits(spark, sf_dir):
    return layout.search(typesetter.pages(docs(spark, sf_dir)), "the")


@query()
def reading_order_two_columns(spark, sf_dir):
    """Lines in reading order on pages whose second half of lines stands beside the first."""
    return layout.lines(typesetter.pages(docs(spark, sf_dir), two_columns=True))


@query(
    _LINES
    + """, s AS (SELECT doc_id, size, sum(n) AS chars, min(ln) AS first FROM b GROUP BY doc_id, size),
    m AS (SELECT doc_id, arg_max(size, chars * 100000 - first) AS body FROM s GROUP BY doc_id)
    SELECT doc_id, size, least(dense_rank() OVER (PARTITION BY doc_id ORDER BY size DESC), 4)::INT AS level FROM s JOIN m USING (doc_id) WHERE size > 1.15::DOUBLE * body"""
)
def heading_levels(spark, sf_dir):
    return markdown.levels(typesetter.pages(docs(spark, sf_dir)))


_MARKDOWN = (
    _LINES
    + r""", s AS (SELECT doc_id, size, sum(n) AS chars, min(ln) AS first FROM b GROUP BY doc_id, size),
    m AS (SELECT doc_id, arg_max(size, chars * 100000 - first) AS body FROM s GROUP BY doc_id),
    h AS (SELECT doc_id, size, least(dense_rank() OVER (PARTITION BY doc_id ORDER BY size DESC), 4) AS level FROM s JOIN m USING (doc_id) WHERE size > 1.15::DOUBLE * body),
    t AS (SELECT doc_id, block_no, ln, trim(txt, ' ' || chr(9)) AS t, level FROM b LEFT JOIN h USING (doc_id, size) WHERE trim(txt, ' ' || chr(9)) <> ''),
    k AS (SELECT *, CASE WHEN level IS NOT NULL THEN '#' WHEN regexp_matches(t, '^([・•●○◦▪‣–—*-][ 　]|[・•●○◦▪‣]|[0-9]{1,3}[.)][ 　])') THEN '-' ELSE '' END AS kind FROM t),
    g AS (SELECT *, CASE WHEN kind = '' AND lag(kind) OVER w = '' AND lag(block_no) OVER w = block_no THEN 0 ELSE 1 END AS new FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY ln)),
    r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY ln) AS run FROM g),
    p AS (SELECT doc_id, run, any_value(kind) AS kind, string_agg(CASE WHEN kind = '#' THEN repeat('#', level::INT) || ' ' || t
        WHEN kind = '-' AND regexp_matches(t, '^[0-9]') THEN regexp_replace(t, '^([0-9]{1,3})[.)][ 　]+', '\1. ') WHEN kind = '-' THEN '- ' || trim(substr(t, 2), ' 　') ELSE t END, ' ' ORDER BY ln) AS t FROM r GROUP BY doc_id, run),
    j AS (SELECT *, CASE WHEN lag(kind) OVER w IS NULL THEN '' WHEN kind = '-' AND lag(kind) OVER w = '-' THEN chr(10) ELSE chr(10) || chr(10) END AS sep FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY run)),
    f AS (SELECT doc_id, string_agg(sep || t, '' ORDER BY run) AS markdown FROM j GROUP BY doc_id)
    SELECT d.doc_id, coalesce(markdown, '') AS markdown FROM documents d LEFT JOIN f ON f.doc_id = d.doc_id"""
)


@query(_MARKDOWN)
def markdown_document(spark, sf_dir):
    return markdown.documents(typesetter.pages(docs(spark, sf_dir)))


@query(
    """WITH r AS (SELECT s_suppkey // 50 AS doc_id, row_number() OVER (PARTITION BY s_suppkey // 50 ORDER BY s_suppkey) - 1 AS n, length(s_suppkey::VARCHAR) AS a, length(rtrim(s_name)) AS b, length(s_nationkey::VARCHAR) AS c FROM supplier),
    t AS (SELECT doc_id, count(*) AS rows, max(a) AS a, max(b) AS b, max(c) AS c FROM r GROUP BY doc_id HAVING count(*) >= 3),
    g AS (SELECT *, least(240 - (40 + 5 * a), 440 - (240 + 5 * b))::DOUBLE / 10 AS gutter FROM t)
    SELECT doc_id::BIGINT AS doc_id, 0::INT AS pno, 0::BIGINT AS table_no, 40::DOUBLE AS x0, 4::DOUBLE AS y0, (440 + 5 * c)::DOUBLE AS x1, (12 * rows + 2)::DOUBLE AS y1, rows::INT AS row_count, 3::INT AS col_count, 'text' AS strategy,
      greatest(least(0.65::DOUBLE + 0.1::DOUBLE * least((rows - 2)::DOUBLE / 3, 1) + 0.1::DOUBLE + 0.1::DOUBLE + 0.05::DOUBLE * least(gutter / 4, 1), 1), 0)::DOUBLE AS confidence,
      0::DOUBLE AS alignment_error_em, gutter AS minimum_gutter_em, 0::DOUBLE AS row_gap_variation_em FROM g"""
)
def text_tables(spark, sf_dir):
    """Suppliers set as rows of four aligned columns, 50 a page, found again as tables."""
    s = table(spark, sf_dir, "supplier")
    row = F.concat(F.rpad(F.col("s_suppkey").cast("string"), 10, " "), F.lit("\t"), F.rpad("s_name", 24, " "), F.lit("\t"), F.rpad(F.col("s_nationkey").cast("string"), 6, " "))
    page = s.select(F.floor(F.col("s_suppkey") / 50).alias("doc_id"), "s_suppkey", row.alias("row")).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", "row"))), lambda x: x["row"]), "\n").alias("text"))
    return tables.tables(_set_rows(page), "text")


def _set_rows(pages: DataFrame) -> PageSource:
    """Rows of tab-separated cells, columns 200 apart."""

    def expand(record):
        cols = [[] for _ in range(11)]
        for n, line in enumerate(record["text"].split("\n")):
            for c, cell in enumerate(line.split("\t")):
                for i, ch in enumerate(cell.rstrip()):
                    for col, v in zip(cols, (ch, 40.0 + 200 * c + 5 * i, 12.0 * n + 12, 10.0, 5.0, 1.0, 0.0, 0, "F1", "Helvetica", 0)):
                        col.append(v)
        yield {"doc_id": record["doc_id"], "pno": 0, "glyphs": dict(zip(("text", "x", "y", "size", "advance", "dir_x", "dir_y", "wmode", "font_key", "font", "flags"), cols)), "rules": []}

    return PageSource(pages, expand)


@query(
    """WITH r AS (SELECT s_suppkey // 50 AS doc_id, row_number() OVER (PARTITION BY s_suppkey // 50 ORDER BY s_suppkey) - 1 AS k, count(*) OVER (PARTITION BY s_suppkey // 50) AS m, rtrim(s_name) AS name FROM supplier),
    c AS (SELECT *, (m + 1) // 2 AS half, CASE WHEN k >= (m + 1) // 2 THEN 1 ELSE 0 END AS side FROM r), p AS (SELECT *, 40 + 200 * side AS x, 12 * (k - half * side) + 12 AS y FROM c)
    SELECT doc_id::BIGINT AS doc_id, 0::INT AS pno, k::BIGINT AS line_no, x::DOUBLE AS x0, (y - 8)::DOUBLE AS y0, (x + 5 * length(name))::DOUBLE AS x1, (y + 2)::DOUBLE AS y1, FALSE AS vertical, 1::INT AS segments, name AS text FROM p"""
)
def reading_order_columns(spark, sf_dir):
    """Supplier names in two columns of a page, 50 a page: the left one is read first."""
    s = table(spark, sf_dir, "supplier").select(F.floor(F.col("s_suppkey") / 50).alias("doc_id"), F.struct("s_suppkey", F.rtrim("s_name").alias("name")).alias("s"))
    page = s.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["name"]).alias("names"))
    half = F.floor((F.size("names") + 1) / 2).cast("int")
    left, right = F.slice("names", F.lit(1), half), F.slice("names", half + 1, F.size("names"))
    return layout.lines(_set_rows(page.select("doc_id", F.array_join(F.zip_with(left, right, lambda a, b: F.concat_ws("\t", a, b)), "\n").alias("text"))))


# --- geometry ------------------------------------------------------------------------------------------------------

_BOX = "l_quantity AS x, l_extendedprice / 100 AS y, (l_linenumber % 4) * 90 AS rot, 10.0::DOUBLE AS bx0, 20.0::DOUBLE AS by0, 610.0::DOUBLE AS bx1, 812.0::DOUBLE AS by1"


def _points(spark, sf_dir):
    box = G.rect(*map(F.lit, (10.0, 20.0, 610.0, 812.0)))
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 100).alias("y"), ((F.col("l_linenumber") % 4) * 90).alias("rot"))
    return t, box


@query(
    f"""WITH p AS (SELECT l_orderkey, l_linenumber, {_BOX} FROM lineitem)
    SELECT l_orderkey, l_linenumber, CASE rot WHEN 90 THEN y - by0 WHEN 180 THEN bx1 - x WHEN 270 THEN by1 - y ELSE x - bx0 END AS dx,
      CASE rot WHEN 90 THEN x - bx0 WHEN 180 THEN y - by0 WHEN 270 THEN bx1 - x ELSE by1 - y END AS dy FROM p"""
)
def display_transform(spark, sf_dir):
    t, box = _points(spark, sf_dir)
    d = G.to_display(F.col("x"), F.col("y"), box, F.col("rot"))
    return t.select("l_orderkey", "l_linenumber", d["x"].alias("dx"), d["y"].alias("dy"))


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, l_quantity AS x, l_extendedprice / 100 AS y, (l_linenumber % 4) * 90 AS rot FROM lineitem)
    SELECT l_orderkey, l_linenumber, CASE WHEN rot IN (90, 270) THEN y ELSE x END AS width, CASE WHEN rot IN (90, 270) THEN x ELSE y END AS height FROM p""")
def page_rect(spark, sf_dir):
    t, _ = _points(spark, sf_dir)
    media = G.rect(F.col("x"), F.col("y"), F.lit(0.0), F.lit(0.0))
    r = G.page_rect(media, F.lit(None).cast("struct<x0: double, y0: double, x1: double, y1: double>"), F.col("rot"))
    return t.select("l_orderkey", "l_linenumber", r["x1"].alias("width"), r["y1"].alias("height"))


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, l_quantity AS w, l_extendedprice / 100 AS h FROM lineitem), s AS (SELECT *, least(200.0::DOUBLE / w, 100.0::DOUBLE / h) AS s FROM p)
    SELECT l_orderkey, l_linenumber, 50 + (200 - s * w) / 2 AS x0, 60 + (100 - s * h) / 2 AS y0, 50 + (200 - s * w) / 2 + s * w AS x1, 60 + (100 - s * h) / 2 + s * h AS y1 FROM s""")
def placement(spark, sf_dir):
    t, _ = _points(spark, sf_dir)
    r = G.placement(G.rect(*map(F.lit, (50.0, 60.0, 250.0, 160.0))), F.col("x"), F.col("y"), True)
    return t.select("l_orderkey", "l_linenumber", r["x0"].alias("x0"), r["y0"].alias("y0"), r["x1"].alias("x1"), r["y1"].alias("y1"))


@query("""WITH p AS (SELECT p_partkey, p_size / 4.0::DOUBLE AS x0, p_size / 2.0::DOUBLE AS y0, p_retailprice / 8 AS x1, p_retailprice / 4 AS y1 FROM part),
    q AS (SELECT p_partkey, greatest(floor(x0 * 1.5::DOUBLE), 0)::BIGINT AS x0, greatest(floor(y0 * 1.5::DOUBLE), 0)::BIGINT AS y0, least(ceil(x1 * 1.5::DOUBLE), 300)::BIGINT AS x1, least(ceil(y1 * 1.5::DOUBLE), 400)::BIGINT AS y1 FROM p)
    SELECT * FROM q WHERE x0 < x1 AND y0 < y1""")
def pixel_crop(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    clip = G.rect(F.col("p_size") / 4.0, F.col("p_size") / 2.0, F.col("p_retailprice") / 8, F.col("p_retailprice") / 4)
    c = G.crop_pixels(clip, F.lit(1.5), F.lit(300), F.lit(400))
    return p.select("p_partkey", c.alias("c")).where("c is not null").select("p_partkey", "c.*")


@query("""WITH p AS (SELECT p_partkey, floor(p_size * 100 * 2.0::DOUBLE)::BIGINT AS w, floor(p_retailprice * 2)::BIGINT AS h FROM part)
    SELECT p_partkey, CASE WHEN w BETWEEN 1 AND 65535 AND h BETWEEN 1 AND 65535 AND w * h <= 64000000 THEN w END AS width, CASE WHEN w BETWEEN 1 AND 65535 AND h BETWEEN 1 AND 65535 AND w * h <= 64000000 THEN h END AS height,
    least(8, 12, greatest(1, 512000000 // (8 * (w * h))))::BIGINT AS workers FROM p""")
def render_budget(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 100).alias("w"), F.col("p_retailprice").alias("h"))
    s = G.render_size(F.col("w"), F.col("h"), F.lit(2.0))
    pixels = F.floor(F.col("w") * 2.0) * F.floor(F.col("h") * 2.0)
    return p.select("p_partkey", s["width"].alias("width"), s["height"].alias("height"), G.render_workers(F.lit(8), F.lit(12), pixels).alias("workers"))


@query("""SELECT l_orderkey, l_linenumber, l_quantity < l_extendedprice / 1000 AND l_discount < l_tax AS ok, abs(l_extendedprice / 1000 - l_quantity) AS width FROM lineitem""")
def rect_validate(spark, sf_dir):
    r = G.rect(F.col("l_quantity"), F.col("l_discount"), F.col("l_extendedprice") / 1000, F.col("l_tax"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", G.rect_ok(r).alias("ok"), F.abs(r["x1"] - r["x0"]).alias("width"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN abs(l_discount * 1e-8 - 5e-10) < 1e-9 THEN 0.0 ELSE l_discount * 1e-8 - 5e-10 END AS snapped FROM lineitem""")
def direction_snap(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", G.snap_direction(F.col("l_discount") * 1e-8 - 5e-10).alias("snapped"))


@query(
    f"""WITH p AS (SELECT l_orderkey, l_linenumber, {_BOX} FROM lineitem)
    SELECT l_orderkey, l_linenumber, CASE rot WHEN 90 THEN bx0 + y WHEN 180 THEN bx1 - x WHEN 270 THEN bx1 - y ELSE bx0 + x END AS qx,
      CASE rot WHEN 90 THEN by0 + x WHEN 180 THEN by0 + y WHEN 270 THEN by1 - x ELSE by1 - y END AS qy FROM p"""
)
def highlight_quads(spark, sf_dir):
    """The first corner of highlight quads."""
    t, box = _points(spark, sf_dir)
    q = G.rect_to_quad(G.rect(F.col("x"), F.col("y"), F.col("x") + 10, F.col("y") + 5), box, F.col("rot"))
    return t.select("l_orderkey", "l_linenumber", q[0].alias("qx"), q[1].alias("qy"))


# --- structure -----------------------------------------------------------------------------------------------------


@query("""WITH n AS (SELECT 'r' || r_regionkey AS id, NULL AS parent, CASE WHEN r_regionkey % 2 = 0 THEN 'v' || r_name END AS value FROM region
    UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, CASE WHEN n_nationkey % 3 = 0 THEN 'v' || n_name END FROM nation
    UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, CASE WHEN c_custkey % 5 = 0 THEN 'v' || c_name END FROM customer)
    SELECT a.id, coalesce(a.value, b.value, c.value) AS value FROM n a LEFT JOIN n b ON a.parent = b.id LEFT JOIN n c ON b.parent = c.id""")
def inherited_attr(spark, sf_dir):
    return structure.inherited(_tree(spark, sf_dir)).select("id", "value")


def _tree(spark, sf_dir):
    r, n, c = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    s = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    v = lambda k, m, name: F.when(F.col(k) % m == 0, F.concat(F.lit("v"), name))
    return (
        r.select(s("r", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"), v("r_regionkey", 2, "r_name").alias("value"))
        .unionByName(n.select(s("n", "n_nationkey").alias("id"), s("r", "n_regionkey").alias("parent"), v("n_nationkey", 3, "n_name").alias("value")))
        .unionByName(c.select(s("c", "c_custkey").alias("id"), s("n", "c_nationkey").alias("parent"), v("c_custkey", 5, "c_name").alias("value")))
    )


_FIELD_SQL = """WITH f AS (SELECT 'r' || r_regionkey AS id, NULL AS parent, r_name AS name, CASE r_regionkey % 5 WHEN 0 THEN 'Tx' WHEN 1 THEN 'Btn' WHEN 2 THEN 'Ch' WHEN 3 THEN 'Sig' END AS kind, (r_regionkey % 3) * 65536 AS flags, 0 AS depth FROM region
    UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name, CASE WHEN n_nationkey % 4 = 0 THEN 'Ch' END, CASE WHEN n_nationkey % 4 = 0 THEN 131072 END, 1 FROM nation
    UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_name, NULL, NULL, 2 FROM customer),
    x AS (SELECT a.id, concat_ws('.', c.name, b.name, a.name) AS full_name, coalesce(a.kind, b.kind, c.kind) AS kind, coalesce(a.flags, b.flags, c.flags)::INT AS flags FROM f a LEFT JOIN f b ON a.parent = b.id LEFT JOIN f c ON b.parent = c.id),
    t AS (SELECT id, full_name, CASE WHEN kind = 'Tx' THEN 'text' WHEN kind = 'Sig' THEN 'signature' WHEN kind = 'Ch' THEN CASE WHEN flags & 131072 <> 0 THEN 'combobox' ELSE 'listbox' END
      WHEN kind = 'Btn' THEN CASE WHEN flags & 65536 <> 0 THEN 'button' WHEN flags & 32768 <> 0 THEN 'radio' ELSE 'checkbox' END ELSE 'unknown' END AS type FROM x)"""


def _fields(spark, sf_dir):
    r, n, c = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    s = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    kind = F.element_at(F.array(*map(F.lit, ("Tx", "Btn", "Ch", "Sig", None))), (F.col("r_regionkey") % 5 + 1).cast("int"))
    none = lambda t: F.lit(None).cast(t)
    f = r.select(s("r", "r_regionkey").alias("id"), none("string").alias("parent"), F.col("r_name").alias("name"), kind.alias("kind"), ((F.col("r_regionkey") % 3) * 65536).cast("int").alias("flags"))
    some = F.col("n_nationkey") % 4 == 0
    f = f.unionByName(n.select(s("n", "n_nationkey").alias("id"), s("r", "n_regionkey").alias("parent"), F.col("n_name").alias("name"), F.when(some, "Ch").alias("kind"), F.when(some, 131072).alias("flags")))
    f = f.unionByName(c.select(s("c", "c_custkey").alias("id"), s("n", "c_nationkey").alias("parent"), F.col("c_name").alias("name"), none("string").alias("kind"), none("int").alias("flags")))
    return structure.dotted_names(f).select("id", "full_name", structure.field_type(F.col("kind"), F.col("flags")).alias("type"))


@query(_FIELD_SQL + " SELECT id, full_name, type FROM t")
def form_fields(spark, sf_dir):
    return _fields(spark, sf_dir)


@query(_FIELD_SQL + """, u AS (SELECT id, full_name AS name, type, 'old' AS value FROM t)
    SELECT name, type, CASE WHEN length(name) % 2 = 0 AND type <> 'signature' THEN 'new ' || name ELSE value END AS value, CASE WHEN length(name) % 2 = 0 AND type = 'signature' THEN 'signatures can''t be filled in' END AS error FROM u""")
def form_fill(spark, sf_dir):
    f = _fields(spark, sf_dir).select(F.col("full_name").alias("name"), "type", F.lit("old").alias("value"))
    return structure.fill_fields(f, f.where(F.length("name") % 2 == 0).select("name", F.concat(F.lit("new "), "name").alias("new_value")))


@query("""SELECT doc_id, lang AS title, source AS author, '' AS subject, '' AS keywords, '' AS creator, '' AS producer, '' AS "creationDate", '' AS "modDate", 'PDF 1.7' AS format FROM documents""")
def metadata_projection(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.create_map(F.lit("title"), "lang", F.lit("author"), "source").alias("info"))
    return d.select("doc_id", *structure.metadata(F.col("info"), F.lit("1.7")))


@query("""SELECT o_orderkey, 'new' AS title, '' AS author, o_orderpriority AS subject FROM orders""")
def set_metadata(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.create_map(F.lit("title"), "o_orderstatus", F.lit("author"), "o_orderstatus", F.lit("subject"), "o_orderpriority").alias("info"))
    new = structure.set_metadata(F.col("info"), {"title": "new", "author": ""})
    return o.select("o_orderkey", *structure.metadata(new, F.lit("1.7"))[:3])


@query(r"""WITH c AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '<rdf pdfaid:part="' || (page_id % 4) || '" pdfaid:conformance="B"/>' WHEN page_id % 3 = 1 THEN '<pdfaid:part>2</pdfaid:part><pdfaid:conformance>U</pdfaid:conformance>' ELSE html END AS x FROM pages)
    SELECT page_id, CASE WHEN page_id % 3 = 0 THEN (page_id % 4)::INT WHEN page_id % 3 = 1 THEN 2 END AS part, CASE WHEN page_id % 3 = 0 THEN 'B' WHEN page_id % 3 = 1 THEN 'U' END AS conformance FROM c""")
def pdfa_claim(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    x = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit('<rdf pdfaid:part="'), (F.col("page_id") % 4).cast("string"), F.lit('" pdfaid:conformance="B"/>')))
    x = x.when(F.col("page_id") % 3 == 1, F.lit("<pdfaid:part>2</pdfaid:part><pdfaid:conformance>U</pdfaid:conformance>")).otherwise(F.col("html"))
    return p.select("page_id", *structure.pdfa_claim(x))


@query("""WITH h AS (SELECT page_id AS doc_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS uri, generate_subscripts(regexp_extract_all(html, 'href="([^"]*)"', 1), 1) - 1 AS seq FROM pages)
    SELECT doc_id, seq::BIGINT AS seq, CASE WHEN seq % 3 = 0 THEN 2 ELSE 1 END::INT AS kind, CASE WHEN seq % 3 = 0 THEN uri END AS uri, CASE WHEN seq % 3 <> 0 THEN CASE WHEN seq < 4 THEN seq ELSE -1 END END::INT AS page FROM h""")
def links(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    h = p.select(F.col("page_id").alias("doc_id"), F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("seq", "uri")).withColumn("seq", F.col("seq").cast("long"))
    outer, no = F.col("seq") % 3 == 0, F.lit(None).cast("string")
    a = h.select("doc_id", "seq", F.when(outer, F.col("uri")).alias("uri"), F.when(~outer, F.col("seq") + 100).alias("dest"), no.alias("named"), no.alias("file"), no.alias("launch"))
    known = p.select(F.col("page_id").alias("doc_id"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("pno")).select("doc_id", (F.col("pno") + 100).cast("long").alias("obj_num"), "pno")
    return structure.resolve_links(a, known)


_LABEL_SQL = """WITH p AS (SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pno FROM orders),
    q AS (SELECT p.*, c_mktsegment AS seg, CASE WHEN pno < 3 THEN 0 ELSE 3 END AS s FROM p JOIN customer ON c_custkey = doc_id), r AS (SELECT *, CASE WHEN s = 0 THEN pno + 1 ELSE pno - 3 + 26 END AS n FROM q)"""


@query(
    _LABEL_SQL
    + """ SELECT doc_id, pno, CASE WHEN s = 0 THEN (['i', 'ii', 'iii'])[n] WHEN seg < 'F' THEN 'A-' || repeat(chr((65 + (n - 1) % 26)::INT), ((n - 1) // 26 + 1)::INT) ELSE 'A-' || n END AS label FROM r"""
)
def labels_asof(spark, sf_dir):
    """Orders of a customer as pages: small Roman numerals at first, then letters or digits from 26 on."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).alias("pno"))
    c = table(spark, sf_dir, "customer").join(o.select(F.col("doc_id").alias("c_custkey")).distinct(), "c_custkey", "left_semi")
    one = c.select(F.col("c_custkey").alias("doc_id"), F.lit(0).alias("startpage"), F.lit("r").alias("style"), F.lit("").alias("prefix"), F.lit(1).alias("firstpagenum"))
    two = c.select(F.col("c_custkey").alias("doc_id"), F.lit(3).alias("startpage"), F.when(F.col("c_mktsegment") < "F", "A").otherwise("D").alias("style"), F.lit("A-").alias("prefix"), F.lit(26).alias("firstpagenum"))
    return structure.page_labels(o, one.unionByName(two))


@query("""WITH t AS (SELECT 0 AS doc_id, row_number() OVER (ORDER BY k, lvl) AS seq, lvl AS level FROM (SELECT n_nationkey * 1000000 AS k, 1 + n_nationkey % 2 AS lvl FROM nation UNION ALL SELECT s_nationkey * 1000000 + s_suppkey, 2 + s_suppkey % 2 FROM supplier) x)
    SELECT seq, level::INT AS level, level <= coalesce(lag(level) OVER (ORDER BY seq), 0) + 1 AS ok FROM t""")
def toc_validate(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select((F.col("n_nationkey") * 1000000).cast("long").alias("k"), (1 + F.col("n_nationkey") % 2).cast("int").alias("level"))
    s = table(spark, sf_dir, "supplier").select((F.col("s_nationkey").cast("long") * 1000000 + F.col("s_suppkey")).alias("k"), (2 + F.col("s_suppkey") % 2).cast("int").alias("level"))
    t = n.unionByName(s).select(F.lit(0).alias("doc_id"), F.row_number().over(Window.orderBy("k", "level")).cast("long").alias("seq"), "level")
    return structure.check_toc(t).select("seq", "level", "ok")


@query("""SELECT source AS doc_id, 'doc-' || doc_id AS name, count(*) OVER (PARTITION BY source) AS n, row_number() OVER (PARTITION BY source ORDER BY 'doc-' || doc_id) AS place, n_chars AS size FROM documents""")
def attachments(spark, sf_dir):
    """Attachments of one document a source, by name."""
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("name"), F.col("n_chars").alias("size"))
    return structure.ordered_attachments(d).select("doc_id", "name", "n", "place", "size")


@query("""WITH RECURSIVE e AS (SELECT 'o' || o_orderkey AS src, 'l' || l_partkey AS dst FROM orders JOIN lineitem ON l_orderkey = o_orderkey UNION ALL SELECT 'l' || p_partkey, 'p' || p_brand FROM part),
    r AS (SELECT 'o' || o_orderkey AS id FROM orders WHERE o_orderkey % 97 = 0 UNION SELECT dst FROM r JOIN e ON src = id) SELECT id FROM r""")
def prune_reachable(spark, sf_dir):
    s = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    l, p, o = (table(spark, sf_dir, t) for t in ("lineitem", "part", "orders"))
    e = o.join(l, F.col("l_orderkey") == F.col("o_orderkey")).select(s("o", "o_orderkey").alias("src"), s("l", "l_partkey").alias("dst")).unionByName(p.select(s("l", "p_partkey").alias("src"), s("p", "p_brand").alias("dst")))
    return structure.reachable(e, o.where("o_orderkey % 97 = 0").select(s("o", "o_orderkey").alias("id")))


@query("""SELECT p_size::BIGINT AS doc_id, p_partkey AS obj_num, ((row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) - 1) // 100)::BIGINT AS stream, ((row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) - 1) % 100)::BIGINT AS slot FROM part""")
def object_stream_pack(spark, sf_dir):
    return structure.pack_objects(table(spark, sf_dir, "part").select(F.col("p_size").cast("long").alias("doc_id"), F.col("p_partkey").alias("obj_num")))


@query("""SELECT user_id, event_type AS message, min(event_id) AS first_seen FROM events GROUP BY ALL""")
def warnings_distinct(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("message"))
    return structure.distinct_warnings(e).withColumnRenamed("doc_id", "user_id")


# --- page sets -----------------------------------------------------------------------------------------------------

_TURNS = "WITH t AS (SELECT conv_id AS doc_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pno, role, text FROM conversations), c AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM t)"
_RENUMBER = "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY part, ord) - 1 AS pno, role, text FROM x"


def _turns(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("doc_id"), (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1).cast("long").alias("pno"), "role", "text")


@query(_TURNS + ", x AS (SELECT *, 0 AS part, -pno AS ord FROM c UNION ALL SELECT *, 1, 0 FROM c WHERE pno = 0) " + _RENUMBER)
def select_pages(spark, sf_dir):
    """All pages in reverse, then the first one again."""
    t = _turns(spark, sf_dir)
    wanted = t.select("doc_id", "pno", (-F.col("pno")).alias("ord")).unionByName(t.where("pno = 0").select("doc_id", "pno", F.lit(1).cast("long").alias("ord")))
    return pageset.select(t, wanted)


@query(_TURNS + ", x AS (SELECT *, 0 AS part, pno AS ord FROM c WHERE pno % 3 <> 1) " + _RENUMBER)
def delete_pages(spark, sf_dir):
    t = _turns(spark, sf_dir)
    return pageset.delete(t, t.where("pno % 3 = 1").select("doc_id", "pno"))


@query(_TURNS + ", x AS (SELECT doc_id, pno, role, text, CASE WHEN pno < 1 THEN 0 ELSE 2 END AS part, pno AS ord FROM c UNION ALL SELECT doc_id + 1, pno, role, text, 1, -pno FROM c WHERE n > 1 AND pno BETWEEN 0 AND n - 1 AND doc_id + 1 IN (SELECT doc_id FROM t)) " + _RENUMBER)
def insert_range(spark, sf_dir):
    """The pages of the conversation before, last to first, before page 1."""
    t = _turns(spark, sf_dir)
    many = t.groupBy("doc_id").count().where("count > 1").select("doc_id")
    src = t.join(many, "doc_id", "left_semi").withColumn("doc_id", F.col("doc_id") + 1).join(t.select("doc_id").distinct(), "doc_id", "left_semi")
    return pageset.insert(t, src, first=-1, last=0, start_at=1)


@query(_TURNS + ", x AS (SELECT doc_id, pno, role, text, CASE WHEN pno < 0 THEN 0 ELSE 2 END AS part, pno AS ord FROM c UNION ALL SELECT doc_id, pno, role, text, 1, 0 FROM c WHERE pno = n - 1) " + _RENUMBER)
def copy_page(spark, sf_dir):
    """The last page once more, at the front."""
    return pageset.copy(_turns(spark, sf_dir), -1, to=0)


@query(_TURNS + ", x AS (SELECT doc_id, role, text, 0 AS part, pno AS ord FROM c UNION ALL SELECT DISTINCT doc_id, 'blank', NULL, 1, 0 FROM c) " + _RENUMBER)
def new_page(spark, sf_dir):
    return pageset.new_page(_turns(spark, sf_dir), role="blank")


@query(_TURNS + " SELECT doc_id, pno, role, text FROM c WHERE pno = n - 2")
def page_index(spark, sf_dir):
    """The page before the last of every document that has one."""
    return pageset.page_at(_turns(spark, sf_dir), -2)


# --- text functions ------------------------------------------------------------------------------------------------


@query(r"""SELECT p_partkey, replace(replace(replace(p_name || '|' || chr(10) || p_brand || '\', '\', '\\'), '|', '\|'), chr(10), '<br>') AS cell FROM part""")
def cell_escape(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.escape_cell(F.concat("p_name", F.lit("|\n"), "p_brand", F.lit("\\"))).alias("cell"))


@query("""SELECT p_partkey, repeat(chr((65 + (p_size - 1) % 26)::INT), ((p_size - 1) // 26 + 1)::INT) AS letters FROM part""")
def label_letters(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.letters(F.col("p_size")).alias("letters"))


@query("""WITH RECURSIVE u(v, s) AS (VALUES (1000, 'M'), (900, 'CM'), (500, 'D'), (400, 'CD'), (100, 'C'), (90, 'XC'), (50, 'L'), (40, 'XL'), (10, 'X'), (9, 'IX'), (5, 'V'), (4, 'IV'), (1, 'I')),
    r AS (SELECT p_partkey, (p_partkey % 3999 + 1)::INT AS n, '' AS roman FROM part UNION ALL SELECT p_partkey, n - (SELECT max(v) FROM u WHERE v <= n), roman || (SELECT arg_max(s, v) FROM u WHERE v <= n) FROM r WHERE n > 0)
    SELECT p_partkey, roman FROM r WHERE n = 0""")
def label_roman(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.roman(F.col("p_partkey") % 3999 + 1).alias("roman"))


@query("""SELECT p_partkey, CASE WHEN lower(p_name) LIKE '%italic%' THEN 2 ELSE 0 END | CASE WHEN regexp_matches(lower(p_name), 'times|serif') THEN 4 ELSE 0 END | CASE WHEN regexp_matches(lower(p_name), 'courier|mono') THEN 8 ELSE 0 END | CASE WHEN regexp_matches(lower(p_name), 'bold|black') THEN 16 ELSE 0 END AS flags,
    CASE WHEN regexp_matches(lower(p_name), 'gothic|mincho|meiryo|hiragino|noto sans cjk|simsun|simhei|msyh|mingliu|batang|malgun|gulim|noto|sans|cjk') THEN 'cjk-sans' WHEN regexp_matches(lower(p_name), 'serif|song|ming') THEN 'serif' ELSE 'sans' END AS slot FROM part""")
def font_flags(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.font_flags(F.col("p_name")).alias("flags"), T.fallback_slot(F.col("p_name")).alias("slot"))


@query("""SELECT s_suppkey, coalesce(CASE WHEN s_suppkey % 2 = 0 THEN s_name END, CASE WHEN s_suppkey % 3 = 0 THEN 'f' END, 'plain') AS name FROM supplier""")
def filespec_name(spark, sf_dir):
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select("s_suppkey", T.filespec_name(F.when(k % 2 == 0, F.col("s_name")), F.when(k % 3 == 0, F.lit("f")), F.lit("plain")).alias("name"))


# --- files ---------------------------------------------------------------------------------------------------------


@query("""SELECT doc_id, '1.7' AS version, 1::INT AS page_count, FALSE AS encrypted, FALSE AS needs_pass, 'document ' || doc_id AS title FROM documents""")
def pdf_peek(spark, sf_dir):
    return readers.peek(typesetter.files(docs(spark, sf_dir))).select("doc_id", "version", "page_count", "encrypted", "needs_pass", F.col("metadata")["title"].alias("title"))


@query("""SELECT doc_id, 1::INT AS pages, length(replace(text, chr(10), '')) AS glyphs FROM documents""")
def pdf_open(spark, sf_dir):
    p = readers.parse(typesetter.files(docs(spark, sf_dir)))
    return p.per_page(lambda row: [(row["page_count"], len(row["glyphs"]["text"]))], "pages int, glyphs long", ["pages", "glyphs"]).drop("pno")


def _inspected(files: FileSource, make, columns: str) -> DataFrame:
    """make(outline) gives one tuple for a file."""
    from vellumtide.sources.inspect import Outline
    from vellumtide.sources.pdfobjects import Pdf

    def one(data):
        yield make(Outline(Pdf(data)))

    return files.rows_of(one, columns)


@query("""SELECT doc_id, 2::INT AS pages, length(replace(text, chr(10), '')) + 5 * (2 - page) AS glyphs, (page - 1)::INT AS pno FROM documents, (VALUES (1), (2)) v(page)""")
def insert_text(spark, sf_dir):
    """A stamp on every document's page, which then comes twice, the copy without it; saved and parsed again."""
    from vellumtide.operators import editing

    def change(d):
        editing.copy_page(d, 0)
        editing.insert_text(d, 0, (72, 100), "stamp")

    p = readers.parse(editing.edit(typesetter.files(docs(spark, sf_dir)), change, object_streams=True))
    return p.per_page(lambda row: [(row["page_count"], len(row["glyphs"]["text"]))], "pages int, glyphs long", ["pages", "glyphs"])


def _edited(spark, sf_dir, change, make, columns: str) -> DataFrame:
    """change(draft) on every document's file, saved and parsed; make(page row) gives one tuple a page."""
    from vellumtide.operators import editing

    p = readers.parse(editing.edit(typesetter.files(docs(spark, sf_dir)), change))
    return p.per_page(lambda row: [make(row)], columns, [c.split()[0] for c in columns.split(", ")])


@query("""SELECT doc_id, 0::INT AS pno, md5(replace(replace(coalesce(text, ''), 'the', 'THE'), chr(10), '')) AS digest FROM documents""")
def replace_text(spark, sf_dir):
    from vellumtide.operators import editing

    def change(d):
        editing.replace_text(d, 0, "the", "THE")

    def digest(row):
        import hashlib

        return (hashlib.md5("".join(row["glyphs"]["text"]).encode()).hexdigest(),)

    return _edited(spark, sf_dir, change, digest, "digest string")


@query("""SELECT doc_id, 0::INT AS pno, 2::INT AS width, 3::INT AS height, 'png' AS ext, 100::DOUBLE AS x0, 20::DOUBLE AS y0, 120::DOUBLE AS x1, 50::DOUBLE AS y1, '00ff00' AS pixel FROM documents""")
def insert_image(spark, sf_dir):
    """A picture drawn on every page, and taken out again."""
    from vellumtide.operators import editing
    from vellumtide.sources.pdfpage import png, unpng

    picture = png(2, 3, bytes([0, 255, 0] * 6), 3)

    def change(d):
        editing.insert_image(d, 0, (100, 20, 120, 50), picture)

    def image(row):
        (got,) = row["images"]
        return got["width"], got["height"], got["ext"], *(got["bbox"][k] for k in ("x0", "y0", "x1", "y1")), unpng(got["image"])[2][:3].hex()

    return _edited(spark, sf_dir, change, image, "width int, height int, ext string, x0 double, y0 double, x1 double, y1 double, pixel string")


@query("""SELECT doc_id, 0::INT AS pno, length(replace(coalesce(text, ''), chr(10), '')) + 5 AS glyphs, 'inner' AS tail FROM documents""")
def show_page(spark, sf_dir):
    """A page of another document set into every page."""
    from vellumtide.operators import editing
    from vellumtide.sources.pdfwriter import Draft, text_document

    inner = Draft(text_document([[(40, 20, 20, "inner")]]))

    def change(d):
        editing.show_page(d, 0, (300, 5, 400, 30), inner)

    return _edited(spark, sf_dir, change, lambda row: (len(row["glyphs"]["text"]), "".join(row["glyphs"]["text"][-5:])), "glyphs long, tail string")


@query("""SELECT doc_id, 0::INT AS pno, length(replace(coalesce(text, ''), chr(10), '')) + 6 AS glyphs, 'scan日本' AS tail, 10::DOUBLE AS x, 10::DOUBLE AS size FROM documents""")
def ocr_layer(spark, sf_dir):
    """Two invisible words on every page."""
    from vellumtide.operators import editing

    def change(d):
        editing.add_ocr_layer(d, 0, [(10, 10, 50, 20, "scan"), (60, 10, 80, 20, "日本")])

    return _edited(spark, sf_dir, change, lambda row: (len(row["glyphs"]["text"]), "".join(row["glyphs"]["text"][-6:]), row["glyphs"]["x"][-6], row["glyphs"]["size"][-6]), "glyphs long, tail string, x double, size double")


@query("""SELECT doc_id, 0::INT AS pno, 200::DOUBLE AS width, 300::DOUBLE AS height, 90::INT AS rotation FROM documents""")
def rotate_and_crop(spark, sf_dir):
    from vellumtide.operators import editing

    def change(d):
        editing.set_rotation(d, 0, 450)
        editing.set_box(d, 0, (0, 0, 300, 200), "CropBox")

    return _edited(spark, sf_dir, change, lambda row: (row["width"], row["height"], row["rotation"]), "width double, height double, rotation int")


@query("""SELECT doc_id, '1:one:1' AS toc, 'R:x-:7' AS label, 'http://h/' AS uri, 'Link,Highlight' AS kinds, 'a.txt=data' AS attached, 'New' AS title FROM documents""")
def structure_roundtrip(spark, sf_dir):
    """Outline, labels, link, highlight, attachment and title written into every document and read back."""
    from vellumtide.operators import editing
    from vellumtide.sources.pdfpage import info

    def change(d):
        editing.set_toc(d, [[1, "one", 1]])
        editing.set_labels(d, [{"startpage": 0, "style": "R", "prefix": "x-", "firstpagenum": 7}])
        editing.add_link(d, 0, (10, 10, 50, 30), "http://h/")
        editing.add_highlight(d, 0, [(10, 10, 50, 30)])
        editing.set_attachments(d, [{"name": "a.txt", "data": b"data"}])
        editing.set_metadata(d, {"title": "New"})

    def make(o):
        a, (t,), (r,), (f,) = o.annotations(), o.toc(), o.labels(), o.attachments()
        return ":".join(map(str, t)), f"{r['style']}:{r['prefix']}:{r['firstpagenum']}", a[0]["uri"], ",".join(x["type"] for x in a), f"{f['name']}={f['data'].decode()}", info(o.pdf)["title"]

    files = editing.edit(typesetter.files(docs(spark, sf_dir)), change)
    return _inspected(files, make, "toc string, label string, uri string, kinds string, attached string, title string")


@query("""SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'PdfFault: no PDF header' END AS error FROM documents""")
def error_column(spark, sf_dir):
    """Every tenth file is damaged: faults are rows, not failures."""
    f = typesetter.files(docs(spark, sf_dir)).rows()
    f = f.withColumn("content", F.when(F.col("doc_id") % 10 == 0, F.lit(b"junk")).otherwise(F.col("content")))
    return readers.peek(f).select("doc_id", "error")


@query("""SELECT doc_id, strlen(text) > 2000 AS stopped FROM documents""")
def bomb_guard(spark, sf_dir):
    """Texts as compressed streams, decoded under a limit of 2000 bytes."""
    from vellumtide.errors import PdfFault
    from vellumtide.sources.pdfobjects import inflate

    @F.pandas_udf("boolean")
    def stopped(text: pd.Series) -> pd.Series:
        import zlib

        def one(t):
            try:
                inflate(zlib.compress((t or "").encode()), 2000)
                return False
            except PdfFault:
                return True

        return pd.Series([one(t) for t in text])

    return docs(spark, sf_dir).select("doc_id", stopped("text").alias("stopped"))


@query("""SELECT doc_id // 10 AS doc_id, count(*)::INT AS pages, sum(length(replace(coalesce(text, ''), chr(10), '')))::BIGINT AS glyphs FROM documents GROUP BY ALL""")
def merge_files(spark, sf_dir):
    """The files of ten documents at a time merged into one, saved compactly and parsed again."""
    from vellumtide.operators import editing

    group = (F.col("doc_id") - F.pmod("doc_id", F.lit(10))) / 10
    merged = editing.merge_files(typesetter.files(docs(spark, sf_dir)).rows().withColumn("into", group.cast("long")), "into", deflate=True, object_streams=True)
    p = readers.parse(merged)
    return p.per_page(lambda row: [(row["page_count"], len(row["glyphs"]["text"]))], "pages int, glyphs long", ["pages", "glyphs"]).groupBy("doc_id").agg(F.max("pages").alias("pages"), F.sum("glyphs").alias("glyphs"))


@query("""SELECT doc_id, 0::INT AS pno, 153::INT AS width, floor((12 * (1 + length(text) - length(replace(text, chr(10), ''))) + 24) * 0.25::DOUBLE)::INT AS height, '89504e47' AS magic FROM documents""")
def render_png(spark, sf_dir):
    """Every document's page at a quarter of its size."""
    from vellumtide.sources import raster

    r = raster.render(typesetter.files(docs(spark, sf_dir)), scale=0.25)
    return r.select("doc_id", "pno", "width", "height", F.lower(F.hex(F.substring("png", 1, 4))).alias("magic"))


def _grid(spark, sf_dir) -> PageSource:
    """Nations in five rows of five ruled cells."""
    n = table(spark, sf_dir, "nation").groupBy(F.lit(0).cast("long").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("cells"))

    def expand(record):
        cols = [[] for _ in range(11)]
        for c in record["cells"]:
            x, y = 50.0 + 120 * (c["n_nationkey"] % 5), 60.0 + 30 * (c["n_nationkey"] // 5)
            for i, ch in enumerate(c["n_name"]):
                for col, v in zip(cols, (ch, x + 5 * i, y, 10.0, 5.0, 1.0, 0.0, 0, "F1", "Helvetica", 0)):
                    col.append(v)
        rules = [dict(zip(("x0", "y0", "x1", "y1", "horizontal"), r)) for r in [*((40.0 + 120 * k, 40.0, 40.0 + 120 * k, 190.0, False) for k in range(6)), *((40.0, 40.0 + 30 * k, 640.0, 40.0 + 30 * k, True) for k in range(6))]]
        yield {"doc_id": record["doc_id"], "pno": 0, "glyphs": dict(zip(("text", "x", "y", "size", "advance", "dir_x", "dir_y", "wmode", "font_key", "font", "flags"), cols)), "rules": rules}

    return PageSource(n, expand)


@query("""SELECT 0::BIGINT AS doc_id, 0::INT AS pno, 0::BIGINT AS table_no, (n_nationkey // 5)::INT AS row, (n_nationkey % 5)::INT AS col, (40 + 120 * (n_nationkey % 5))::DOUBLE AS x0, (40 + 30 * (n_nationkey // 5))::DOUBLE AS y0,
    (160 + 120 * (n_nationkey % 5))::DOUBLE AS x1, (70 + 30 * (n_nationkey // 5))::DOUBLE AS y1, n_name AS text FROM nation""")
def grid_cells(spark, sf_dir):
    return tables.cells(_grid(spark, sf_dir))


@query("""WITH r AS (SELECT n_nationkey // 5 AS r, '| ' || string_agg(n_name, ' | ' ORDER BY n_nationkey) || ' |' AS line FROM nation GROUP BY ALL)
    SELECT 0::BIGINT AS doc_id, 0::INT AS pno, 0::BIGINT AS table_no, string_agg(line || CASE WHEN r = 0 THEN chr(10) || '| --- | --- | --- | --- | --- |' ELSE '' END, chr(10) ORDER BY r) AS markdown FROM r""")
def table_markdown(spark, sf_dir):
    return tables.markdown_tables(_grid(spark, sf_dir))


@query("""SELECT p_partkey, CASE WHEN rtrim(rtrim(printf('%.4f', p_retailprice / 8), '0'), '.') IN ('-0', '') THEN '0' ELSE rtrim(rtrim(printf('%.4f', p_retailprice / 8), '0'), '.') END AS n FROM part""")
def pdf_number(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.pdf_number(F.col("p_retailprice") / 8).alias("n"))
