"""PDF sources: files or a binary column to one row a page, with all that interpretation yields in columns.

A page is the unit of everything downstream, so its glyphs, rules and images stay together in one row, and layout needs no shuffle. A document that can't be
read gives one row with its `error`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumtide.errors import PasswordRefused, PdfFault
from vellumtide.schema import PEEK_ROW
from vellumtide.sources.filesource import FileSource
from vellumtide.sources.pagesource import PageSource
from vellumtide.sources.pdfobjects import Pdf
from vellumtide.sources.pdfpage import Page, info


def page_rows(doc_id, data: bytes, password: str | None = None, limit: int | None = None) -> list[dict]:
    blank = {"doc_id": doc_id, "pno": None, "page_count": 0, "width": None, "height": None, "rotation": None, "glyphs": None, "rules": None, "images": None, "error": None}
    try:
        pdf = Pdf(data, password, limit)
        if pdf.is_encrypted:
            raise PasswordRefused("a password is needed")
        pages = pdf.pages()
    except (PdfFault, ValueError, TypeError, KeyError, IndexError, AttributeError, RecursionError) as e:
        return [blank | {"error": f"{type(e).__name__}: {e}"}]
    out = []
    for i, p in enumerate(pages):
        row = blank | {"pno": i, "page_count": len(pages)}
        try:
            got = Page(pdf, p)
            row |= {
                "width": got.frame.width, "height": got.frame.height, "rotation": got.frame.rotation,
                "glyphs": got.columns(),
                "rules": [dict(zip(("x0", "y0", "x1", "y1", "horizontal"), r)) for r in got.rules],
                "images": [{"width": w, "height": h, "bbox": dict(zip(("x0", "y0", "x1", "y1"), b)), "ext": e, "image": d} for w, h, b, e, d in got.images],
                "error": "; ".join(dict.fromkeys(got.warnings)) or None,
            }
        except (PdfFault, ValueError, TypeError, KeyError, IndexError, AttributeError, RecursionError, ZeroDivisionError) as e:
            row["error"] = f"{type(e).__name__}: {e}"
        out.append(row)
    return out or [blank]


def parse(content: FileSource | DataFrame, password: str | None = None, limit: int | None = None) -> PageSource:
    """content: doc_id, content (binary). The pages of all documents."""
    source = FileSource.of(content)
    make = source.make

    def expand(record):
        yield from page_rows(record["doc_id"], make(record)[0] or b"", password, limit)

    return PageSource(source.df, expand)


def pdf_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (the file's path) and content of all PDF files under path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.pdf").load(path)
    return files.select(F.col("path").alias("doc_id"), "content")


def read_pdf(spark: SparkSession, path: str, password: str | None = None, limit: int | None = None) -> PageSource:
    """The pages of all PDF files under path."""
    return parse(pdf_files(spark, path), password, limit)


def peek(content: FileSource | DataFrame, password: str | None = None) -> DataFrame:
    """Metadata, page count, version and state of encryption, with no page interpreted."""

    def one(data):
        try:
            pdf = Pdf(data or b"", password)
            n = None if pdf.is_encrypted else len(pdf.pages())
            yield pdf.version, n, pdf.is_encrypted, pdf.needs_pass, {} if pdf.is_encrypted else info(pdf), None
        except (PdfFault, ValueError, TypeError, KeyError, IndexError, AttributeError) as e:
            yield None, None, None, None, None, f"{type(e).__name__}: {e}"

    return FileSource.of(content).rows_of(one, PEEK_ROW)
