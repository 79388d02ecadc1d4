"""A deterministic typesetter: text rows to page rows, and to PDF files. One page a document, one line a line of text; every character is half its size wide."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from vellumtide.sources.filesource import FileSource
from vellumtide.sources.glyphs import Glyphs, codes_of
from vellumtide.sources.pagesource import PageSource, spread
from vellumtide.sources.pdfwriter import text_document

LEFT, LEADING = 40.0, 12.0


def line_size(n: int) -> float:
    return 20.0 if n == 0 else 14.0 if n % 7 == 3 else 10.0


def baseline(n: int) -> float:
    return LEADING * n + LEADING


def set_page(text: str | None, wide_every: int = 0, two_columns: bool = False) -> tuple[Glyphs, float]:
    """Glyphs of a text, and the page's height. wide_every: each such word of a line begins after a wide gap. two_columns: the second half of the lines stands beside the first."""
    rows = (text or "").split("\n")
    half, no = (len(rows) + 1) // 2, np.arange(len(rows))
    ns = np.array([len(r) for r in rows])
    right = no >= half if two_columns else np.zeros(len(rows), bool)
    size = np.full(len(rows), 10.0) if two_columns else np.where(no == 0, 20.0, np.where(no % 7 == 3, 14.0, 10.0))
    y = LEADING * np.where(right, no - half, no) + LEADING
    line, first = np.repeat(no, ns), ns.cumsum() - ns
    # Sizes and steps are whole numbers, so sums are exact in any order.
    size, chars = size[line], "".join(rows)
    x = np.where(right, 400.0, LEFT)[line] + (np.arange(len(line)) - first[line]) * (size / 2)
    if wide_every:
        blanks = np.append(0, (codes_of(chars) == 32).cumsum())
        x += 4 * size * ((blanks[1:] - blanks[first][line]) // wide_every)
    return Glyphs(chars, x, y[line], size, size / 2, [(len(line), (1.0, 0.0, 0, "F1", "Helvetica", 0))] if chars else []), baseline(len(rows)) + LEADING


def pages(docs: DataFrame, wide_every: int = 0, two_columns: bool = False) -> PageSource:
    """docs: doc_id, text."""

    def expand(record):
        glyphs, height = set_page(record["text"], wide_every, two_columns)
        yield {"doc_id": record["doc_id"], "pno": 0, "page_count": 1, "width": 612.0, "height": height, "rotation": 0, "glyphs": glyphs, "rules": [], "images": [], "error": None}

    return PageSource(spread(docs.select("doc_id", "text")), expand)


def files(docs: DataFrame) -> FileSource:
    """A PDF file of each text."""

    def make(record):
        rows = (record["text"] or "").split("\n")
        page = [(LEFT, baseline(n), line_size(n), r) for n, r in enumerate(rows) if r]
        return text_document([page], heights=[baseline(len(rows)) + LEADING], title=f"document {record['doc_id']}"), None

    return FileSource(spread(docs.select("doc_id", "text")), make)
