"""A handle on a set of PDF documents for drivers: opened from files or bytes, guarded, closed. What it gives are DataFrames; nothing is read before they are used."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumtide.errors import HandleClosed, StillEncrypted
from vellumtide.operators import layout, markdown
from vellumtide.sources import raster, readers
from vellumtide.sources.pagesource import PageSource


class Documents:
    """doc_id and content of documents. Every operator is refused after `close`, and while a document's password is missing."""

    def __init__(self, content: DataFrame, password: str | None = None, limit: int | None = None):
        self._content, self._password, self._limit = content.select("doc_id", "content"), password, limit
        self._closed, self._open = False, False

    def _guard(self, content: bool = True) -> DataFrame:
        if self._closed:
            raise HandleClosed("the documents are closed")
        if content and not self._open:
            if not readers.peek(self._content, self._password).where("encrypted").isEmpty():
                raise StillEncrypted("a document needs a password")
            self._open = True
        return self._content

    @property
    def is_closed(self) -> bool:
        return self._closed

    def peek(self) -> DataFrame:
        """Metadata, page count, version, needs_pass and encrypted; of locked documents too."""
        return readers.peek(self._guard(False), self._password)

    def authenticate(self, password: str) -> "Documents":
        """The documents with that password."""
        return Documents(self._guard(False), password, self._limit)

    def pages(self) -> PageSource:
        return readers.parse(self._guard(), self._password, self._limit)

    def page(self, pno: int) -> DataFrame:
        """Page pno (negative: from the end) of every document that has it; IndexError where none does."""
        n = F.col("page_count")
        rows = self.pages().rows().where(F.col("pno") == (n + pno if pno < 0 else F.lit(pno)))
        if rows.isEmpty():
            raise IndexError(f"no page {pno}")
        return rows

    def text(self) -> DataFrame:
        return layout.page_text(self.pages())

    def markdown(self, pages: list[int] | None = None) -> DataFrame:
        return markdown.documents(self.pages(), pages)

    def render(self, **how) -> DataFrame:
        return raster.render(self._guard(), **how)

    def __len__(self) -> int:
        """Pages of all documents."""
        return int(self.peek().agg(F.sum("page_count")).first()[0] or 0)

    def __getitem__(self, pno: int) -> DataFrame:
        return self.page(pno)

    def close(self) -> None:
        self._closed = True

    def __enter__(self) -> "Documents":
        self._guard(False)
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def __repr__(self) -> str:
        return "Documents(closed)" if self._closed else f"Documents({', '.join(self._content.columns)})"


def open(spark: SparkSession, path: str | None = None, content: DataFrame | None = None, password: str | None = None, limit: int | None = None) -> Documents:  # noqa: A001
    """Documents of all PDF files under path, or of a DataFrame of doc_id and content: exactly one of them."""
    if (path is None) == (content is None):
        raise ValueError("either a path or content")
    return Documents(readers.pdf_files(spark, path) if content is None else content, password, limit)


def empty(spark: SparkSession) -> Documents:
    """One document of no pages."""
    from vellumtide.sources.pdfwriter import Draft

    return Documents(spark.createDataFrame([("empty", bytearray(Draft(None).save()))], "doc_id string, content binary"))
