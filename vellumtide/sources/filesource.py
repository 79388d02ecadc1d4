"""Files that are made where they are used, like the pages of `PageSource`: input rows and a function from one of them to a file's bytes. Writing, editing, parsing and drawing are then one
Python pass, which holds one file at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from vellumtide.sources.pagesource import arrow_schema, batches, records


class FileSource:
    """make(row) gives a file's bytes, or None, and what is wrong with it, or None."""

    def __init__(self, df: DataFrame, make: Callable[[dict], tuple[bytes | None, str | None]]):
        self.df, self.make = df, make

    @classmethod
    def of(cls, content: "FileSource | DataFrame") -> "FileSource":
        return content if isinstance(content, FileSource) else cls(content.select("doc_id", "content"), lambda record: (record["content"], None))

    @property
    def kind(self) -> str:
        return self.df.schema["doc_id"].dataType.simpleString()

    def rows_of(self, make: Callable[[bytes | None], list[tuple]], columns: str) -> DataFrame:
        """doc_id and the tuples of `columns` that make(bytes) yields for every file."""
        file, kinds = self.make, f"doc_id {self.kind}, {columns}"
        schema = arrow_schema(kinds)

        def made(it):
            for record in records(it):
                rows = list(make(file(record)[0]))
                yield (record["doc_id"],), list(zip(*rows)) or None, 4096 + sum(len(v) for r in rows for v in r if isinstance(v, (bytes, str)))

        return self.df.mapInArrow(lambda it: batches(made(it), schema), kinds)

    def rows(self, error: bool = False) -> DataFrame:
        """doc_id and content (and error) as a DataFrame."""
        file, kinds = self.make, f"doc_id {self.kind}, content binary" + ", error string" * error
        schema = arrow_schema(kinds)

        def made(it):
            for record in records(it):
                data, fault = file(record)
                yield (record["doc_id"],), [[data], [fault]][: 1 + error], 4096 + len(data or b"")

        return self.df.mapInArrow(lambda it: batches(made(it), schema), kinds)
