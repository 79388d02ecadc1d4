"""Pages that are made where they are used: input rows and a function from one of them to its pages.

Operators on pages run that function and their own work in one Python pass, so glyphs never cross to the JVM and back. `rows` makes a DataFrame of
them where they are to be kept."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from vellumtide.schema import PAGE_ROW
from vellumtide.sources.glyphs import Glyphs

#: Input rows turned to Python objects at once; characters and rows after which results leave.
ROWS, CHARACTERS, RESULTS = 64, 1 << 20, 1 << 18


def spread(df: DataFrame) -> DataFrame:
    """df over all cores in several rounds, whatever its files' row groups hold: interpretation is heavy for a row's size."""
    n = max(4 * df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions())
    return df.repartition(n, F.xxhash64(*df.columns))


def records(it) -> Iterator[dict]:
    """Rows of Arrow batches, a few at a time."""
    for batch in it:
        for a in range(0, batch.num_rows, ROWS):
            yield from batch.slice(a, ROWS).to_pylist()


def _joined(parts: list, kind: pa.DataType) -> pa.Array:
    if all(isinstance(p, pa.Array) for p in parts):
        return pa.concat_arrays(parts).cast(kind)
    if all(isinstance(p, np.ndarray) for p in parts):
        return pa.array(np.concatenate(parts), kind, from_pandas=True)
    return pa.array(list(chain.from_iterable(p.to_pylist() if isinstance(p, pa.Array) else p.tolist() if isinstance(p, np.ndarray) else p for p in parts)), kind, from_pandas=True)


def batches(it: Iterator[tuple[tuple, list | None, int]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """it: values of the first columns, the others' columns (None: no rows) and a weight."""
    keys, counts, parts, weight, rows = [], [], [], 0, 0
    for key, columns, w in it:
        weight += w
        if columns is not None and (n := len(columns[0])):
            keys.append(key)
            counts.append(n)
            parts.append(columns)
            rows += n
        if weight > CHARACTERS or rows > RESULTS:
            if keys:
                yield _batch(keys, counts, parts, schema)
            keys, counts, parts, weight, rows = [], [], [], 0, 0
    if keys:
        yield _batch(keys, counts, parts, schema)


def _batch(keys: list[tuple], counts: list[int], parts: list, schema: pa.Schema) -> pa.RecordBatch:
    which = pa.array(np.repeat(np.arange(len(keys)), counts))
    arrays = [pa.array(v, f.type).take(which) for v, f in zip(zip(*keys), schema)]
    arrays += [_joined(v, f.type) for v, f in zip(zip(*parts), list(schema)[len(arrays) :])]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def arrow_schema(columns: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(columns))


def _same(record: dict) -> Iterator[dict]:
    yield record


class PageSource:
    def __init__(self, df: DataFrame, expand: Callable[[dict], Iterator[dict]]):
        self.df, self.expand = df, expand

    @classmethod
    def of(cls, pages: "PageSource | DataFrame") -> "PageSource":
        return pages if isinstance(pages, PageSource) else cls(pages, _same)

    def join(self, other: DataFrame, on: str, how: str = "left") -> "PageSource":
        """Further columns for every page of an input row."""
        return PageSource(self.df.join(other, on, how), self.expand)

    def doc_ids(self) -> DataFrame:
        return self.df.select("doc_id").distinct()

    def _columns(self, columns: str) -> str:
        return f"doc_id {self.df.schema['doc_id'].dataType.simpleString()}, {columns}"

    def per_page_columns(self, make: Callable[[dict], list | None], columns: str) -> DataFrame:
        """make(row) gives the values of `columns` for one page (its columns and those of its input row), a list or array of each, or None."""
        expand, kinds = self.expand, self._columns(f"pno int, {columns}")
        schema = arrow_schema(kinds)

        def made(it):
            for record in records(it):
                for row in expand(record):
                    yield (row["doc_id"], row["pno"]), make(record | row), 256 + len((row["glyphs"] or {"text": ""})["text"])

        return self.df.mapInArrow(lambda it: batches(made(it), schema), kinds)

    def per_page(self, make: Callable[[dict], Iterator[tuple]], columns: str, names: list[str]) -> DataFrame:
        """make(row) yields tuples of `names` for one page (its columns and those of its input row)."""
        return self.per_page_columns(lambda row: list(zip(*make(row))) or None, columns)

    @property
    def whole(self) -> bool:
        """Whether an input row holds all pages of its document."""
        return self.expand is not _same

    def per_document(self, make: Callable[[list[dict]], Iterator[tuple]], columns: str, names: list[str]) -> DataFrame:
        """make(pages) yields tuples of `names` for all pages of an input row, for sources of whole documents."""
        expand, kinds = self.expand, self._columns(columns)
        schema = arrow_schema(kinds)

        def made(it):
            for record in records(it):
                pages = list(expand(record))
                yield (record["doc_id"],), list(zip(*make(pages))) or None, 256 + sum(len((p["glyphs"] or {"text": ""})["text"]) for p in pages)

        return self.df.mapInArrow(lambda it: batches(made(it), schema), kinds)

    def rows(self) -> DataFrame:
        expand, kinds = self.expand, self._columns(PAGE_ROW)
        schema = arrow_schema(kinds)

        def run(it):
            for record in records(it):
                rows = [{f.name: (v.lists() if isinstance(v := row.get(f.name), Glyphs) else v) for f in schema} for row in expand(record)]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

        return self.df.mapInArrow(run, kinds)
