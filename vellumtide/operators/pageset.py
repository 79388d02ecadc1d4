"""Page-set algebra: a document is its pages, numbered pno from 0 within doc_id. Every operator returns renumbered pages; nothing is mutated, so views don't go stale.

Column `pages` frames have doc_id, pno and any further columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def renumber(pages: DataFrame, *order: Column) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy(*order)
    cols = [c for c in pages.columns if not c.startswith("_")]
    return pages.withColumn("pno", F.row_number().over(w).cast("long") - 1).select(*cols)


def resolve(pno: Column, count: Column) -> Column:
    """A page number with negatives counted from the end; null outside the document."""
    n = F.when(pno < 0, pno + count).otherwise(pno)
    return F.when((n >= 0) & (n < count), n)


def page_at(pages: DataFrame, pno: int) -> DataFrame:
    """The page of that number (negative: from the end) of every document that has it."""
    count = F.max("pno").over(Window.partitionBy("doc_id")) + 1
    return pages.withColumn("_n", count).where(F.col("pno") == resolve(F.lit(pno), F.col("_n"))).drop("_n")


def select(pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted: doc_id, ord, pno. Pages in the order of ord; a page that is asked for twice comes twice and shares its content."""
    return renumber(pages.join(wanted.select("doc_id", "pno", F.col("ord").alias("_ord")), ["doc_id", "pno"]), F.col("_ord"))


def delete(pages: DataFrame, gone: DataFrame) -> DataFrame:
    """gone: doc_id, pno."""
    return renumber(pages.join(gone.select("doc_id", "pno").distinct(), ["doc_id", "pno"], "left_anti"), F.col("pno"))


def insert(target: DataFrame, source: DataFrame, first: int = 0, last: int = -1, start_at: int = -1) -> DataFrame:
    """Pages first to last of source (inclusive, negatives from the end, reversed where first > last) into target before page start_at (-1: at the end).
    source pages carry the doc_id they go to."""
    n = F.max("pno").over(Window.partitionBy("doc_id")) + 1
    a, b = resolve(F.lit(first), F.col("_n")), resolve(F.lit(last), F.col("_n"))
    some = source.withColumn("_n", n).where(F.col("pno").between(F.least(a, b), F.greatest(a, b)))
    some = some.withColumn("_ord", F.when(a <= b, F.col("pno")).otherwise(-F.col("pno")).cast("long")).withColumn("_part", F.lit(1)).drop("_n")
    here = target.withColumn("_ord", F.col("pno").cast("long"))
    here = here.withColumn("_part", F.when((F.lit(start_at) < 0) | (F.col("pno") < start_at), 0).otherwise(2))
    return renumber(here.unionByName(some), F.col("_part"), F.col("_ord"))


def merge(target: DataFrame, source: DataFrame) -> DataFrame:
    return insert(target, source)


def copy(pages: DataFrame, pno: int, to: int = -1) -> DataFrame:
    """Page pno once more, before page `to` (-1: at the end)."""
    one = page_at(pages, pno).withColumn("_ord", F.lit(0).cast("long")).withColumn("_part", F.lit(1))
    here = pages.withColumn("_ord", F.col("pno").cast("long")).withColumn("_part", F.when((F.lit(to) < 0) | (F.col("pno") < to), 0).otherwise(2))
    return renumber(here.unionByName(one), F.col("_part"), F.col("_ord"))


def new_page(pages: DataFrame, at: int = -1, **values) -> DataFrame:
    """A page of the given column values (others null) in every document, before page `at` (-1: at the end)."""
    blank = pages.select("doc_id").distinct()
    for f in pages.schema.fields:
        if f.name != "doc_id":
            blank = blank.withColumn(f.name, F.lit(values.get(f.name)).cast(f.dataType))
    one = blank.withColumn("_ord", F.lit(0).cast("long")).withColumn("_part", F.lit(1))
    here = pages.withColumn("_ord", F.col("pno").cast("long")).withColumn("_part", F.when((F.lit(at) < 0) | (F.col("pno") < at), 0).otherwise(2))
    return renumber(here.unionByName(one), F.col("_part"), F.col("_ord"))
