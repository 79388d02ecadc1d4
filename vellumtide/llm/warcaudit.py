"""WARC archives and a Merkle fixity audit of their replicas.

Pages become WARC/1.0 records; an archive is files of FILE_RECORDS records in the order of ids, and a record has an offset in its file. A record's leaf hash is the SHA-256 of its
bytes. Above the leaves stand ordered offset ranges: the node of a range of RANGE_BYTES hashes offset, length and leaf hash of the records that begin in it, a file's node
hashes its ranges in order, nodes of FAN files at a time stand above the files, and so on to one root. An audit compares the roots of two replicas, then joins only
the children of nodes that differ, level by level, down to records. A lost or shortened record moves what follows it in its file, so the rest of that file's ranges
differ too and are descended into; there records are compared by id, and only those whose bytes differ are reported.

Records are numbered by one range-sorted pass over narrow digests (id, length, hash); all windows run within a file.

Defined cases: a null url or html counts as empty, line breaks in a url are percent-encoded; a null page_id as the lowest; records that share an id are told apart by their
order in the file; a record that one replica lacks differs from any record; two empty replicas agree; extra columns are ignored.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellumtide.llm._kit import materialize, table

FILE_RECORDS = 4096
RANGE_BYTES = 1 << 16
FAN = 64
_LOWEST = -(1 << 63)
_END = "\r\n\r\n"


def records(pages: DataFrame) -> DataFrame:
    """page_id and the text of a WARC/1.0 response record of every page."""
    html = F.coalesce("html", F.lit(""))
    url = F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(F.col("page_id").cast("string"), F.lit("null")),
        F.lit(">\r\nWARC-Target-URI: "),
        url,
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(html).cast("string"),
        F.lit(_END),
    )
    return pages.select("page_id", F.concat(head, html, F.lit(_END)).alias("record"))


def _div(x: Column, by: int) -> Column:
    """Integer division; x isn't negative."""
    return F.call_function("div", x, F.lit(by).cast("long"))


def lay_out(rows: DataFrame, file_records: int = FILE_RECORDS) -> DataFrame:
    """rows with file and place (order in the archive), by page_id and then by the hashes of `sha`; all other columns are carried along."""
    key = F.coalesce("page_id", F.lit(_LOWEST))
    placed = materialize(rows.orderBy(key, "sha").withColumn("_n", F.monotonically_increasing_id()), "placed")
    part, within = F.shiftright("_n", 33), F.col("_n").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted((r["p"], r["n"]) for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())  # one row a partition of the sort
    before, at = [], 0
    for p, n in sizes:
        before.append((p, at))
        at += n
    before = F.broadcast(rows.sparkSession.createDataFrame(before, "_p int, _before long"))
    placed = placed.withColumn("_p", part.cast("int")).join(before, "_p").withColumn("place", F.col("_before") + within)
    return placed.withColumn("file", _div(F.col("place"), file_records)).drop("_n", "_p", "_before")


def offsets(rows: DataFrame) -> DataFrame:
    """rows (file, place, page_id, length, sha) as digests: file, offset, page_id, length, sha. Offsets follow from the lengths of a file's records."""
    of = Window.partitionBy("file").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("file", F.coalesce(F.sum("length").over(of), F.lit(0)).alias("offset"), "page_id", "length", "sha")


def digests(record_: DataFrame) -> DataFrame:
    """page_id, length and sha of records."""
    return record_.select("page_id", F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("sha"))


def write_warc(pages: DataFrame, path: str, file_records: int = FILE_RECORDS) -> None:
    """WARC files under path, one for each file=N folder, records one after another in the order of ids."""
    rec = records(pages).withColumn("sha", F.sha2("record", 256))
    body = F.expr("left(record, length(record) - 4)")  # the writer ends every record with the separator
    laid = lay_out(rec, file_records).select("file", "place", body.alias("value"))
    laid.repartition("file").sortWithinPartitions("file", "place").select("file", "value").write.partitionBy("file").option("lineSep", _END).text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """file, offset, page_id (null where the record names none), url, html, record (bytes) of every record under path; memory of one file."""

    def walk(it):
        for pdf in it:
            for file, content in zip(pdf["file"], pdf["content"], strict=True):
                rows, at = [], 0
                while at < len(content):
                    body = content.index(b"\r\n\r\n", at) + 4
                    head = dict(x.split(": ", 1) for x in content[at : body - 4].decode().split("\r\n")[1:])
                    end = body + int(head["Content-Length"])
                    page = head["WARC-Record-ID"].removeprefix("<urn:page:").removesuffix(">")
                    rows.append((file, at, None if page == "null" else int(page), head["WARC-Target-URI"], content[body:end].decode(), content[at : end + 4]))
                    at = end + 4
                yield pd.DataFrame(rows, columns=["file", "offset", "page_id", "url", "html", "record"]).astype({"page_id": "Int64"})

    files = spark.read.format("binaryFile").load(path).select(F.col("file").cast("long").alias("file"), "content")
    spark_rows = files.mapInPandas(walk, "file long, offset long, page_id long, url string, html string, record binary")
    return spark_rows


def leaves(digest: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """digest with range_id, and k: the order among a file's records of one id."""
    same = Window.partitionBy("file", "id").orderBy("offset")
    d = digest.withColumn("id", F.coalesce("page_id", F.lit(_LOWEST)))
    return d.select("file", _div(F.col("offset"), range_bytes).alias("range_id"), "id", F.row_number().over(same).alias("k"), "offset", "length", "sha")


def _hash(children: Column, line) -> Column:
    return F.sha2(F.concat_ws(",", F.transform(F.array_sort(children), line)), 256)


def tree(leaf: DataFrame, levels: int) -> list[DataFrame]:
    """Nodes of all levels: ranges (file, range_id, sha), files (node, sha), FAN files at a time, ..., the root (node 0)."""
    line = lambda x: F.concat_ws(":", x["offset"].cast("string"), x["length"].cast("string"), x["sha"])
    out = [materialize(leaf.groupBy("file", "range_id").agg(_hash(F.collect_list(F.struct("offset", "length", "sha")), line).alias("sha")), "ranges")]
    of_range = lambda x: F.concat_ws(":", x["range_id"].cast("string"), x["sha"])
    out.append(materialize(out[0].groupBy(F.col("file").alias("node")).agg(_hash(F.collect_list(F.struct("range_id", "sha")), of_range).alias("sha")), "files"))
    of_node = lambda x: F.concat_ws(":", x["node"].cast("string"), x["sha"])
    for _ in range(levels):
        out.append(materialize(out[-1].groupBy(_div(F.col("node"), FAN).alias("up")).agg(_hash(F.collect_list(F.struct("node", "sha")), of_node).alias("sha")).withColumnRenamed("up", "node"), "merkle"))
    return out


def _differing(x: DataFrame, y: DataFrame, on: list[str]) -> DataFrame:
    return x.join(y.withColumnRenamed("sha", "other"), on, "full").where(~F.col("sha").eqNullSafe(F.col("other"))).select(*on)


def descend(a: list[DataFrame], b: list[DataFrame]) -> DataFrame:
    """file and range_id of every range that differs, by way of differing nodes alone."""
    differ = None
    for x, y in zip(reversed(a[1:]), reversed(b[1:]), strict=True):
        if differ is not None:
            up = differ.withColumnRenamed("node", "up")
            x, y = (t.withColumn("up", _div(F.col("node"), FAN)).join(up, "up", "left_semi").drop("up") for t in (x, y))
        differ = _differing(x, y, ["node"])
    files = differ.withColumnRenamed("node", "file")
    return _differing(*(t.join(files, "file", "left_semi") for t in (a[0], b[0])), ["file", "range_id"])


def audit(first: DataFrame, second: DataFrame) -> DataFrame:
    """Every record of either replica (digests): place and leaf in the first one, its range there, whether the replicas differ in it, and the hash found in the second."""
    a, b = (materialize(leaves(r), "leaves") for r in (first, second))
    top = max((r["m"] for x in (a, b) if (r := x.agg(F.max("file").alias("m")).first())["m"] is not None), default=0)
    levels = max(1, math.ceil(math.log(top + 1, FAN) - 1e-9))
    one, two = tree(a, levels), tree(b, levels)
    bad = materialize(descend(one, two), "ranges")
    key = ["file", "id", "k"]
    x, y = (t.join(bad, ["file", "range_id"], "left_semi") for t in (a, b))
    found = x.select(*key, "sha").join(y.select(*key, F.col("sha").alias("found")), key, "full").where(~F.col("sha").eqNullSafe(F.col("found"))).select(*key, "found", F.lit(True).alias("bad"))
    rows = a.join(one[0].withColumnRenamed("sha", "range_sha256"), ["file", "range_id"]).join(found, key, "full")
    page = F.when(F.col("id") != _LOWEST, F.col("id"))
    wrong = F.coalesce("bad", F.lit(False))
    return rows.select(page.alias("page_id"), "file", "range_id", "offset", "length", F.col("sha").alias("record_sha256"), "range_sha256", wrong.alias("corrupt"), F.when(wrong, F.col("found")).alias("found_sha256"))


def damaged(record_: DataFrame) -> DataFrame:
    """record_ with `found`, the record of a replica with planted damage: of the records whose id leaves 5 on division by 211 every third is lost (null), every third cut short, every third has letters swapped."""
    hit, how = F.pmod(F.col("page_id"), F.lit(211)) == 5, F.pmod(_div(F.col("page_id"), 211), F.lit(3))
    broken = F.when(how == 1, F.expr("substring(record, 1, length(record) - 7)")).when(how == 2, F.translate("record", "ae", "ea"))
    return record_.withColumn("found", F.when(F.coalesce(hit, F.lit(False)), broken).otherwise(F.col("record")))


def op7_warcaudit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC records in files, audited against a replica with planted damage; one row a record."""
    both = damaged(records(table(spark, sf_dir, "pages")))
    both = both.select("page_id", F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("sha"), F.octet_length("found").cast("long").alias("length2"), F.sha2("found", 256).alias("sha2"))
    laid = materialize(lay_out(both), "archive")
    replica = laid.where("sha2 is not null").select("file", "place", "page_id", F.col("length2").alias("length"), F.col("sha2").alias("sha"))
    return audit(offsets(laid), offsets(replica))


ORACLE = r"""
WITH r AS (SELECT page_id, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(page_id::VARCHAR, 'null') || '>' || chr(13) || chr(10) || 'WARC-Target-URI: '
    || replace(replace(coalesce(url, ''), chr(13), '%0D'), chr(10), '%0A') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10)
    || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record FROM pages),
l AS (SELECT page_id, strlen(record)::BIGINT AS n, sha256(record) AS h, record FROM r),
p AS (SELECT *, (row_number() OVER (ORDER BY page_id NULLS FIRST, h) - 1)::BIGINT AS place FROM l),
f AS (SELECT *, place // 4096 AS file FROM p),
o AS (SELECT *, (sum(n) OVER (PARTITION BY file ORDER BY place) - n)::BIGINT AS off FROM f),
q AS (SELECT *, off // 65536 AS range_id FROM o),
g AS (SELECT file, range_id, sha256(string_agg(off || ':' || n || ':' || h, ',' ORDER BY off)) AS range_sha256 FROM q GROUP BY file, range_id),
d AS (SELECT q.*, range_sha256, coalesce(page_id % 211 = 5, false) AS hit, (page_id // 211) % 3 AS how FROM q JOIN g USING (file, range_id))
SELECT page_id, file, range_id, off AS "offset", n AS length, h AS record_sha256, range_sha256, hit AS corrupt,
  CASE WHEN hit AND how = 1 THEN sha256(substr(record, 1, length(record) - 7)) WHEN hit AND how = 2 THEN sha256(translate(record, 'ae', 'ea')) END AS found_sha256 FROM d
"""
