"""Document fingerprints: a threshold-scaled sketch.

Of all distinct word shingles of a text, every one whose hash lies below a fixed fraction of the hash range is kept. Sketches of two
texts are thus samples by one and the same rule: their union is the sketch of the union, and what share of one lies in the other estimates
containment however unequal the texts are.

A fingerprint is the number of distinct shingles and a sum of their hashes (both in hexadecimal) and the kept hashes, ascending, eight digits each:
"n:sum:hashes". Equal texts have equal fingerprints. Texts too short to keep any hash are told apart by number and sum.

Defined cases: null and empty texts have the fingerprint "0:00000000:"; equal fingerprints have likeness 1, otherwise two sketches without
hashes have 0; a null doc_id sorts below every other; rows of equal doc_ids sort by a hash of their text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumtide.llm._kit import CHUNK_BYTES, U, Bytes, distinct, mix, numbered, shingles, table, tasks, utf8

WORDS = 5
FRACTION = 0.25


def sketch(hasher: Bytes, texts: list[str], words: int = WORDS, fraction: float = FRACTION) -> list[str]:
    data, offs = utf8(pa.array(texts, pa.large_string()))
    r, h = distinct(*shingles(hasher, data, offs, words))
    n = len(texts)
    count = np.bincount(r, minlength=n)
    end = np.cumsum(count)
    sums = np.r_[U(0), np.cumsum(mix(h))]
    digest = (sums[end] - sums[end - count]) >> U(32)
    keep = h < U(int(fraction * (1 << 64)))
    kept = (h[keep] >> U(30)).astype(">u4") if fraction <= 0.25 else (h[keep] >> U(32)).astype(">u4")
    number = np.bincount(r[keep], minlength=n)
    at = np.r_[0, np.cumsum(number)] * 8
    text = kept.tobytes().hex()
    return [f"{count[i]:x}:{int(digest[i]):08x}:{text[at[i] : at[i + 1]]}" for i in range(n)]


def hashes(fingerprint: str) -> set[str]:
    s = fingerprint.rpartition(":")[2]
    return {s[i : i + 8] for i in range(0, len(s), 8)}


def likeness(a: str, b: str) -> float:
    """Estimated Jaccard similarity of the two shingle sets."""
    if a == b:
        return 1.0
    x, y = hashes(a), hashes(b)
    both = len(x & y)
    return both / (len(x) + len(y) - both) if x or y else 0.0


def containment(a: str, b: str) -> float:
    """Estimated share of a's shingles that b holds."""
    if a == b:
        return 1.0
    x = hashes(a)
    return len(x & hashes(b)) / len(x) if x else 0.0


def merge(a: str, b: str) -> str:
    """The kept hashes of the union of the two shingle sets."""
    return "".join(sorted(hashes(a) | hashes(b)))


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_LOWEST = -(1 << 63)


def _with_next(docs: DataFrame) -> DataFrame:
    """docs in runs of ascending key: _part, _key, _lead, doc_id, text. Each run begins with a copy (_lead) of the row that precedes it; that of the first
    run is the very last row. Runs are cut at quantiles of the ids, or of numbers of their own where rows share ids, so they are even whatever the ids are."""
    spark = docs.sparkSession
    rows = numbered(docs).select("doc_id", F.col("_d").alias("_key"), F.coalesce("text", F.lit("")).alias("text"))
    parts = 4 * tasks(docs)
    cuts = sorted({int(x) for x in rows.approxQuantile("_key", [i / parts for i in range(1, parts)], 0.2 / parts)})

    @F.pandas_udf("int")
    def part_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(np.array(cuts, np.int64), key.to_numpy(), "right").astype(np.int32))

    rows = rows.withColumn("_part", part_of("_key"))
    ends = rows.groupBy("_part").agg(F.max("_key").alias("_key")).collect()  # one row a run
    ends = sorted((r["_part"], r["_key"]) for r in ends)
    if not ends:
        return rows.withColumn("_lead", F.lit(False))
    lead = [(p, ends[i - 1][0], ends[i - 1][1]) for i, (p, _) in enumerate(ends)]
    lead = F.broadcast(spark.createDataFrame(lead, "_to int, _part int, _key long"))
    last = rows.join(lead, ["_part", "_key"]).groupBy("_to").agg(F.max("text").alias("text"))
    last = last.select(F.lit(None).cast("long").alias("doc_id"), F.lit(_LOWEST).alias("_key"), "text", F.col("_to").alias("_part"), F.lit(True).alias("_lead"))
    return rows.withColumn("_lead", F.lit(False)).unionByName(last)


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last third gives way to the start of the next document's."""
    rows = _with_next(docs)
    rows = rows.repartition(tasks(docs), "_part").sortWithinPartitions("_part", F.col("_lead").desc(), "_key", "text")

    def run(it):
        hasher = Bytes()
        part, prev, prev_fp = None, "", None
        for pdf in it:
            a, size = 0, pdf.text.str.len().to_numpy()
            ends = np.cumsum(size)
            while a < len(pdf):
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + CHUNK_BYTES, "right")))
                chunk = pdf.iloc[a:b]
                a = b
                texts = chunk.text.tolist()
                fps = sketch(hasher, texts)
                edited, todo = [], []
                for i, (p, lead, t) in enumerate(zip(chunk._part, chunk._lead, texts, strict=True)):
                    if not lead:
                        k = len(t) // 3
                        edited.append(t[: len(t) - k] + prev[:k])
                        todo.append((i, prev_fp if part == p else None))
                    part, prev, prev_fp = p, t, fps[i]
                new = sketch(hasher, edited)
                ids = chunk.doc_id.tolist()
                yield pd.DataFrame([(ids[i], len(texts[i]), hashlib.sha256(e.encode()).hexdigest(), fps[i], f, likeness(fps[i], f), likeness(fps[i], nxt)) for (i, nxt), e, f in zip(todo, edited, new, strict=True)], columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]).astype({"doc_id": "Int64"})

    return rows.select("_part", "_lead", "_key", "doc_id", "text").mapInPandas(run, _OUT)


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    return fingerprint_edits(table(spark, sf_dir, "documents").select("doc_id", "text"))
