"""Shared pieces of the training-data operators: inputs, written tables, byte and shingle hashing."""

from __future__ import annotations

import gc
import pickle
import tempfile
import time
import uuid

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U = np.uint64
CHUNK_BYTES = 1 << 20
_M1, _M2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); one of our own only where that is unset and Spark runs in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.gettempdir() + "/checkpoints"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def materialize(df: DataFrame, label: str, made: list | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there and survives lost executors. The folder's name is added to `made`, for `discard`."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/vellumtide-{uuid.uuid4().hex}-{label}"
    df.write.parquet(path)
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    if made is not None:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, made: list) -> None:
    """Deletes written tables that nothing reads any more, and lets Spark remove the shuffle files of plans that are done with."""
    jvm = spark._jvm
    while made:
        where = jvm.org.apache.hadoop.fs.Path(made.pop())
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    for pause in (0.3, 0):  # shuffle files go with the plans that the JVM collects, once nothing in Python or in Spark's own queues holds them
        gc.collect()
        jvm.System.gc()
        time.sleep(pause)


def tasks(docs: DataFrame, most: int = 128 << 20) -> int:
    """Partitions for a shuffle of what docs are made into: the session's number, and at least one for every `most` bytes of docs' files."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    usual = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Rows that come from no file have no known size, and what joins are thought to give is no measure.
    return min(max(usual, -(-size // most)), 64 * usual) if size < 1 << 56 else usual


#: A key with more than this share of all rows is hot: there are at most 1 / HOT_SHARE of them, so their keys may be broadcast.
HOT_SHARE = 1 / 4096


def hot_keys(rows: DataFrame, key: str) -> DataFrame:
    """key and number of rows of every hot key (at most 1 / HOT_SHARE rows)."""
    per = rows.groupBy(key).agg(F.count("*").alias("_m"))
    whole = rows.count()
    return per.where(F.col("_m") > F.lit(max(2.0, HOT_SHARE * whole)))


def hot_of(counted: DataFrame, key: str) -> DataFrame:
    """As hot_keys, of a written table that holds the number of rows of each key (_m): no key is shuffled again."""
    whole = counted.agg(F.sum("_m")).first()[0] or 0
    return counted.where(F.col("_m") > F.lit(max(2.0, HOT_SHARE * whole))).select(key, "_m")


def join_hot(rows: DataFrame, small: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """Inner join of rows with small (narrow, one row a key): rows of hot keys by broadcast of small's rows of those keys, the others by key."""
    few = F.broadcast(small.join(F.broadcast(hot.select(key)), key, "left_semi"))
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(few, key).unionByName(rest.join(small, key))


def numbered(docs: DataFrame, *carry: str) -> DataFrame:
    """doc_id, text, the columns `carry` and _d, one number a row in the order of doc_id: the id itself (null as the lowest) where no two rows share one, else a number of its own."""
    lowest = -(1 << 63)
    rows = docs.select("doc_id", "text", *carry, F.coalesce("doc_id", F.lit(lowest)).alias("_d"))
    if rows.groupBy("_d").count().where("count > 1").isEmpty():
        return rows
    rows = rows.select("doc_id", "text", *carry, F.col("_d").alias("_id"), F.xxhash64("text").alias("_h"), F.monotonically_increasing_id().alias("_n"))
    return materialize(rows.orderBy("_id", "_h", "_n").select("doc_id", "text", *carry, F.monotonically_increasing_id().alias("_d")), "numbered")


def ship(spark: SparkSession, model) -> Broadcast:
    """Broadcasts a model by value, so that executors need no copy of its class; `shipped` opens it."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(model))


def shipped(sent: Broadcast):
    return pickle.loads(sent.value)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    x = x ^ (x >> U(30))
    x = x * _M1
    x ^= x >> U(27)
    x *= _M2
    x ^= x >> U(31)
    return x


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, one after another, and n + 1 offsets; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string()).fill_null("")
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if len(col) and col.buffers()[2] is not None and col.buffers()[2].size else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def row_chunks(offs: np.ndarray, most: int = CHUNK_BYTES):
    """Row ranges (a, b) of at most `most` bytes each; a longer text stands alone."""
    a, n = 0, len(offs) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = b


class Bytes:
    """Constant-time hashes of any substring of a chunk, from one prefix sum of byte value times a power of an odd base."""

    _base = U(0x9E3779B97F4A7C15)
    _inv = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

    def __init__(self):
        rng = np.random.default_rng(20240229)
        self.of_byte = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
        self._grow(1 << 12)

    def _grow(self, n: int) -> None:
        with np.errstate(over="ignore"):
            self.pow = np.ones(n + 1, np.uint64)
            self.inv = np.ones(n + 1, np.uint64)
            self.pow[1:] = self._base
            self.inv[1:] = self._inv
            np.multiply.accumulate(self.pow, out=self.pow)
            np.multiply.accumulate(self.inv, out=self.inv)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        n = len(data)
        if n >= len(self.pow):
            self._grow(2 * n)
        out = np.zeros(n + 1, np.uint64)
        np.cumsum(self.of_byte[data] * self.pow[:n], out=out[1:])
        return out

    def span(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of data[start:end], the same wherever those bytes stand; mixed with the length."""
        h = (prefix[end] - prefix[start]) * self.inv[start]
        return mix(h + (end - start).astype(np.uint64) * U(0xD6E8FEB86659FD93))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STEP = mix(np.arange(1, 65, dtype=np.uint64)) | U(1)


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word, a run of bytes other than space and \\t to \\r."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    end[:-1] &= ~inside[1:] | edge[1:-1]
    s = np.flatnonzero(start)
    return s, np.flatnonzero(end) + 1, np.searchsorted(offs, s, "right") - 1


def shingles(hasher: Bytes, data: np.ndarray, offs: np.ndarray, k: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every k-word shingle (not yet distinct); a row of fewer words gives its whole sequence as one."""
    if lower:
        data = _LOWER[data]
    s, e, row = words(data, offs)
    if not len(s):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    w = hasher.span(hasher.prefix(data), s, e)
    m = len(w)
    count = np.bincount(row, minlength=len(offs) - 1)
    h = np.zeros(m, np.uint64)
    for j in range(min(k, m)):
        h[: m - j] += w[j:] * _STEP[j]
    first = np.zeros(len(count) + 1, np.int64)
    np.cumsum(count, out=first[1:])
    full = np.arange(m) + k <= first[row + 1]
    rows, hashes = [row[full]], [mix(h[full])]
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        lead = first[short]
        got = np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            has = count[short] > j
            got[has] += w[lead[has] + j] * _STEP[j]
        rows.append(short)
        hashes.append(mix(got ^ (count[short].astype(np.uint64) * U(0xA24BAED4963EE407))))
    return np.concatenate(rows), np.concatenate(hashes)


def distinct(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, hash), by row and then hash."""
    order = np.lexsort((hashes, rows))
    r, h = rows[order], hashes[order]
    keep = np.ones(len(r), bool)
    keep[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1])
    return r[keep], h[keep]


def pieces(data: np.ndarray, offs: np.ndarray, most: int = CHUNK_BYTES):
    """(bytes, offsets, row of each) of texts: all at once where none is longer than `most`, else long texts in pieces of their own, cut behind a space where there is one."""
    if not len(offs) or np.diff(offs).max(initial=0) <= most:
        yield data, offs, np.arange(len(offs) - 1)
        return
    for i in range(len(offs) - 1):
        text = data[offs[i] : offs[i + 1]]
        a = 0
        while a < len(text):
            b = min(len(text), a + most)
            if b < len(text) and len(gap := np.flatnonzero(text[b - (1 << 12) : b] <= 32)):
                b += int(gap[-1]) + 1 - (1 << 12)
            yield text[a:b], np.array([0, b - a]), np.array([i])
            a = b


def arrow_batches(it, *, column: str = "text"):
    """(batch slice, bytes, offsets) for row ranges of about a megabyte of text."""
    for batch in it:
        col = batch.column(batch.schema.get_field_index(column))
        data, offs = utf8(col)
        for a, b in row_chunks(offs):
            yield batch.slice(a, b - a), data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
