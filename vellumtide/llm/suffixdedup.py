"""Exact substring deduplication: suffix sorting by bucket-pointer refinement, spread over a cluster.

Every byte covered by a LENGTH-byte string that also starts earlier, in the order of (doc_id, start), is removed.

1. Initial q-gram buckets. Of the GRAM-byte grams inside a LENGTH-byte string the one with the least hash is its anchor. Equal strings have
   equal anchors at equal places, so strings are compared within the bucket of their anchor alone. Neighbouring strings with one anchor form
   a run; about one byte in thirty starts one. A run is sent as a few numbers: hash of the anchor, hash of all its bytes, place.
   Runs that are equal within a task are combined before the shuffle: the first stays, the others are known to be repeats.
2. In a bucket, equal runs are settled by their hashes. Only the first of each of several different runs goes on to the third step.
3. Their bytes are fetched, and their suffixes sorted by bucket-pointer refinement to depth LENGTH: suffixes start in buckets of
   their first 8 bytes; a bucket is refined by sorting on the bucket identifiers of the suffixes one depth later, and each
   round uses the identifiers that the last one refined, which doubles the depth. Of the strings of one last bucket the first stays.
   A bucket that holds more than BIG_BUCKET stretches, and more than BIG_SHARE of all, is not sorted in one task: its strings go one by one, by a hash of all their bytes, and the first stays.
4. The removed stretches of each document are united and cut out.

A passage that a large share of all documents holds would gather its edge runs, all different, in one bucket. Such anchors are looked
for in a sample of documents (this decides how rows travel, never what is removed); their strings are sent one by one, keyed by a hash of all their bytes.

Defined cases: null and empty texts have n_bytes 0, nothing removed and the hash of nothing; a null doc_id counts as the lowest; rows that share one doc_id, the null
ones too, are documents of their own, in the order of a hash of their text, so of repeated rows one keeps its text; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumtide.llm._kit import U, Bytes, distinct, materialize, mix, numbered, row_chunks, table, tasks, utf8

LENGTH = 100
GRAM = 40
#: Share of sampled documents that makes an anchor frequent, and the sampled share.
FREQUENT, SAMPLED = 0.004, 1 / 32
#: Sampled documents that an anchor must stand in at least to count as frequent.
LEAST_SAMPLED = 8
#: Stretches, and share of all stretches, above which a bucket is dealt by its strings; there are at most 1 / BIG_SHARE of these buckets.
BIG_BUCKET, BIG_SHARE = 65_536, 1 / 65_536
_SEGMENT = 4 << 20
_FLUSH = 1_000_000
_POS = (1 << 24) - 1
_REC = np.dtype([("a", "<u8"), ("c", "<u8"), ("d", "<i8"), ("s", "<i4"), ("n", "<i4")])


def _window_min(key: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbours."""
    m, size = key, 1
    while size * 2 <= w:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    return np.minimum(m[: len(key) - w + 1], m[w - size :][: len(key) - w + 1])


def _runs(hasher: Bytes, data: np.ndarray, offs: np.ndarray, length: int, gram: int, frequent: np.ndarray | None):
    """(row, start in chunk, further strings, anchor hash, hash of the bytes) of every run."""
    n = len(data)
    if n < length:
        return None
    prefix = hasher.prefix(data)
    p = np.arange(n - gram + 1)
    h = hasher.span(prefix, p, p + gram)
    key = (h & ~U(_POS)) | p.astype(np.uint64)
    anchor = (_window_min(key, length - gram + 1) & U(_POS)).astype(np.int64)
    start = np.arange(n - length + 1)
    row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))[: len(start)]
    ok = start + length <= offs[row + 1]
    start, row, anchor = start[ok], row[ok], anchor[ok]
    if not len(start):
        return None
    new = np.r_[True, (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])]
    if frequent is not None and len(frequent):
        hot = h[anchor]
        at = np.minimum(np.searchsorted(frequent, hot), len(frequent) - 1)
        hot = frequent[at] == hot
        new |= hot
    first = np.flatnonzero(new)
    more = np.diff(np.r_[first, len(start)]) - 1
    s, a = start[first], h[anchor[first]]
    c = hasher.span(prefix, s, s + more + length) ^ mix((anchor[first] - s).astype(np.uint64) + U(7))
    if frequent is not None:
        a = mix(a + U(11))  # anchors are minima: their hashes crowd at 0, buckets need them spread
    if frequent is not None and len(frequent):
        c = np.where(hot[first], mix(hasher.span(prefix, s, s + length)), c)
        a = np.where(hot[first], c ^ U(0x5851F42D4C957F2D), a)
    return row[first], s, more, a, c


def _chunk_runs(hasher, data, offs, length, gram, frequent):
    """_runs, by segments where one text is longer than a segment."""
    if len(data) <= _SEGMENT + length:
        if (got := _runs(hasher, data, offs, length, gram, frequent)) is not None:
            row, s, *rest = got
            yield (row, s - offs[row], *rest)
        return
    for i in range(len(offs) - 1):
        text = data[offs[i] : offs[i + 1]]
        for a in range(0, len(text), _SEGMENT):
            part = text[a : a + _SEGMENT + length - 1]
            if (got := _runs(hasher, part, np.array([0, len(part)]), length, gram, frequent)) is not None:
                row, s, *rest = got
                yield (row + i, s + a, *rest)


def _spans(d: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping or touching spans of one document united; any order in, by (d, s) out."""
    order = np.lexsort((s, d))
    d, s, e = d[order], s[order], e[order]
    if not len(d):
        return d, s, e
    edge = np.r_[True, d[1:] != d[:-1]]
    block = np.cumsum(edge) - 1
    big = int(e.max()) + 1
    reach = np.maximum.accumulate(e + block * big) - block * big
    new = edge.copy()
    new[1:] |= s[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(d)] - 1
    return d[first], s[first], reach[last]


def _rows(d, s, e, a=None, n=None) -> pa.RecordBatch:
    m = len(d)
    return pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(s, pa.int32()), pa.array(e, pa.int32()), pa.nulls(m, pa.int64()) if a is None else pa.array(a.view(np.int64), pa.int64()), pa.nulls(m, pa.int32()) if n is None else pa.array(n, pa.int32())], ["_d", "s", "e", "a", "n"])


_ROWS = "_d long, s int, e int, a long, n int"


def _scan(docs: DataFrame, buckets: int, length: int, gram: int, frequent: np.ndarray) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(frequent)  # bounded: shares of sampled documents

    def flush(parts: list[np.ndarray], turn: int):
        r = np.concatenate(parts)
        r = r[np.lexsort((r["s"], r["d"], r["c"], r["a"]))]
        first = np.r_[True, (r["a"][1:] != r["a"][:-1]) | (r["c"][1:] != r["c"][:-1])]
        again = r[~first]
        r = r[first]
        cut = np.searchsorted(r["a"] >> U(32), (np.arange(buckets + 1) << 32) // buckets)
        keys, blobs = [], []
        for b in np.flatnonzero(np.diff(cut)):
            keys.append(int(b))
            blobs.append(r[cut[b] : cut[b + 1]].tobytes())
        keys.append(turn % buckets)
        d, s, e = _spans(again["d"], again["s"].astype(np.int64), again["s"].astype(np.int64) + again["n"] + length)
        known = np.stack([d, s, e]).astype("<i8").tobytes() if len(d) else b""
        blobs.append(b"")
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(blobs, pa.binary()), pa.array([b""] * (len(keys) - 1) + [known], pa.binary())], ["_b", "runs", "known"])

    def run(it):
        hasher, parts, held, turn = Bytes(), [], 0, 0
        for batch in it:
            ids = batch.column(0).to_numpy()
            data, offs = utf8(batch.column(1))
            for x, y in row_chunks(offs):
                for row, s, more, a, c in _chunk_runs(hasher, data[offs[x] : offs[y]], offs[x : y + 1] - offs[x], length, gram, sent.value):
                    r = np.empty(len(s), _REC)
                    r["a"], r["c"], r["d"], r["s"], r["n"] = a, c, ids[x + row], s, more
                    parts.append(r)
                    held += len(r)
                if held > _FLUSH:
                    turn += 1
                    yield flush(parts, int(ids[x]) % buckets + turn)
                    parts, held = [], 0
        if parts:
            yield flush(parts, turn)

    return docs.mapInArrow(run, "_b int, runs binary, known binary")


def _frequent(docs: DataFrame, length: int, gram: int) -> np.ndarray:
    """Hashes of anchors that a good share of sampled documents hold, ascending; at most (anchors a document) / FREQUENT of them."""
    some = docs.where(F.pmod(F.xxhash64("_d"), F.lit(round(1 / SAMPLED))) == 0)

    def run(it):
        hasher, sizes = Bytes(), []
        for batch in it:
            data, offs = utf8(batch.column(1))
            for x, y in row_chunks(offs):
                for row, _, _, a, _ in _chunk_runs(hasher, data[offs[x] : offs[y]], offs[x : y + 1] - offs[x], length, gram, None):
                    sizes.append(distinct(row, a)[1])
        if sizes:
            a, n = np.unique(np.concatenate(sizes), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(n, pa.int64())], ["a", "n"])

    total = some.count()
    least = max(LEAST_SAMPLED, int(FREQUENT * total))
    got = some.mapInArrow(run, "a long, n long").groupBy("a").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("a").collect()
    return np.sort(np.array([r["a"] for r in got], np.int64).view(np.uint64))


def _settle(length: int):
    """Step 2, on all buckets of a task."""

    def run(it):
        parts = [np.zeros(0, _REC)]
        for batch in it:
            for blob in batch.column(1):
                if len(raw := blob.as_py()):
                    parts.append(np.frombuffer(raw, _REC))
            for blob in batch.column(2):
                if len(raw := blob.as_py()):
                    d, s, e = np.frombuffer(raw, "<i8").reshape(3, -1)
                    yield _rows(d, s, e)
        r = np.concatenate(parts)
        if not len(r):
            return
        r = r[np.lexsort((r["s"], r["d"], r["c"], r["a"]))]
        new_a = np.r_[True, r["a"][1:] != r["a"][:-1]]
        new_c = new_a | np.r_[True, r["c"][1:] != r["c"][:-1]]
        again = r[~new_c]
        d, s, e = _spans(again["d"], again["s"].astype(np.int64), again["s"].astype(np.int64) + again["n"] + length)
        yield _rows(d, s, e)
        r, new_a = r[new_c], new_a[new_c]
        many = np.diff(np.r_[np.flatnonzero(new_a), len(r)]) > 1
        r = r[np.repeat(many, np.diff(np.r_[np.flatnonzero(new_a), len(r)]))]
        if len(r):
            yield _rows(r["d"], r["s"], r["s"] + r["n"] + length, r["a"], r["n"])

    return run


def refine(text: np.ndarray, depth: int) -> np.ndarray:
    """Bucket identifiers of all suffixes of text (uint8), equal where the first `depth` bytes are equal (bytes past the end count as 0), and in their order.

    Bucket-pointer refinement: a suffix's identifier is the place where its bucket begins in the sorted order, so a bucket's
    refinement touches no other bucket, and buckets of one suffix are never looked at again."""
    n = len(text)
    q = min(8, depth)
    pad = np.r_[text.astype(np.uint64), np.zeros(8, np.uint64)]
    key = np.zeros(n, np.uint64)
    for i in range(q):
        key = key << U(8) | pad[i : i + n]
    order = np.argsort(key, kind="stable")
    k = key[order]
    edge = np.r_[True, k[1:] != k[:-1]]
    begin = np.flatnonzero(edge)
    size = np.diff(np.r_[begin, n])
    bucket = np.full(n + depth, -1, np.int64)
    bucket[order] = np.repeat(begin, size)
    active = order[np.repeat(size > 1, size)]
    h = q
    while h < depth and len(active):
        step = min(h, depth - h)
        one, two = bucket[active], bucket[active + step]
        o = np.lexsort((two, one))
        active, one, two = active[o], one[o], two[o]
        top = np.r_[True, one[1:] != one[:-1]]
        sub = top | np.r_[True, two[1:] != two[:-1]]
        place = np.arange(len(active))
        lead = np.maximum.accumulate(np.where(top, place, 0))
        begin = np.flatnonzero(sub)
        size = np.diff(np.r_[begin, len(active)])
        bucket[active] = np.repeat(one[begin] + begin - lead[begin], size)
        active = active[np.repeat(size > 1, size)]
        h += step
    return bucket[:n]


def _first_strings(d: np.ndarray, s: np.ndarray, n: np.ndarray, text: np.ndarray, at: np.ndarray, length: int):
    """Spans of strings that stand in an earlier place among the given stretches. Stretch i is text[at[i]:at[i + 1]] and starts n[i] + 1 strings."""
    bucket = refine(text, length)
    own = np.repeat(np.arange(len(d)), n + 1)
    rel = np.arange(len(own)) - np.repeat(np.r_[0, np.cumsum(n + 1)[:-1]], n + 1)
    b, doc, pos = bucket[at[own] + rel], d[own], s[own] + rel
    o = np.lexsort((pos, doc, b))
    again = o[1:][b[o][1:] == b[o][:-1]]
    return _spans(doc[again], pos[again].astype(np.int64), pos[again].astype(np.int64) + length)


def _fetch(it):
    """Bytes of the stretches asked for: d, a, s, n, bytes."""
    for pdf in it:
        out = []
        for d, text, want in zip(pdf["_d"], pdf["text"], pdf["want"], strict=True):
            raw = (text or "").encode()
            out += [(d, w["a"], w["s"], w["n"], raw[w["s"] : w["e"]]) for w in want]
        yield pd.DataFrame(out, columns=["_d", "a", "s", "n", "raw"])


def _compare(length: int):
    """Step 3, on all buckets of a task, a megabyte of stretches at a time; a bucket is never split."""

    def run(it):
        t = pa.Table.from_batches(list(it), schema=pa.schema([("_d", pa.int64()), ("a", pa.int64()), ("s", pa.int32()), ("n", pa.int32()), ("raw", pa.binary())]))
        if not t.num_rows:
            return
        t = t.sort_by("a")
        a, d, s, n = (t.column(c).to_numpy() for c in ("a", "_d", "s", "n"))
        raw = t.column("raw").combine_chunks()
        raw = (raw.chunk(0) if isinstance(raw, pa.ChunkedArray) else raw).cast(pa.large_binary())
        at = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
        text = np.frombuffer(raw.buffers()[2], np.uint8)
        edge = np.r_[np.flatnonzero(np.r_[True, a[1:] != a[:-1]]), len(a)]
        i = 0
        while i < len(edge) - 1:
            j = max(i + 1, int(np.searchsorted(at[edge], at[edge[i]] + (1 << 20), "right")) - 1)
            x, y = edge[i], edge[j]
            i = j
            yield _rows(*_first_strings(d[x:y], s[x:y].astype(np.int64), n[x:y].astype(np.int64), text[at[x] : at[y]], at[x : y + 1] - at[x], length))

    return run


def _strings(length: int):
    """d, s and a hash of every string of the stretches asked for."""

    def run(it):
        hasher = Bytes()
        for batch in it:
            for i, raw in enumerate(batch.column("raw")):
                data = np.frombuffer(raw.as_py(), np.uint8)
                at = np.arange(len(data) - length + 1)
                h = hasher.span(hasher.prefix(data), at, at + length)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), batch.column("_d")[i].as_py())), pa.array((batch.column("s")[i].as_py() + at).astype(np.int32)), pa.array(h.view(np.int64))], ["_d", "s", "h"])

    return run


def _after_first(length: int):
    """Strings that an equal one precedes, of rows sorted by (h, _d, s)."""

    def run(it):
        last = None
        for batch in it:
            h, d, s = (batch.column(c).to_numpy() for c in ("h", "_d", "s"))
            again = np.r_[last is not None and h[0] == last, h[1:] == h[:-1]] if len(h) else np.zeros(0, bool)
            last = h[-1] if len(h) else last
            if again.any():
                yield _rows(*_spans(d[again], s[again].astype(np.int64), s[again].astype(np.int64) + length))

    return run


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """docs as `numbered` gives them. _d, s, e: stretches of bytes to remove; they may overlap."""
    n = tasks(docs)
    docs = docs.select("_d", "text")
    runs = _scan(docs, 8 * n, length, gram, _frequent(docs, length, gram))
    settled = materialize(runs.repartition(n, "_b").mapInArrow(_settle(length), _ROWS), "runs")
    open_ = settled.where("a is not null")
    sizes = open_.groupBy("a").agg(F.count("*").alias("m"))
    whole = sizes.agg(F.sum("m")).first()[0] or 0
    big = materialize(sizes.where(F.col("m") > F.lit(max(float(BIG_BUCKET), BIG_SHARE * whole))).select("a"), "big")
    want = open_.groupBy("_d").agg(F.collect_list(F.struct("a", "s", "n", "e")).alias("want"))
    fetched = docs.join(want, "_d").select("_d", "text", "want").mapInPandas(_fetch, "_d long, a long, s int, n int, raw binary")
    found = [settled.where("a is null")]
    if big.isEmpty():
        found.append(fetched.repartition(n, "a").mapInArrow(_compare(length), _ROWS))
    else:
        fetched = materialize(fetched, "stretches")
        small, large = (fetched.join(F.broadcast(big), "a", how).select("_d", "a", "s", "n", "raw") for how in ("left_anti", "left_semi"))
        found.append(small.repartition(n, "a").mapInArrow(_compare(length), _ROWS))
        strings = large.mapInArrow(_strings(length), "_d long, s int, h long")
        found.append(strings.repartition(n, "h").sortWithinPartitions("h", "_d", "s").mapInArrow(_after_first(length), _ROWS))
    out = found[0].select("_d", "s", "e")
    for more in found[1:]:
        out = out.unionByName(more.select("_d", "s", "e"))
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept, the remaining bytes."""
    docs = numbered(docs)
    gone = repeats(docs, length, gram).groupBy("_d").agg(F.collect_list(F.struct("s", "e")).alias("gone"))
    rows = docs.join(gone, "_d", "left")

    def run(it):
        for pdf in it:
            out = []
            for doc, text, spans in zip(pdf["doc_id"], pdf["text"], pdf["gone"], strict=True):
                raw = (text or "").encode()
                keep, removed, count = raw, 0, 0
                if spans is not None and len(spans):
                    se = np.array([(x["s"], x["e"]) for x in spans], np.int64)
                    _, s, e = _spans(np.zeros(len(se), np.int64), se[:, 0], np.minimum(se[:, 1], len(raw)))
                    count, removed = len(s), int((e - s).sum())
                    keep = b"".join(raw[a:b] for a, b in zip([0, *e], [*s, len(raw)], strict=True))
                out.append((doc, len(raw), removed, count, hashlib.sha256(keep).hexdigest(), keep))
            yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]).astype({"doc_id": "Int64"})

    return rows.select("doc_id", "text", "gone").mapInPandas(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op1_suffixdedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("kept")
