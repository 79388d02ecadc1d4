"""N-gram Jaccard join on a prefix tree.

Documents are sets of distinct word shingles, ordered by a 64-bit hash. Two link when SIM percent of their union is in their intersection.

1. Documents of equal sets are one node from here on.
2. Nodes that can't link go. Linked sets share the first l of their common shingles, in hash order, within their first
   (length - least overlap + l) shingles. So a node of whose prefix fewer than l shingles stand in any other prefix links with none. Prefixes travel as packed bytes;
   a shingle that several nodes of one task share is settled there and sent once, so a passage of a third of all documents costs one row a task.
3. Among the rest, all nodes of one prefix shingle compare with one of them, its centre, not with each other; a node may leave out the commonest (l - 1) / 2
   shingles of its prefix, as linked nodes then still share one. The nodes around a centre stand in prefix trees of at most BLOCK sets: the centre walks each tree once, an overlap
   counted on a branch is shared by all sets below it, and a branch is left where no set below can reach the bound with the length that remains on either side.
   Nodes within reach of their centre are linked to it, and so to each other.
4. Linked nodes share a centre. Pairs of which one is linked to it and one isn't, or neither, are compared in prefix trees too. By the triangle inequality of the Jaccard
   distance only those within a ring around the centre can link. Rings are dealt in blocks: nodes that aren't linked meet every block, nodes that are stay in one. The walk
   carries the overlaps with all other sets of the block at once. Only a spanning set of the links found leaves the task.
5. Components of the links are found by alternating star steps.

Defined cases: null, empty and blank texts have no shingles and link with nothing; fewer words than a shingle give one shingle; equal sets of one or more shingles
link; a null doc_id counts as the lowest; rows that share a doc_id each keep their set; extra columns are ignored.

Hot keys: rows of a text that is copied very often get their component by a broadcast of the few such nodes; a centre with many nodes around it is copied to one of every BLOCK of them.
A ring of which most nodes link to nothing costs the square of their number in one-way block passes, without emitting pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellumtide.llm._components import components
from vellumtide.llm._kit import HOT_SHARE, U, Bytes, distinct, hot_keys, join_hot, materialize, mix, row_chunks, shingles, table, tasks, utf8

WORDS = 4
SIM = 85
#: Sets in a prefix tree that a centre walks, and in a block of a ring.
BLOCK, RING = 384, 1024
_FLUSH = 1_000_000
_LOWEST = -(1 << 63)
_REC = np.dtype([("t", "<u8"), ("v", "<u8")])


def least_overlap(n, sim: int = SIM):
    """Shingles that a set of n shares with any set that it links with, at least."""
    return -(-n * sim // 100)


def need(n, sim: int = SIM):
    """l of step 2 for a set of n."""
    return np.maximum(1, (n - least_overlap(n, sim) + 1) // 2)


def _prefix(n, sim: int):
    return np.minimum(n, n - least_overlap(n, sim) + need(n, sim))


def _sets(hasher: Bytes, data, offs, words: int):
    """Rows and hashes of distinct shingles, number and node (hash of the set, never 0) of each row."""
    r, h = distinct(*shingles(hasher, data, offs, words))
    n = np.bincount(r, minlength=len(offs) - 1)
    end = np.cumsum(n)
    sums = np.r_[U(0), np.cumsum(mix(h ^ U(0x1234567)))]
    node = mix((sums[end] - sums[end - n]) + n.astype(np.uint64) * U(0x9E3779B97F4A7C15)) | U(1)
    return r, h, n, node


_FOUND = "doc_id long, node long, n int, hits int"


def _found(doc_id=None, node=None, n=None, hits=None) -> pa.RecordBatch:
    m = len(node)
    return pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()) if doc_id is None else pa.array(doc_id, pa.int64()), pa.array(node.view(np.int64), pa.int64()), pa.nulls(m, pa.int32()) if n is None else pa.array(n, pa.int32()), pa.nulls(m, pa.int32()) if hits is None else pa.array(hits, pa.int32())], ["doc_id", "node", "n", "hits"])


def _scan(docs: DataFrame, buckets: int, words: int, sim: int) -> DataFrame:
    def flush(recs, own, turn):
        r = np.concatenate(recs) if recs else np.zeros(0, _REC)
        r = r[np.lexsort((r["v"], r["t"]))]
        r = r[np.r_[True, (r["t"][1:] != r["t"][:-1]) | (r["v"][1:] != r["v"][:-1])]] if len(r) else r
        first = np.flatnonzero(np.r_[True, r["t"][1:] != r["t"][:-1]]) if len(r) else np.zeros(0, np.int64)
        size = np.diff(np.r_[first, len(r)])
        v, c = np.unique(r["v"][np.repeat(size > 1, size)], return_counts=True)
        r = r[first]
        r["v"][size > 1] = 0  # a shingle of several nodes of this task
        cut = np.searchsorted(r["t"] >> U(32), (np.arange(buckets + 1) << 32) // buckets)
        keys = [int(b) for b in np.flatnonzero(np.diff(cut))]
        blobs = [r[cut[b] : cut[b + 1]].tobytes() for b in keys]
        d, node, n = (np.concatenate(x) for x in zip(*own))
        k = len(keys) + 1
        return pa.RecordBatch.from_arrays([pa.array([*keys, turn % buckets], pa.int32()), pa.array([*blobs, b""], pa.binary()), pa.array([b""] * (k - 1) + [np.stack([v, c.astype(np.uint64)]).tobytes()], pa.binary()), pa.array([b""] * (k - 1) + [np.stack([d.view(np.uint64), node, n.astype(np.uint64)]).tobytes()], pa.binary())], ["_b", "recs", "hits", "own"])

    def run(it):
        hasher, recs, own, held, turn = Bytes(), [], [], 0, 0
        for batch in it:
            ids = batch.column(0).to_numpy()
            data, offs = utf8(batch.column(1))
            for x, y in row_chunks(offs):
                r, h, n, node = _sets(hasher, data[offs[x] : offs[y]], offs[x : y + 1] - offs[x], words)
                rank = np.arange(len(r)) - (np.cumsum(n) - n)[r]
                keep = rank < _prefix(n, sim)[r]
                rec = np.empty(int(keep.sum()), _REC)
                # Prefixes are the least hashes of a set: buckets need them spread.
                rec["t"], rec["v"] = mix(h[keep] + U(13)), node[r[keep]]
                recs.append(rec)
                own.append((ids[x:y], node, n))
                held += len(rec)
                if held > _FLUSH:
                    turn += 1
                    yield flush(recs, own, int(node[0] >> U(20)) + turn)
                    recs, own, held = [], [], 0
        if own:
            yield flush(recs, own, turn)

    return docs.mapInArrow(run, "_b int, recs binary, hits binary, own binary")


def _match(it):
    """Step 2, on all buckets of a task: how many shingles of each node stand in another node's prefix, counted at least."""
    parts = [np.zeros(0, _REC)]
    for batch in it:
        for col, rows in ((2, 2), (3, 3)):
            got = [np.frombuffer(raw, "<u8").reshape(rows, -1) for x in batch.column(col) if len(raw := x.as_py())]
            if got:
                got = np.concatenate(got, axis=1)
                yield _found(node=got[0].copy(), hits=got[1].astype(np.int32)) if col == 2 else _found(got[0].view(np.int64), got[1].copy(), got[2].astype(np.int32))
        parts += [np.frombuffer(raw, _REC) for x in batch.column(1) if len(raw := x.as_py())]
    r = np.concatenate(parts)
    if not len(r):
        return
    r = r[np.lexsort((r["v"], r["t"]))]
    r = r[np.r_[True, (r["t"][1:] != r["t"][:-1]) | (r["v"][1:] != r["v"][:-1])]]
    first = np.flatnonzero(np.r_[True, r["t"][1:] != r["t"][:-1]])
    size = np.diff(np.r_[first, len(r)])
    shared = (size > 1) | (r["v"][first] == 0)
    v = r["v"][np.repeat(shared, size)]
    v, c = np.unique(v[v != 0], return_counts=True)
    yield _found(node=v, hits=c.astype(np.int32))


def _lookup(words: int):
    """Ordered sets of texts, where their node is the one asked for."""

    def run(it):
        hasher = Bytes()
        for batch in it:
            data, offs = utf8(batch.column(1))
            want = batch.column(0).to_numpy()
            for x, y in row_chunks(offs):
                r, h, n, node = _sets(hasher, data[offs[x] : offs[y]], offs[x : y + 1] - offs[x], words)
                ok = node.view(np.int64) == want[x:y]
                at = np.r_[0, np.cumsum(n[ok])].astype(np.int32)
                toks = pa.ListArray.from_arrays(pa.array(at), pa.array(h[ok[r]].view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(want[x:y][ok], pa.int64()), pa.array(n[ok].astype(np.int32)), toks.cast(pa.list_(pa.int64()))], ["node", "n", "toks"])

    return run


class PrefixTree:
    """Ordered sets in a path-compressed trie, as arrays: the sets in lexicographic order and the lengths that neighbours share."""

    def __init__(self, sets: list[np.ndarray]):
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].byteswap().tobytes()) if len(sets) > 1 else [0]
        self.sets = [sets[i] for i in self.order]
        self.shared = [0]
        for a, b in zip(self.sets, self.sets[1:]):
            m = min(len(a), len(b))
            differ = np.flatnonzero(a[:m] != b[:m])
            self.shared.append(int(differ[0]) if len(differ) else m)
        self.size = np.array([len(s) for s in self.sets])


def probe(sets: list[np.ndarray], centre: np.ndarray, sim: int = SIM) -> np.ndarray:
    """Overlap of every set with centre (ascending uint64 all), walked over the sets' prefix tree: exact for those that link with it, for others at least their overlap and too small to link."""
    tree, most = PrefixTree(sets), len(centre)
    out = np.zeros(len(sets), np.int64)
    stack = [(0, len(sets), 0, 0, 0)]  # sets a to b - 1 share their first `depth` shingles, which have `got` in common with the centre's first `at`
    while stack:
        a, b, depth, got, at = stack.pop()
        short, long_ = int(tree.size[a:b].min()), int(tree.size[a:b].max())
        upto = min(tree.shared[a + 1 : b]) if b - a > 1 else long_
        part = tree.sets[a]
        while depth < upto:
            if (100 + sim) * (got + min(long_ - depth, most - at)) < sim * (short + most):
                break
            step = min(upto, depth + 64)
            where = np.searchsorted(centre, part[depth:step])
            got += int((centre[np.minimum(where, most - 1)] == part[depth:step]).sum())
            at, depth = int(np.searchsorted(centre, part[step - 1], "right")), step
        if depth < upto or b - a == 1:
            for i in range(a, b):
                out[tree.order[i]] = got + min(int(tree.size[i]) - depth, most - at)
            continue
        ends = [k for k in range(a + 1, b) if tree.shared[k] <= depth]
        for x, y in zip([a, *ends], [*ends, b]):
            stack.append((x, y, depth, got, at))
    return out


def tree_join(sets: list[np.ndarray], open_: np.ndarray, sim: int = SIM) -> list[tuple[int, int]]:
    """Pairs (i, j) of sets (ascending uint64) that link, but for pairs of which neither is `open_`."""
    tree = PrefixTree(sets)
    size = np.array([len(s) for s in sets])
    all_t = np.concatenate(sets)
    own = np.repeat(np.arange(len(sets)), size)
    o = np.argsort(all_t, kind="stable")
    all_t, own = all_t[o], own[o]
    open_ = np.asarray(open_, bool)
    links: list[tuple[int, int]] = []
    m = len(sets)

    def overlap(segment: np.ndarray) -> np.ndarray:
        lo, hi = np.searchsorted(all_t, segment), np.searchsorted(all_t, segment, "right")
        n = hi - lo
        at = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(int(n.sum()))
        return np.bincount(own[at], minlength=m)

    # Sets a to b - 1 share their first `depth` shingles, with which every set of the block has the overlaps `got`.
    stack = [(0, m, 0, np.zeros(m, np.int64), np.ones(m, bool))]
    while stack:
        a, b, depth, got, alive = stack.pop()
        below = tree.size[a:b]
        short, long_ = int(below.min()), int(below.max())
        ids = tree.order[a:b]
        if not open_[ids].any():
            alive = alive & open_
        upto = min(tree.shared[a + 1 : b], default=long_) if b - a > 1 else long_
        while True:
            # intersection >= sim / (100 + sim) of both lengths together
            alive = alive & ((100 + sim) * (got + np.minimum(long_ - depth, size - got)) >= sim * (size + short)) & (100 * size >= sim * short) & (100 * long_ >= sim * size)
            if depth >= upto or not alive.any():
                break
            step = min(upto, depth + 48)
            got = got + overlap(tree.sets[a][depth:step])
            depth = step
        if not alive.any():
            continue
        if b - a == 1:
            i = ids[0]
            ok = alive & ((100 + sim) * got >= sim * (size + size[i]))
            ok[i] = False
            links += [(i, int(j)) for j in np.flatnonzero(ok) if open_[i] or open_[j]]
            continue
        ends = [k for k in range(a + 1, b) if tree.shared[k] <= depth]
        if not ends:  # equal sets
            ends = list(range(a + 1, b))
        for x, y in zip([a, *ends], [*ends, b]):
            stack.append((x, y, depth, got, alive))
    return links


def _spanning(links: list[tuple[int, int]], m: int) -> list[tuple[int, int]]:
    top = list(range(m))

    def find(i):
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    out = []
    for i, j in links:
        a, b = find(i), find(j)
        if a != b:
            top[a] = b
            out.append((i, j))
    return out


_RINGS = "centre long, node long, xr long, cr long, far double, linked boolean"


def _groups(it):
    """Rows of one (centre, b) after another, as a table each, from batches that are sorted by them."""
    rest = None
    for batch in it:
        t = pa.Table.from_batches([batch])
        t = t if rest is None else pa.concat_tables([rest, t]).combine_chunks()
        c, b = t.column("centre").to_numpy(), t.column("b").to_numpy()
        cut = np.flatnonzero((c[1:] != c[:-1]) | (b[1:] != b[:-1])) + 1
        ends = [0, *cut.tolist()]
        for x, y in zip(ends, ends[1:]):
            yield t.slice(x, y - x)
        rest = t.slice(ends[-1])
    if rest is not None and len(rest):
        yield rest


def _toks(t: pa.Table) -> list[np.ndarray]:
    col = t.column("toks").combine_chunks()
    col = col.chunk(0) if isinstance(col, pa.ChunkedArray) else col
    at, flat = col.offsets.to_numpy(), col.values.to_numpy().view(np.uint64)
    return [flat[x:y] for x, y in zip(at[:-1], at[1:])]


def _around(sim: int):
    """Step 3: every group is a centre (its row first) and nodes around it."""

    def run(it):
        rows = []
        for t in _groups(it):
            sets = _toks(t)
            node, rep = t.column("node").to_numpy(), t.column("rep").to_numpy()
            c = int(t.column("centre")[0].as_py())
            size = np.array([len(x) for x in sets[1:]])
            if not len(size):
                continue
            both, most = probe(sets[1:], sets[0], sim), len(sets[0])
            far = 1 - both / (size + most - both)
            rows.append(pa.RecordBatch.from_arrays([pa.array(np.full(len(size), c)), pa.array(node[1:]), pa.array(rep[1:]), pa.array(np.full(len(size), rep[0])), pa.array(far), pa.array((100 + sim) * both >= sim * (size + most))], ["centre", "node", "xr", "cr", "far", "linked"]))
            if len(rows) >= 1000:
                yield from pa.Table.from_batches(rows).combine_chunks().to_batches()
                rows = []
        if rows:
            yield from pa.Table.from_batches(rows).combine_chunks().to_batches()

    return run


def _within(sim: int):
    """Step 4: every group is two blocks of a ring, or one; open nodes are those that their centre doesn't link with."""

    def run(it):
        for t in _groups(it):
            open_ = t.column("open").to_numpy()
            if open_.any() and len(t) > 1:
                rep = t.column("rep").to_numpy()
                if got := _spanning(tree_join(_toks(t), open_, sim), len(t)):
                    i, j = np.array(got).T
                    yield pa.RecordBatch.from_arrays([pa.array(rep[i]), pa.array(rep[j])], ["u", "v"])

    return run


def similarity_components(docs: DataFrame, words: int = WORDS, sim: int = SIM) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text)."""
    n_part = tasks(docs)
    docs = docs.select(F.coalesce("doc_id", F.lit(_LOWEST)).alias("_d"), "text")
    found = _scan(docs, 8 * n_part, words, sim).repartition(n_part, "_b").mapInArrow(_match, _FOUND)
    found = materialize(found, "nodes")
    own = found.where("hits is null").select("doc_id", "node", "n")
    reps = materialize(own.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.count("*").alias("copies")), "reps")
    hits = found.where("hits is not null").groupBy("node").agg(F.sum("hits").alias("hits"))
    # need() of the least length that a partner may have
    partner = F.ceil(F.col("n") * sim / 100.0 - 1e-9)
    asked = F.greatest(F.lit(1), F.floor((partner - F.ceil(partner * sim / 100.0 - 1e-9) + 1) / 2))
    alive = reps.join(hits, "node").where(F.col("hits") >= asked)
    sets = docs.join(alive.select("node", F.col("rep").alias("_d")), "_d").select("node", "text").mapInArrow(_lookup(words), "node long, n int, toks array<long>")
    sets = materialize(sets.dropDuplicates(["node"]).join(alive.select("node", "rep", "hits"), "node"), "sets")

    l = F.greatest(F.lit(1), F.floor((F.col("n") - F.ceil(F.col("n") * sim / 100.0 - 1e-9) + 1) / 2))
    length = F.least(F.col("n"), F.col("n") - F.ceil(F.col("n") * sim / 100.0 - 1e-9) + l).cast("int")
    toks = sets.select("node", (F.col("hits") / F.col("n")).alias("score"), partner.alias("p"), F.explode(F.slice("toks", F.lit(1), length)).alias("tok"))
    centres = toks.groupBy("tok").agg(F.count("*").alias("df"), F.max_by("node", F.struct("score", "node")).alias("centre")).where("df > 1")
    spare = F.floor((F.greatest(F.lit(1), F.floor((F.col("p") - F.ceil(F.col("p") * sim / 100.0 - 1e-9) + 1) / 2)) - 1) / 2)
    near = toks.join(centres, "tok")
    near = near.withColumn("k", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("df"), "tok"))).where(F.col("k") > spare)
    near = materialize(near.select("centre", "node").where("centre <> node").distinct(), "near")
    each = sets.select("node", "rep", "toks")
    # A hot centre is dealt in blocks of its nodes, and copied to each.
    many = materialize(hot_keys(near, "centre"), "hot")
    hot = F.broadcast(many.select("centre", F.ceil(F.col("_m") / F.lit(float(BLOCK))).cast("int").alias("blocks")))
    spread = near.join(hot, "centre", "left").select("centre", F.coalesce(F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"), F.lit(0)).alias("b"), "node")
    members = spread.join(each, "node").select("centre", "b", F.lit(1).alias("o"), "node", "rep", "toks")
    leads = near.select("centre").distinct().join(hot, "centre", "left").select("centre", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)).alias("b"))
    leads = leads.join(each.withColumnRenamed("node", "centre"), "centre").select("centre", "b", F.lit(0).alias("o"), F.col("centre").alias("node"), "rep", "toks")
    rings = members.unionByName(leads).repartition(n_part, "centre", "b").sortWithinPartitions("centre", "b", "o").mapInArrow(_around(sim), _RINGS)
    rings = materialize(rings, "rings")
    links = rings.where("linked").select(F.col("xr").alias("u"), F.col("cr").alias("v"))
    reach = 1 - sim / 100.0
    per = [F.min(F.when(~F.col("linked"), F.col("far"))).alias("inner"), *[F.ceil(F.sum(F.col("linked").cast("int") if x else (~F.col("linked")).cast("int")) / F.lit(float(RING))).cast("int").alias(f"blocks{x}") for x in (0, 1)]]
    ring = rings.groupBy("centre").agg(*per, F.count("*").alias("m")).where("inner is not null and m > 1")
    ring = materialize(ring, "ring")
    dealt = join_hot(rings, ring, "centre", many).where(~F.col("linked") | (F.col("far") >= F.col("inner") - F.lit(reach + 1e-9)))
    # Group (0, i, j): two blocks of open nodes. Group (1, i, j): a block of open nodes and one of linked nodes.
    key = lambda kind, i, j: F.lit(kind << 60) + i.cast("long") * F.lit(1 << 30) + j
    upto = lambda n, make: F.transform(F.sequence(F.lit(0), n - 1), make)
    own = F.pmod(F.xxhash64("node"), F.when(F.col("linked"), F.col("blocks1")).otherwise(F.col("blocks0"))).cast("int")
    dealt = dealt.withColumn("own", own)
    with_open = upto(F.col("blocks0"), lambda o: key(0, F.least(F.col("own"), o), F.greatest(F.col("own"), o)))
    with_linked = F.when(F.col("blocks1") > 0, upto(F.greatest(F.col("blocks1"), F.lit(1)), lambda o: key(1, F.col("own"), o))).otherwise(F.array().cast("array<bigint>"))
    to_open = upto(F.col("blocks0"), lambda o: key(1, o, F.col("own")))
    dealt = dealt.select("centre", "node", (~F.col("linked")).alias("open"), F.explode(F.when(F.col("linked"), to_open).otherwise(F.concat(with_open, with_linked))).alias("b"))
    dealt = dealt.join(each, "node").select("centre", "b", "rep", "open", "toks")
    more = dealt.repartition(n_part, "centre", "b").sortWithinPartitions("centre", "b").mapInArrow(_within(sim), "u long, v long")
    linked = components(links.unionByName(more)).select(F.col("u").alias("rep"), F.col("v").alias("least"))
    of_node = reps.select("node", "rep", "copies").join(linked, "rep", "left").select("node", F.coalesce("least", "rep").alias("component_id"), "copies")
    of_node = materialize(of_node, "of_node")
    rows = found.where("hits is null").select("doc_id", "node", "n")
    whole = of_node.agg(F.sum("copies")).first()[0] or 0
    hot_nodes = of_node.where(F.col("copies") > F.lit(max(2.0, HOT_SHARE * whole))).select("node")
    out = join_hot(rows.where("n > 0"), of_node.drop("copies"), "node", hot_nodes)
    out = out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
    blank = rows.where("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return out.unionByName(blank)


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: components of links at SIM percent over WORDS-word shingles."""
    return similarity_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
