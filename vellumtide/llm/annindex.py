"""Nearest neighbours by additive quantisation, with a bound on what the shortlists leave out.

A vector is approximated by a sum of M codewords, one from each of M codebooks of full dimension. Codebooks are learned on a bounded sample: first
as residual quantisers, then re-solved together by least squares between rounds of beam-search encoding. Every row is encoded by beam search and
stored as M bytes, what they leave of it in one byte a component on a scale of its own, and the norm of what is left then. So a query's score of a row is off by no more than
that norm (times the query's, for inner products), however little the row is like the sample. Rows are shortlisted by the most that they can score, then ranked by exact products of the
original vectors. Where the k-th exact score isn't above all that the shortlist left out, the query is searched again with a longer one, until it is or no row is left out: the result is exact.

Equal vectors are one row of the index, with the k + 1 smallest ids among them, and one query.

The index is scanned in blocks of codes against blocks of queries: a task takes one block of queries and, one after another, the packed code blocks of one of at
most MOST_SLICES slices of the index, keeping the best candidates so far of each query. So what leaves it is one list a query and slice, however many rows there are; the lists of a
block of queries are merged at once. Nothing but codebooks is broadcast (M * 256 vectors at most). Blocks of queries shrink as shortlists grow.

Defined cases: vectors that are null, zero, of another dimension than the commonest or with null or non-finite components take no part; a row with a null id neither;
of rows that share an id the one of the greatest vector (by component) takes part; with fewer than k candidates all are returned; ties go to the smaller id; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumtide.llm._kit import materialize, table

BOOKS, WORDS, BEAM = 32, 64, 2
#: Rows that codebooks are learned on, at most.
TRAIN_ROWS = 8192
ROUNDS = 1
#: Candidates of each query that are ranked exactly at first, and how many times as many when these don't settle it.
RERANK, LONGER = 128, 8
#: Bound on what single precision adds to the error of a product, a component, as a share of the norms.
SLACK = 1.2e-7
#: Queries and codes in a block; slices of the index at most, and tasks below which it is cut into more of them.
QUERY_BLOCK, ROW_BLOCK, MOST_SLICES, ENOUGH = 512, 4096, 16, 64


def _kmeans(x: np.ndarray, k: int, rng, rounds: int = 8) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = (x @ c.T - (c * c).sum(1) / 2).argmax(1)
        n = np.bincount(near, minlength=k)
        s = np.zeros_like(c)
        np.add.at(s, near, x)
        c = np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], x[rng.choice(len(x), k)])
    return c


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """Codes (rows, M) of least squared error found by beam search over the books in turn."""
    m, k, _ = books.shape
    out = np.zeros((len(x), m), np.uint8)
    for a in range(0, len(x), 2048):
        rest = x[a : a + 2048, None, :]
        n = len(rest)
        codes = np.zeros((n, 1, 0), np.uint8)
        for book in books:
            w = rest.shape[1]
            # |rest - word|^2 of all beams and words
            err = (rest**2).sum(2)[:, :, None] - 2 * rest @ book.T + (book * book).sum(1)
            flat = err.reshape(n, w * k)
            keep = min(beam, w * k)
            best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
            b, word = best // k, best % k
            row = np.arange(n)[:, None]
            rest = rest[row, b] - book[word]
            codes = np.concatenate([codes[row, b], word[:, :, None].astype(np.uint8)], 2)
        out[a : a + n] = codes[np.arange(n), (rest**2).sum(2).argmin(1)]
    return out


def decode(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    return sum(books[i][codes[:, i]] for i in range(len(books)))


def learn(x: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = ROUNDS) -> np.ndarray:
    rng = np.random.default_rng(17)
    x = x.astype(np.float64)
    rest, out = x.copy(), []
    for _ in range(books):
        c = _kmeans(rest, words, rng)
        rest -= c[(rest @ c.T - (c * c).sum(1) / 2).argmax(1)]
        out.append(c)
    best = np.stack(out)
    codes = encode(x, best)
    error = ((x - decode(codes, best)) ** 2).sum()
    for _ in range(rounds):
        at = codes + np.arange(books) * words
        gram, right = np.zeros((books * words, books * words)), np.zeros((books * words, x.shape[1]))
        for i in range(books):
            np.add.at(right, at[:, i], x)
            for j in range(books):
                np.add.at(gram, (at[:, i], at[:, j]), 1.0)
        # Little-used words stay near where they are.
        old = best.reshape(books * words, -1)
        new = old + np.linalg.solve(gram + np.eye(books * words), right - gram @ old)
        new = new.reshape(best.shape)
        codes_ = encode(x, new)
        error_ = ((x - decode(codes_, new)) ** 2).sum()
        if error_ >= error:
            break
        best, codes, error = new, codes_, error_
    return best


def usable(rows: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles) of the rows that take part."""
    v = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null and embedding is not null")
    v = v.where(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0))
    size = v.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    return v.where(F.size("embedding") == (size["d"] if size else 0)).groupBy("vec_id").agg(F.max("embedding").alias("embedding"))


def approximation(codes: np.ndarray, fine: np.ndarray, scales: np.ndarray, books: np.ndarray) -> np.ndarray:
    """What the index holds of rows, in single precision."""
    return decode(codes, books) + fine * scales[:, None]


def refined(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes, what they leave of each row in bytes, its scale, and the norm of what is left then."""
    single = books.astype(np.float32)
    codes = encode(x, books)
    rest = x - decode(codes, single)
    scales = (np.abs(rest).max(1) / 127).astype(np.float32)
    fine = np.rint(rest / np.where(scales > 0, scales, 1)[:, None]).clip(-127, 127).astype(np.int8)
    left = np.linalg.norm(x - approximation(codes, fine, scales, single), axis=1) * (1 + 1e-6)
    return codes, fine, scales, left.astype(np.float32)


def build(rows: DataFrame) -> tuple[np.ndarray | None, DataFrame, int, float]:
    """Codebooks, the packed index (part, ids, codes, fine, scales, left), the number of rows and the greatest component: codebooks and index are of vectors divided by it."""
    sample = rows.orderBy(F.xxhash64("vec_id")).limit(TRAIN_ROWS).collect()
    n, most = rows.agg(F.count("*"), F.max(F.array_max(F.transform("embedding", F.abs)))).first()
    if not sample:
        return None, rows, 0, 1.0
    books = learn(np.array([r["embedding"] for r in sorted(sample, key=lambda r: r["vec_id"])]) / most)
    sent = rows.sparkSession.sparkContext.broadcast(books)

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        parts = refined(np.stack(pdf["embedding"].to_numpy()) / most, sent.value)
        return pd.DataFrame({"part": [key[0]], "ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()], **{k: [v.tobytes()] for k, v in zip(("codes", "fine", "scales", "left"), parts)}})

    keyed = rows.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(-(-n // ROW_BLOCK))))
    return books, materialize(keyed.groupBy("part").applyInPandas(pack, "part long, ids binary, codes binary, fine binary, scales binary, left binary"), "codes"), n, most


_LISTS = "qb int, qids binary, ids binary, scores binary"


def _best(ids: np.ndarray, score: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The `most` greatest scores of every row, with their ids, in order; ties to the smaller id."""
    order = np.lexsort((ids, -score), axis=1)[:, :most]
    return np.take_along_axis(ids, order, 1), np.take_along_axis(score, order, 1)


def candidates(index: DataFrame, queries: DataFrame, books: np.ndarray, n: int, most: float, rerank: int, metric: str) -> DataFrame:
    """query_id, vec_id and bound: the `rerank` rows that can score best, and the most that any other row can (null: there is none). Bounds are of vectors divided by `most`, of unit
    queries for inner products."""
    spark = queries.sparkSession
    sent = spark.sparkContext.broadcast(books.astype(np.float32))
    q_blocks = max(1, -(-queries.count() // max(16, QUERY_BLOCK * RERANK // max(RERANK, rerank))))
    slices = max(1, min(MOST_SLICES, -(-n // ROW_BLOCK), -(-ENOUGH // q_blocks)))

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        q = np.stack(pdf["embedding"].to_numpy()) / most
        q = q / np.linalg.norm(q, axis=1)[:, None] if metric == "ip" else q
        return pd.DataFrame({"qb": [key[0]], "qids": [pdf["vec_id"].to_numpy(np.int64).tobytes()], "vecs": [q.astype(np.float32).tobytes()]})

    no = F.lit(None).cast("binary")
    q = queries.withColumn("qb", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(q_blocks)).cast("int")).groupBy("qb").applyInPandas(pack, "qb int, qids binary, vecs binary")
    q = q.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).select("qb", "slice", F.lit(-1).cast("long").alias("part"), F.col("qids").alias("ids"), F.col("vecs").alias("codes"), no.alias("fine"), no.alias("scales"), no.alias("left"))
    rows = index.withColumn("slice", F.pmod("part", F.lit(slices)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1)))).select(*q.columns)

    def scan(it):
        at, qids, vecs, ids, score = None, None, None, None, None

        def out():
            return pd.DataFrame({"qb": [at[0]], "qids": [qids.tobytes()], "ids": [ids.tobytes()], "scores": [score.tobytes()]})

        for pdf in it:
            for r in pdf.itertuples(index=False):
                if (r.qb, r.slice) != at:
                    if ids is not None and ids.shape[1]:
                        yield out()
                    at, ids = (r.qb, r.slice), None
                if r.part < 0:
                    qids = np.frombuffer(r.ids, np.int64)
                    vecs = np.frombuffer(r.codes, np.float32).reshape(len(qids), -1)
                    ids, score = np.zeros((len(qids), 0), np.int64), np.zeros((len(qids), 0), np.float32)
                    continue
                if ids is None:
                    continue  # a block without queries
                own = np.frombuffer(r.ids, np.int64)
                x = approximation(np.frombuffer(r.codes, np.uint8).reshape(len(own), -1), np.frombuffer(r.fine, np.int8).reshape(len(own), -1), np.frombuffer(r.scales, np.float32), sent.value)
                left, norm, slack = np.frombuffer(r.left, np.float32), np.sqrt((x * x).sum(1)), SLACK * (x.shape[1] + 8)
                got = vecs @ x.T
                if metric == "ip":
                    got += left + slack * norm
                else:
                    whole = (vecs * vecs).sum(1)[:, None] + norm * norm
                    got = -(np.maximum(np.sqrt(np.maximum(whole - 2 * got - slack * whole, 0)) - left, 0) ** 2)
                # One more than asked for: its score bounds all that is left out.
                top = min(rerank + 1, len(own))
                best = np.argpartition(-got, top - 1, axis=1)[:, :top]
                ids, score = _best(np.concatenate([ids, own[best]], 1), np.concatenate([score, np.take_along_axis(got, best, 1)], 1), rerank + 1)
        if ids is not None and ids.shape[1]:
            yield out()

    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        qids = np.frombuffer(pdf["qids"][0], np.int64)
        ids = np.concatenate([np.frombuffer(x, np.int64).reshape(len(qids), -1) for x in pdf["ids"]], 1)
        score = np.concatenate([np.frombuffer(x, np.float32).reshape(len(qids), -1) for x in pdf["scores"]], 1)
        ids, score = _best(ids, score, rerank + 1)
        bound = score[:, rerank].astype(np.float64) if ids.shape[1] > rerank else np.full(len(qids), np.nan)
        ids = ids[:, :rerank]
        return pd.DataFrame({"query_id": np.repeat(qids, ids.shape[1]), "vec_id": ids.ravel(), "bound": np.repeat(bound, ids.shape[1])})

    tasks_ = min(q_blocks * slices, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    lists = q.unionByName(rows).repartition(tasks_, "qb", "slice").sortWithinPartitions("qb", "slice", "part").mapInPandas(scan, _LISTS)
    return lists.groupBy("qb").applyInPandas(merge, "query_id long, vec_id long, bound double")


def _distinct(rows: DataFrame, most: int) -> DataFrame:
    """vec_id (the smallest), embedding and ids (the `most` smallest) of equal vectors; those of a large group are sorted in parts first."""
    some = lambda x: F.slice(F.array_sort(x), 1, most)
    part = rows.groupBy("embedding", F.pmod(F.xxhash64("vec_id"), F.lit(256)).alias("part")).agg(some(F.collect_list("vec_id")).alias("ids"))
    return part.groupBy("embedding").agg(some(F.flatten(F.collect_list("ids"))).alias("ids")).select(F.col("ids")[0].alias("vec_id"), "embedding", "ids")


def _nearest(rows: DataFrame, queries: DataFrame, k: int, rerank: int | None, metric: str) -> DataFrame:
    """query_id and top, the k rows of greatest score (s: its negative, vec_id, ids), the query's own among them; rows and queries of different vectors."""
    books, index, n, most = build(rows)
    got, wanted, rerank = [], queries, max(k, rerank or RERANK)
    vectors, top = rows.select("vec_id", "ids", F.col("embedding").alias("x")), "array<struct<s: double, vec_id: bigint, ids: array<bigint>>>"
    while books is not None:
        found = candidates(index, wanted, books, n, most, rerank, metric)
        both = found.join(vectors, "vec_id").join(wanted.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), "query_id")

        def exact(it):
            for pdf in it:
                if len(pdf):
                    x, y = np.stack(pdf["x"].to_numpy()), np.stack(pdf["q"].to_numpy())
                    s = (x * y).sum(1) if metric == "ip" else -((x - y) ** 2).sum(1)
                    # The query's norm brings the score to the scale of bounds.
                    unit = most * (np.linalg.norm(y / most, axis=1) * most if metric == "ip" else most)
                    yield pd.DataFrame({"query_id": pdf["query_id"], "s": -s, "vec_id": pdf["vec_id"], "ids": pdf["ids"], "bound": pdf["bound"] * unit})

        ranked = both.mapInPandas(exact, "query_id long, s double, vec_id long, ids array<bigint>, bound double").withColumn("bound", F.nanvl("bound", F.lit(None).cast("double")))
        ranked = ranked.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("s", "vec_id", "ids"))), 1, k).cast(top).alias("top"), F.max("bound").alias("bound"))
        settled = F.col("bound").isNull() | (F.size("top") >= k) & (-F.element_at("top", k)["s"] > F.col("bound"))
        ranked = materialize(ranked.select("query_id", "top", settled.alias("settled")), "ranked")
        got.append(ranked.where("settled").select("query_id", "top"))
        open_ = ranked.where("not settled").select(F.col("query_id").alias("vec_id"))
        if rerank >= n or open_.isEmpty():
            break
        wanted, rerank = materialize(wanted.join(open_, "vec_id", "left_semi"), "open"), min(n, rerank * LONGER)
    out = got[0] if got else rows.sparkSession.createDataFrame([], f"query_id long, top {top}")
    for more in got[1:]:
        out = out.unionByName(more)
    return out


def search(rows: DataFrame, queries: DataFrame, k: int, rerank: int | None = None, metric: str = "ip") -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest rows for every query, its own id aside. rows, queries: as `usable` gives them. rerank: the length of the first shortlist."""
    different = materialize(_distinct(queries, 1).select("vec_id", "embedding"), "queries")
    top = _nearest(materialize(_distinct(rows, k + 1), "distinct"), different, k + 1, rerank, metric)
    # The k + 1 nearest ids of each different query vector, then those of every query without its own.
    each = F.flatten(F.transform("top", lambda t: F.transform(t["ids"], lambda i: F.struct(t["s"].alias("s"), i.alias("vec_id")))))
    top = top.select("query_id", F.slice(F.array_sort(each), 1, k + 1).alias("top")).join(different.withColumnRenamed("vec_id", "query_id"), "query_id")
    top = queries.join(top.select("embedding", "top"), "embedding").select(F.col("vec_id").alias("query_id"), F.slice(F.filter("top", lambda t: t["vec_id"] != F.col("vec_id")), 1, k).alias("top"))
    ranked = top.select("query_id", F.posexplode("top").alias("pos", "t"))
    return ranked.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), "t.vec_id", (-F.col("t")["s"]).alias("score"))


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every row whose vec_id is divisible by 20, among all other rows."""
    rows = materialize(usable(table(spark, sf_dir, "embeddings")), "vectors")
    return search(rows, rows.where("vec_id % 20 = 0"), 20)
