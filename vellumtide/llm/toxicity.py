"""Toxicity by class-conditional Kneser-Ney models.

Two byte n-gram models, one of toxic and one of ordinary texts, are counted over all labelled rows that are neither held out nor set apart for calibration. The history of a
byte is what stands before it in its word, the word's beginning included, up to ORDER - 1 bytes; a word is a run of ASCII letters, digits and bytes of other scripts, and the byte
behind it, so text in brackets, behind a hyphen or in a script without spaces is read like any other. With absolute discounting

    P_c(x | h) = max(N_c(hx) - D, 0) / N_c(h) + lambda_c(h) * S(x | h')

where lambda_c(h) is the mass that the discounts of class c free at h, and S is one distribution that both classes share: interpolated Kneser-Ney over continuation counts (the
number of different longer expressions that end in hx), level by level down to single bytes. So a rare expression is smoothed alike in both models, and what neither has seen weighs
only by their freed masses. Every expression keeps its count, however rare it is and however large the corpus is.

A word's log-likelihood ratio depends on its bytes alone. Expressions of at least SHARE of a class's bytes, 2 / SHARE of them at most, go to the executors, and words that consist of
them are settled where they stand. Words that hold any other expression travel: each different one gets its expressions from the whole models by joins, and its ratio returns to
the texts that hold it. Ratios are multiples of 1 / UNIT nats, so sums don't depend on their order: SHARE decides only how expressions travel, no score depends on it (a test holds this).

The log-likelihoods are compared length-normalised: by byte over the whole text, and by word, for a few toxic words in a long text say more than the text's mean. A logistic fit on
labelled rows that the models haven't seen makes a probability of them.

Counts are combined within a task, then by expression; every table of the models stays distributed. Only the calibration takes a bounded sample of rows.
Scoring is vectorised over megabyte chunks of whole texts (longer texts piece by piece); of texts, only their words of rare expressions are shuffled.

Defined cases: null and empty texts have no evidence and score the calibrated prior; null labels teach nothing; a class without labelled rows
gives every text the share of toxic labels (0 without labels); repeated rows score alike; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StructField, StructType

from vellumtide.llm._kit import U, arrow_batches, discard, hot_of, join_hot, materialize, mix, pieces, row_chunks, ship, shipped, table

#: Bytes of an expression: a byte and its history.
ORDER = 8
#: About how many labelled rows of each class calibrate the models; a class of fewer rows than both numbers together is divided in their proportion.
TRAIN_ROWS, CALIBRATE_ROWS = 3000, 1000
#: Taken off every count.
DISCOUNT = 0.75
#: Share of the bytes of a class that an expression must be to go to the executors; the others are joined.
SHARE = 2.0**-22
#: Log-likelihood ratios are integers, this many to a nat.
UNIT = 1 << 20
#: Nats above which a word's log-likelihood ratio speaks for itself.
LOUD = 4.0
_SLOT_BITS = 21
#: Expressions that a task holds before it sends their counts on.
_FLUSH = 2_000_000

#: ASCII letters in lower case; whatever is neither letter nor digit is a space.
_FOLD = np.full(256, 32, np.uint8)
_FOLD[48:58], _FOLD[97:123], _FOLD[65:91], _FOLD[128:] = np.arange(48, 58), np.arange(97, 123), np.arange(97, 123), np.arange(128, 256)
_BYTES = np.array([(1 << 8 * (k + 1)) - 1 for k in range(ORDER)], np.uint64)
_MARK = np.array([1 << 8 * (k + 1) for k in range(ORDER - 1)] + [0], np.uint64)


def expressions(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The expression that ends at every byte, packed (a 1 before the word's first byte marks a beginning); where words begin."""
    low = _FOLD[data]
    n = len(low)
    first = np.zeros(n, bool)
    first[1:] = low[:-1] == 32
    first[offs[:-1][np.diff(offs) > 0]] = True
    at = np.flatnonzero(first)
    place = np.minimum(np.arange(n) - np.repeat(at, np.diff(np.r_[at, n])), ORDER - 1)
    low = low.astype(np.uint64)
    key = low.copy()
    for k in range(1, min(ORDER, n)):
        key[k:] |= low[:-k] << U(8 * k)
    return key & _BYTES[place] | _MARK[place], at


def _combined(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their (2-row) counts."""
    keys, counts = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts], 1)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[:, order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first, axis=1) if len(first) else counts


def _counts(it):
    """Expressions with their number in each class, over the (text, toxic) rows of a task."""
    done: list[tuple[np.ndarray, np.ndarray]] = []
    new: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0

    def out():
        for keys, counts in done:
            if len(keys):
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts[1]), pa.array(counts[0])], ["key", "toxic", "ordinary"])

    for batch, data, offs in arrow_batches(it):
        of_text = batch.column(batch.schema.get_field_index("toxic")).to_numpy(zero_copy_only=False)
        for part, cut, row in pieces(data, offs):
            for t in (0, 1):
                own = of_text[row] == t
                mine = part if own.all() else part[np.repeat(own, np.diff(cut))]
                if not len(mine):
                    continue
                key, n = np.unique(expressions(mine, np.r_[0, np.cumsum(np.diff(cut)[own])])[0], return_counts=True)
                counts = np.zeros((2, len(key)), np.int64)
                counts[t] = n
                new.append((key, counts))
                held += len(key)
            if held > _FLUSH // 2:
                done, new, held = [_combined(done + new)], [], 0
                if len(done[0][0]) > _FLUSH:
                    yield from out()
                    done = []
    if done or new:
        done = [_combined(done + new)]
        yield from out()


def count(rows: DataFrame) -> DataFrame:
    """rows (text, toxic). key, toxic, ordinary: how often each class holds an expression, over all rows."""
    part = rows.select("text", "toxic").mapInArrow(_counts, "key long, toxic long, ordinary long")
    return part.groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def _low(key: Column, n: int) -> Column:
    return key.bitwiseAND(F.lit((1 << 8 * n) - 1))


def _history(key: Column) -> Column:
    return F.shiftrightunsigned(key, 8)


def shared(counted: DataFrame, made: list | None = None) -> DataFrame:
    """key, p: S of every expression without its first symbol, for all lengths. All expressions of one history (at most 256) meet in a window, never more. `made` gets what is written."""
    size = F.floor(F.length(F.hex("key")) / 2)  # bytes: a mark is one further digit
    top = counted.select("key", size.alias("size"))
    levels: dict[int, DataFrame] = {}
    longer = top.where(F.col("size") == ORDER).select("key")
    for n in range(ORDER - 1, 0, -1):
        # A beginning has nothing before it but its mark: one different expression, like any other that is one symbol longer.
        further = longer.unionByName(top.where(F.col("size") == n).select("key"))
        levels[n] = materialize(further.groupBy(_low(F.col("key"), n).alias("key")).agg(F.count("*").alias("c")), "continuations", made)
        longer = levels[n].select("key")
    out, below = None, None
    for n in range(1, ORDER):
        of = Window.partitionBy(_history(F.col("key")))
        lev = levels[n].withColumn("all", F.sum("c").over(of)).withColumn("freed", F.sum(F.least("c", F.lit(DISCOUNT))).over(of))
        lev = lev.withColumn("p", F.lit(1 / 256)) if below is None else lev.withColumn("k", _low(F.col("key"), n - 1)).join(below.select(F.col("key").alias("k"), "p"), "k")
        below = materialize(lev.select("key", ((F.greatest(F.col("c") - F.lit(DISCOUNT), F.lit(0.0)) + F.col("freed") * F.col("p")) / F.col("all")).alias("p")), "shared", made)
        out = below if out is None else out.unionByName(below)
    return out


def models(counted: DataFrame, n_toxic: int, n_ordinary: int, share: float = SHARE, *, made: list | None = None) -> DataFrame:
    """key, history, toxic, ordinary (log probabilities of both models), freed_toxic and freed_ordinary (logs of lambda) of every expression; hot: whether it is `share` of a class's bytes."""
    of = Window.partitionBy("history")
    c = counted.withColumn("history", _history(F.col("key"))).withColumn("hot", (F.col("toxic") >= max(1.0, share * n_toxic)) | (F.col("ordinary") >= max(1.0, share * n_ordinary)))
    for name in ("toxic", "ordinary"):
        took = F.greatest(F.col(name) - F.lit(DISCOUNT), F.lit(0.0))
        whole = F.greatest(F.sum(name).over(of), F.lit(1))
        c = c.withColumn(f"own_{name}", took / whole).withColumn(f"freed_{name}", F.when(F.sum(name).over(of) > 0, 1 - F.sum(took).over(of) / whole).otherwise(F.lit(1.0)))
    size = F.floor(F.length(F.hex("key")) / 2)
    suffix = _low(F.col("key"), ORDER - 1)
    for n in range(1, ORDER - 1):
        suffix = F.when(size == n, _low(F.col("key"), n)).otherwise(suffix)
    c = c.withColumn("k", suffix).join(shared(counted, made).select(F.col("key").alias("k"), "p"), "k")
    logs = [F.log(F.col(f"own_{x}") + F.col(f"freed_{x}") * F.col("p")).alias(x) for x in ("toxic", "ordinary")]
    return c.select("key", "history", *logs, *[F.log(f"freed_{x}").alias(f"freed_{x}") for x in ("toxic", "ordinary")], "hot")


class Model:
    """Log-likelihood ratios, toxic to ordinary, of hot expressions."""

    def __init__(self, keys: np.ndarray, ratios: np.ndarray):
        self.known = self._table(keys, ratios.astype(np.int32))

    @staticmethod
    def _table(keys: np.ndarray, values: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, int]]:
        """Hash tables in which each key has one slot of one table; few tables, each for what collided in those before."""
        out, salt = [], 0
        while len(keys):
            bits = min(_SLOT_BITS, max(8, int(len(keys)).bit_length() + 1))
            slot = (mix(keys + U(salt * 977 + 1)) >> U(64 - bits)).astype(np.int64)
            held, value = np.full(1 << bits, (1 << 64) - 1, np.uint64), np.zeros(1 << bits, np.int32)
            held[slot], value[slot] = keys, values
            out.append((held, value, salt))
            rest = held[slot] != keys
            keys, values, salt = keys[rest], values[rest], salt + 1
        return out

    def look(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ratios of keys (0 where not hot), and which are hot."""
        got, found, left = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool), np.arange(len(keys))
        for held, value, salt in self.known:
            k = keys[left]
            slot = (mix(k + U(salt * 977 + 1)) >> U(64 - (len(held).bit_length() - 1))).astype(np.int64)
            hit = held[slot] == k
            got[left[hit]], found[left[hit]] = value[slot[hit]], True
            left = left[~hit]
        return got, found

    def evidence(self, data: np.ndarray, offs: np.ndarray, others: list | None = None) -> np.ndarray:
        """Bytes, sum of the log-likelihood ratios, greatest of a word's, and sum of what words have above LOUD; a row a text, zeros for empty ones.
        Words that hold an expression that isn't hot are left out, and added to `others`: text, bytes, length of each."""
        out = np.zeros((len(offs) - 1, 4), np.int64)
        out[:, 0] = np.diff(offs)
        for part, cut, row in pieces(data, offs):
            key, at = expressions(part, cut)
            if not len(at):
                continue
            ratio, found = self.look(key)
            settled = np.logical_and.reduceat(found, at)
            word = np.where(settled, np.add.reduceat(ratio, at), 0)
            some = np.flatnonzero(np.diff(cut))
            lead = np.searchsorted(at, cut[:-1][some])
            np.add.at(out[:, 1], row[some], np.add.reduceat(word, lead))
            np.maximum.at(out[:, 2], row[some], np.maximum.reduceat(word, lead))
            np.add.at(out[:, 3], row[some], np.add.reduceat(np.maximum(word - int(LOUD * UNIT), 0), lead))
            if others is not None and not settled.all():
                size = np.diff(np.r_[at, len(part)])
                others.append((row[np.searchsorted(cut, at[~settled], "right") - 1], _FOLD[part][np.repeat(~settled, size)], size[~settled]))
        return out


_WORDS = ArrayType(StructType([StructField("word", BinaryType()), StructField("times", LongType())]))
_EVIDENCE = ["n", "total", "most", "loud"]


def _by_text(others: list, n: int) -> pa.ListArray:
    """The different words of each of n texts, and how often each stands there."""
    row, raw, size = (np.concatenate([np.zeros(0, t), *x]) for x, t in zip(zip(*others) if others else [()] * 3, (np.int64, np.uint8, np.int64)))
    words = pa.Array.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(np.r_[0, np.cumsum(size)].astype(np.int64)), pa.py_buffer(raw)]).cast(pa.binary()).dictionary_encode()
    each, times = np.unique(row * (len(words.dictionary) + 1) + words.indices.to_numpy(), return_counts=True)
    row, word = np.divmod(each, len(words.dictionary) + 1)
    cells = pa.StructArray.from_arrays([words.dictionary.take(pa.array(word)), pa.array(times, pa.int64())], ["word", "times"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)), pa.int32()), cells)


def _asked(sent):
    """Of every word (_w, word) the sum of its hot expressions' ratios (key null), and its other expressions."""

    def run(it):
        model = shipped(sent)
        for batch in it:
            w, col = batch.column(0).to_numpy(), batch.column(1).cast(pa.large_binary())
            offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
            data = np.frombuffer(col.buffers()[2], np.uint8)
            for a, b in row_chunks(offs):
                key, at = expressions(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                ratio, found = model.look(key)
                miss = np.flatnonzero(~found)
                of = w[a:b][np.searchsorted(at, miss, "right") - 1]
                none = np.arange(len(miss) + b - a) < b - a
                keys = pa.array(np.r_[np.zeros(b - a, np.int64), key[miss].view(np.int64)], mask=none)
                yield pa.RecordBatch.from_arrays([pa.array(np.r_[w[a:b], of]), keys, pa.array(np.r_[np.add.reduceat(ratio, at), np.zeros(len(miss), np.int64)])], ["_w", "key", "value"])

    return run


def _ratios(words: DataFrame, sent, found: DataFrame, written: list) -> DataFrame:
    """_w, value: the log-likelihood ratio of every word (_w, word). An expression that no class holds has the ratio of the masses freed at its history; 0 where that is unknown too. `written` gets what the result is read from."""
    spark, made = words.sparkSession, []
    asked = materialize(words.select("_w", "word").mapInArrow(_asked(sent), "_w long, key long, value long"), "asked", made)
    keys = asked.where("key is not null").select("_w", "key")
    each = keys.groupBy("key").agg(F.count("*").alias("_m")).withColumn("history", _history(F.col("key")))
    freed = found.groupBy("history").agg(F.max("freed").alias("freed"))
    each = each.join(found.where("not hot").select("key", "ratio"), "key", "left").join(freed, "history", "left")
    each = materialize(each.select("key", "_m", F.coalesce("ratio", "freed", F.lit(0).cast("long")).alias("value")), "answers", made)
    discard(spark, [])
    got = join_hot(keys, each, "key", hot_of(each, "key")).select("_w", "value")
    out = materialize(got.unionByName(asked.where("key is null").select("_w", "value")).groupBy("_w").agg(F.sum("value").alias("value")), "ratios", written)
    discard(spark, made)
    return out


def evidence(rows: DataFrame, model: Model, found: DataFrame) -> DataFrame:
    """rows (_row, _text). _row, and n, total, most, loud of its text as in Model.evidence, of all words."""
    sent, made = ship(rows.sparkSession, model), []

    def run(it):
        model_ = shipped(sent)
        for batch, data, offs in arrow_batches(it, column="_text"):
            others = []
            got = model_.evidence(data, offs, others)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x) for x in got.T.copy()], _by_text(others, len(got))], ["_row", *_EVIDENCE, "words"])

    schema = StructType([StructField("_row", rows.schema["_row"].dataType), *[StructField(x, LongType()) for x in _EVIDENCE], StructField("words", _WORDS)])
    at = materialize(rows.select("_row", "_text").mapInArrow(run, schema).withColumn("_at", F.monotonically_increasing_id()), "evidence")
    # Long words go by their digests, longer than any short word.
    name = F.when(F.length("o.word") <= 64, F.col("o.word")).otherwise(F.concat(F.substring("o.word", 1, 33), F.unhex(F.sha2("o.word", 256))))
    held = at.select("_at", F.explode("words").alias("o")).select("_at", "o.word", "o.times", name.alias("name"))
    words = materialize(held.groupBy("word", "name").agg(F.count("*").alias("_m")).withColumn("_w", F.monotonically_increasing_id()), "words", made)
    discard(rows.sparkSession, [])
    values = materialize(words.select("_w", "name", "_m").join(_ratios(words, sent, found, made), "_w").select("name", "_m", "value"), "values")
    discard(rows.sparkSession, made)
    held = held.select("_at", "name", "times")
    more = join_hot(held, values, "name", hot_of(values, "name")).groupBy("_at").agg(
        F.sum(F.col("times") * F.col("value")).alias("total_"),
        F.max("value").alias("most_"),
        F.sum(F.col("times") * F.greatest(F.col("value") - int(LOUD * UNIT), F.lit(0))).alias("loud_"),
    )
    out = at.drop("words").join(more, "_at", "left")
    return out.select("_row", "n", F.expr("total + coalesce(total_, 0)").alias("total"), F.expr("greatest(most, coalesce(most_, 0))").alias("most"), F.expr("loud + coalesce(loud_, 0)").alias("loud"))


def _features(evidence: np.ndarray) -> np.ndarray:
    """The log-likelihood ratio by byte, the greatest of a word's, and what loud words have above LOUD: in logs, and by byte."""
    n, total, most, loud = evidence.T / np.array([1, UNIT, UNIT, UNIT])[:, None]
    n = np.maximum(n, 1)
    return np.stack([np.ones(len(n)), 100 * total / n, most, np.log1p(loud), 100 * loud / n], 1)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.01) -> np.ndarray:
    b = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - ridge * b)
        b += np.clip(step, -3, 3)
    return b


class Scorer:
    """found: key, history, ratio, freed, hot of every expression; model holds the hot ones."""

    def __init__(self, model: Model | None, found: DataFrame | None, b: np.ndarray | None, prior: float):
        self.model, self.found, self.b, self.prior = model, found, b, prior


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, calibrate_rows: int = CALIBRATE_ROWS) -> Scorer:
    """docs (doc_id, text), labels (doc_id, toxic). About calibrate_rows rows of each class, chosen by a hash of the id, calibrate; of a class of fewer than
    train_rows + calibrate_rows rows, their share of that sum. The models count all others."""
    known = labels.where("toxic in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id"))).select("doc_id", "toxic").distinct()
    n = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return Scorer(None, None, None, float(n.get(1, 0) > 0))
    prior = n[1] / (n[0] + n[1])
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = {k: calibrate_rows / max(train_rows + calibrate_rows, v) for k, v in n.items()}
    known = known.withColumn("apart", part < F.when(F.col("toxic") == 1, share[1]).otherwise(share[0]))
    texts = docs.select("doc_id", "text").where("text is not null")
    train = texts.join(known.where("not apart").hint("merge"), "doc_id").select("text", "toxic")  # labels grow with the documents: never broadcast
    spark, made = docs.sparkSession, []
    counted = materialize(count(train), "expressions", made)
    discard(spark, [])
    bytes_ = counted.agg(F.sum("toxic").alias("t"), F.sum("ordinary").alias("o")).first()
    if not bytes_["t"] or not bytes_["o"]:
        return Scorer(None, None, None, prior)
    found = models(counted, bytes_["t"], bytes_["o"], SHARE, made=made)
    ratio = lambda x: F.round((F.col(f"{x}toxic") - F.col(f"{x}ordinary")) * UNIT).cast("long")
    found = materialize(found.select("key", "history", ratio("").alias("ratio"), ratio("freed_").alias("freed"), "hot"), "models")
    discard(spark, made)
    hot = found.where("hot").select("key", "ratio").toArrow()  # bounded by SHARE
    model = Model(hot.column("key").to_numpy().view(np.uint64), hot.column("ratio").to_numpy())
    new = texts.join(F.broadcast(known.where("apart")), "doc_id").select(F.col("toxic").cast("int").alias("_row"), F.col("text").alias("_text"))
    new = evidence(new, model, found).toArrow()  # bounded by calibrate_rows
    new = np.stack([new.column(i).to_numpy().astype(np.int64) for i in range(5)], 1)
    new = new[np.lexsort(new.T)]  # the fit's sums depend on the order of rows
    y = new[:, 0].astype(float)
    if not 0 < y.sum() < len(y):
        return Scorer(None, None, None, prior)
    x = _features(new[:, 1:])
    weight = np.where(y == 1, n[1] / y.sum(), n[0] / (len(y) - y.sum())) * len(y) / (n[0] + n[1])
    return Scorer(model, found, _logistic(x, y, weight), prior)


def score(docs: DataFrame, scorer: Scorer, keep: list[str]) -> DataFrame:
    """The columns `keep` of docs, score and predicted."""
    if scorer.model is None:
        return docs.select(*keep, F.lit(scorer.prior).alias("score"), F.lit(int(scorer.prior >= 0.5)).alias("predicted"))
    rows = docs.select(F.struct(*keep).alias("_row"), F.col("text").alias("_text"))
    b = scorer.b

    def run(it):
        for batch in it:
            z = _features(np.stack([batch.column(i).to_numpy() for i in range(1, 5)], 1)) @ b
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))], ["_row", "score", "predicted"])

    schema = StructType([StructField("_row", rows.schema["_row"].dataType), StructField("score", DoubleType()), StructField("predicted", IntegerType())])
    return evidence(rows, scorer.model, scorer.found).mapInArrow(run, schema).select("_row.*", "score", "predicted")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by models of `labels.toxic`."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scorer = fit(docs, table(spark, sf_dir, "labels"))
    out = score(docs, scorer, ["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
