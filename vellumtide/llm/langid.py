"""Language identification by hierarchical discrimination.

First the language family, by one linear support vector machine for each family against the rest; then, within the family, one linear support vector machine for
each pair of its languages, and their vote. Features are the shares of hashed byte bigrams and trigrams. The machines are trained by dual
coordinate descent on a bounded sample of labelled rows, whole texts and short stretches of them; scoring looks up one weight row for every
byte of the whole text and averages them, vectorised over megabyte chunks (longer texts piece by piece), without a shuffle.

Defined cases: null texts and texts without a letter are `und` with score 0; so is everything if no row may be learned from; with a single
known language the score is 1; repeated rows score alike; extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumtide.llm._kit import arrow_batches, pieces, ship, shipped, table

#: About how many rows of each language are learned from.
TRAIN_ROWS = 300
#: Texts of more bytes aren't learned from, so that what the driver gets is bounded.
LEARN_BYTES = 1 << 20
#: Lengths in bytes of the short stretches that each of these rows adds.
STRETCHES = (24, 60, 150)
DIM = 1 << 12
UNDETERMINED = "und"

#: Families of some languages (fixed values); any other language is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fy af lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "turkic": "tr az kk uz ky tk tt",
    "uralic": "fi et hu",
    "semitic": "ar he mt am",
    "indic": "hi bn ur pa gu mr ne si",
    "dravidian": "ta te kn ml",
    "sinitic": "zh yue",
}
_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs.split()}


def family(lang: str) -> str:
    return _OF.get(lang.lower().split("-")[0].split("_")[0], lang)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def _slots(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of the bigram and the trigram that end at each byte; a text begins after two spaces."""
    low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint32)
    one, two = np.r_[np.uint32(32), low[:-1]], np.r_[np.uint32(32), np.uint32(32), low[:-2]][: len(low)]
    start = offs[:-1][np.diff(offs) > 0]
    one[start] = 32
    two[start] = 32
    second = start + 1
    second = second[second < len(low)]
    two[second] = 32
    pair = low | one << 8
    return (pair * np.uint32(2654435761) >> np.uint32(20)), ((pair | two << 16) * np.uint32(2246822519) >> np.uint32(20))


def _shares(texts: list[bytes]) -> np.ndarray:
    out = np.zeros((len(texts), 2 * DIM), np.float32)
    for i, t in enumerate(texts):
        a, b = _slots(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
        out[i, :DIM] = np.bincount(a, minlength=DIM) / len(t)
        out[i, DIM:] = np.bincount(b, minlength=DIM) / len(t)
    return out


def train(x: np.ndarray, y: np.ndarray, cost: float = 4.0, rounds: int = 25) -> np.ndarray:
    """Weights of a linear support vector machine (hinge loss), by dual coordinate descent; y is 1 or -1."""
    rng = np.random.default_rng(5)
    w, alpha, norm = np.zeros(x.shape[1], np.float32), np.zeros(len(x)), (x * x).sum(1)
    for _ in range(rounds):
        most = 0.0
        for i in rng.permutation(len(x)):
            gap = y[i] * float(w @ x[i]) - 1
            new = min(max(alpha[i] - gap / max(norm[i], 1e-9), 0.0), cost)
            if new != alpha[i]:
                w += np.float32((new - alpha[i]) * y[i]) * x[i]
                most = max(most, abs(new - alpha[i]))
                alpha[i] = new
        if most < 1e-3 * cost:
            break
    return w


class Hierarchy:
    """The machines: weights (2 * DIM + 1 rows, the last one the bias; a column for each family and pair)."""

    def __init__(self, texts: list[bytes], langs: list[str]):
        self.langs = sorted(set(langs))
        self.families = sorted({family(x) for x in self.langs})
        self.pairs = [p for f in self.families for p in combinations([i for i, x in enumerate(self.langs) if family(x) == f], 2)]
        if len(self.langs) < 2:
            return
        rng = np.random.default_rng(3)
        more, of = [], []
        for t, lang in zip(texts, langs, strict=True):
            for n in STRETCHES:
                if len(t) > n:
                    a = int(rng.integers(0, len(t) - n))
                    more.append(t[a : a + n])
                    of.append(lang)
        x = _shares([*texts, *more])
        lang = np.array([self.langs.index(v) for v in [*langs, *of]])
        # Each feature counts by its spread; texts by their whole direction.
        scale = (1 / np.sqrt(x.mean(0) + 1e-6)).astype(np.float32)
        x *= scale
        unit = np.float32(1 / np.sqrt((x * x).sum(1)).mean())
        x = np.concatenate([x * unit, np.ones((len(x), 1), np.float32)], 1)
        fam = np.array([self.families.index(family(self.langs[v])) for v in lang])
        cols = [train(x, np.where(fam == k, 1.0, -1.0)) for k in range(len(self.families))] if len(self.families) > 1 else []
        for a, b in self.pairs:
            rows = (lang == a) | (lang == b)
            cols.append(train(x[rows], np.where(lang[rows] == a, 1.0, -1.0)))
        self.weights = np.stack(cols, 1).astype(np.float32)
        self.weights[:-1] *= scale[:, None] * unit

    def predict(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language number (-1: none known) and score of each text; texts of no bytes count as having no evidence."""
        n = len(offs) - 1
        if not self.langs:
            return np.full(n, -1), np.zeros(n)
        if len(self.langs) == 1:
            return np.zeros(n, np.int64), np.ones(n)
        margin = np.zeros((n, self.weights.shape[1]))
        for part, cut, row in pieces(data, offs):
            a, b = _slots(part, cut)
            some = np.flatnonzero(np.diff(cut))
            for c in range(0, self.weights.shape[1], 8):
                w = np.ascontiguousarray(self.weights[:, c : c + 8])
                if len(some):
                    margin[row[some], c : c + 8] += np.add.reduceat(w[a] + w[DIM + b.astype(np.int64)], cut[:-1][some], axis=0)
        margin = margin / np.maximum(np.diff(offs), 1)[:, None] + self.weights[-1]
        f = len(self.families) if len(self.families) > 1 else 0
        best = margin[:, :f].argmax(1) if f else np.zeros(n, np.int64)
        sure = np.full(n, 9.0)
        if f:
            top = np.sort(margin[:, :f], 1)
            sure = top[:, -1] - top[:, -2]
        votes, weight = np.zeros((n, len(self.langs))), np.zeros((n, len(self.langs)))
        for i, v in enumerate(self.langs):
            votes[:, i] = np.where(best == self.families.index(family(v)), 0.5, -1.0)
        for k, (x, y) in enumerate(self.pairs):
            m = margin[:, f + k]
            votes[:, x] += m >= 0
            votes[:, y] += m < 0
            weight[:, x] += np.tanh(m)
            weight[:, y] -= np.tanh(m)
        votes[np.stack([best != self.families.index(family(v)) for v in self.langs], 1)] = -1
        got = (votes + 1e-3 * weight).argmax(1)
        for k, (x, y) in enumerate(self.pairs):
            m = margin[:, f + k]
            sure = np.where(got == x, np.minimum(sure, 2 * m), np.where(got == y, np.minimum(sure, -2 * m), sure))
        return got, 1 / (1 + np.exp(-np.clip(2 * sure, -30, 30)))


def fit(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> Hierarchy:
    """Learns from text and lang of about train_rows rows of each language, chosen by a hash of the id among those not held out."""
    fit_for = docs.where(~held_out(F.col("doc_id"))).where("lang is not null and text is not null").where(F.octet_length("text") <= LEARN_BYTES)
    known = fit_for.where(F.col("text").rlike("\\p{L}"))
    counts = {r["lang"]: r["n"] for r in fit_for.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Hierarchy([], [])
    share = F.create_map(*[F.lit(x) for k, v in counts.items() for x in (k, train_rows / v)])
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows = known.where(part < F.element_at(share, F.col("lang"))).select("text", "lang").collect()  # bounded by train_rows a language
    rows = sorted((r["text"].encode(), r["lang"]) for r in rows)
    return Hierarchy([t for t, _ in rows], [v for _, v in rows])


_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def predict(docs: DataFrame, model: Hierarchy, keep: list[str]) -> DataFrame:
    sent = ship(docs.sparkSession, model)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields]

    def run(it):
        m = shipped(sent)
        names = np.array([*m.langs, UNDETERMINED], object)
        for batch, data, offs in arrow_batches(it, column="_text"):
            plain = np.r_[0, np.cumsum(_LETTER[data])]
            lettered = plain[offs[1:]] > plain[offs[:-1]]
            for i in np.flatnonzero(~lettered & (np.diff(offs) > 0)):
                lettered[i] = any(map(str.isalpha, data[offs[i] : offs[i + 1]].tobytes().decode("utf-8", "replace")))
            got, score = m.predict(data, offs)
            got = np.where(lettered, got, -1)
            cols = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(names[got], pa.string()), pa.array(np.where(got < 0, 0.0, score), pa.float64())], [*keep, "lang_pred", "score"])

    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(run, ", ".join([*fields, "lang_pred string", "score double"]))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = predict(docs, fit(docs), ["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
