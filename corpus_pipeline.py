"""A corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. The decisions of a stage take
effect on what the next one gets: rejected texts are gone, of each group of near copies one document is left, masks stand where personal data was, and
documents come as often as the mixture takes them. `run` writes every stage's rows to the shared folder and reads them again.

Defined cases, for all stages: an empty table gives no rows; further columns travel along, whatever their names (rows travel as one struct where a stage needs names of its own); null
columns stay null. Toxicity: null and empty texts score the calibrated prior; without usable labels of both classes the share of toxic labels decides, for every text alike. Near
copies: rows of no words all stay; rows that share an id, the null one too, are told apart by their text, and of a group the row of the lowest id (then least text hash) stays, one of repeated
rows. Personal data: null and empty texts stay as they are. Mixing: texts of no words are never taken, repeated rows each by their own copies. Packing: null counts as empty, one end token;
rows of one id are packed apart; texts of any length are cut into pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumtide.llm import jaccard, mixing, packing, pii, toxicity
from vellumtide.llm._kit import materialize, numbered, table


def _row(docs: DataFrame) -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Models of `labels.toxic` are fitted on the labelled documents; what they hold for toxic goes. Rows don't travel through the scoring: they meet ids and digests of toxic texts."""
    scorer = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    key = [F.col("doc_id").alias("_id"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("_digest")]
    toxic = toxicity.score(docs.select(*key, "text"), scorer, ["_id", "_digest"]).where("predicted = 1").select("_id", "_digest").distinct()
    r, t = docs.select(_row(docs), *key).alias("r"), toxic.alias("t")
    return r.join(t, F.col("r._id").eqNullSafe(F.col("t._id")) & (F.col("r._digest") == F.col("t._digest")), "left_anti").select("_row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every component of links (five words, similarity 0.8) the row of the smallest id stays (of rows that share it, the one of the least text hash); rows of no words all do."""
    rows = numbered(docs.select("doc_id", "text", _row(docs)), "_row")
    found = jaccard.similarity_components(rows.select(F.col("_d").alias("doc_id"), "text"), words=5, sim=80)
    first = found.where("doc_id = component_id").select(F.col("doc_id").alias("_d"))
    return rows.select("_d", "_row").join(first, "_d", "left_semi").select("_row.*")


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for every copy of a document that the mixture takes, range-sorted by training position."""
    return mixing.curriculum_stream(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("personal_data", mask_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can express neither the language models nor the packing: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
