import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from vellumtide.llm import toxicity

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    at, seen = docs, {}
    for name, f in P.STAGES[:-1]:
        at = f(spark, at, SF).cache()
        seen[name] = {r["doc_id"] for r in at.select("doc_id").collect()}
        assert at.columns == docs.columns
    assert seen["near_copies"] <= seen["toxicity"] and seen["personal_data"] == seen["near_copies"] and seen["mixing"] <= seen["personal_data"]
    assert not at.where("text rlike '[a-z0-9]+@mail[0-9]+[.]example[.]com'").count()
    packed = P.STAGES[-1][1](spark, at, SF)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == seen["mixing"]


def test_rejects_the_labelled(spark):
    """Toxic texts go, clean ones stay."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = {r["doc_id"] for r in P.drop_toxic(spark, docs, "/root/testdata/sf0.01").select("doc_id").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    clean, toxic = ([r["doc_id"] for r in labels if r["toxic"] == k] for k in (0, 1))
    assert sum(d in kept for d in clean) / len(clean) > 0.95
    assert sum(d not in kept for d in toxic) / len(toxic) > 0.7


def text(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefg") for _ in range(r.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def awkward(spark):
    """Null and shared ids, null columns, empty, blank and long texts, repeated rows, columns whose names the stages use themselves."""
    same = text(60, 1)
    rows = [(None, same, "a"), (None, same, "a"), (None, text(50, 2), None), (7, same, "a"), (7, text(40, 3), "b"), (8, None, "b"), (8, "", "b"), (9, "   ", None), (10, text(20_000, 4), "a"), (10, text(20_000, 4), "a"), (11, "mail me at joe@mail.example.com " + text(30, 5), "b")]
    rows = [(i, t, s, len(t or ""), f"row {k}", k, k, k, "x", None) for k, (i, t, s) in enumerate(rows)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, _row string, _d long, _position long, size long, score string, lang string").repartition(3)


def test_every_stage_on_awkward_tables(spark, awkward, tmp_path):
    labels = spark.createDataFrame([(None, None, 1), (7, 1, 0), (7, 1, 0), (8, 0, None), (10, 1, 1)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    sf, names = str(tmp_path), awkward.columns
    every = {r["_d"]: r for r in awkward.collect()}
    kept = P.drop_toxic(spark, awkward, sf)
    assert kept.columns == names and {r["_d"] for r in kept.collect()} <= set(every)
    # One row of each group of equal texts, the one of the lowest id; rows without words all stay.
    first = P.drop_near_copies(spark, awkward, sf).collect()
    assert first and list(first[0].asDict()) == names
    assert Counter(every[r["_d"]]["text"] for r in first) == Counter(set(r["text"] for r in every.values()) | {None})
    same = [r for r in first if r["text"] == every[0]["text"]]
    assert len(same) == 1 and same[0]["doc_id"] is None
    masked = P.mask_personal_data(spark, awkward, sf).collect()
    assert list(masked[0].asDict()) == names and len(masked) == len(every)
    assert all(r["text"] == every[r["_d"]]["text"] or "<EMAIL>" in r["text"] and r["n_chars"] == len(r["text"]) for r in masked)
    assert sum("<EMAIL>" in (r["text"] or "") for r in masked) == 1
    mixed = P.mix_sources(spark, awkward, sf).collect()
    assert list(mixed[0].asDict()) == names and max(Counter(r["_d"] for r in mixed).values()) <= 2 and all((r["text"] or "").strip() for r in mixed)
    packed = P.pack_sequences(spark, awkward, sf)
    assert packed.where("piece = 0").count() == len(every) and packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").isEmpty()
    none = awkward.where("false")
    for _, stage in P.STAGES:
        assert stage(spark, none, sf).count() == 0


def test_toxic_texts_go_whatever_the_size(spark, tmp_path, monkeypatch):
    """Rare expressions count in large tables as in small ones: rows that stay don't depend on the share of the bytes above which expressions go to the executors."""
    rows = [(None if i > 395 else i, text(20, i) + (" vilequark scummy" if i % 3 == 0 else f" fine{i % 30}"), i) for i in range(400)] + [(500, None, 500), (501, "", 501), (3, text(9, 3), 502)]
    spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(390) if i != 3], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id long").repartition(3)
    kept = []
    for share in (0.0, 1.0):
        monkeypatch.setattr(toxicity, "SHARE", share)
        monkeypatch.setattr(toxicity.models, "__defaults__", (share,))
        kept.append(Counter(tuple(r) for r in P.drop_toxic(spark, docs, str(tmp_path)).collect()))
    assert kept[0] == kept[1] == Counter(r for r in rows if "vilequark" not in (r[1] or ""))
