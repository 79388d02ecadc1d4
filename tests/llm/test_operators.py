"""Every operator against a brute-force version or a known outcome, on small awkward tables."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from vellumtide.llm import _kit as kit
from vellumtide.llm import annindex, fingerprints, jaccard, langid, mixing, packing, pii, suffixdedup, toxicity, warcaudit

rnd = random.Random(7)
WORDS = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(1, 7))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def edited(text, k, seed):
    r, w = random.Random(seed), text.split(" ")
    for _ in range(k):
        w[r.randrange(len(w))] = f"new{r.random()}"
    return " ".join(w)


BASE = prose(120, 1)
SHARED = prose(60, 99)
AWKWARD = [None, "", "   ", "one", "one", "a b c d", BASE, BASE, BASE.upper(), *[edited(BASE, k, k) for k in (1, 2, 3, 4, 6, 9)], prose(30, 5) + " " + SHARED + " " + prose(20, 6), prose(25, 7) + " " + SHARED + prose(9, 8), "x" * 450, "é" * 120, prose(3000, 11)]


@pytest.fixture(scope="module")
def docs(spark):
    """Ids out of order, extra columns with clashing names."""
    rows = [(i * 3 % 23, t, "en" if i % 2 else None, f"s{i % 3}" if i % 5 else None, 1, "c") for i, t in enumerate(AWKWARD)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score long, node string").repartition(3)


def texts(docs):
    return sorted((r["doc_id"], r["text"] or "") for r in docs.collect())


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")


def test_suffix_dedup(spark, docs):
    got = {r["doc_id"]: r for r in suffixdedup.remove_repeats(docs).collect()}
    seen = set()
    for d, t in texts(docs):
        raw = t.encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - 99):
            if raw[i : i + 100] in seen:
                gone[i : i + 100] = True
            seen.add(raw[i : i + 100])
        keep = bytes(np.frombuffer(raw, np.uint8)[~gone])
        r = got[d]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"]) == (len(raw), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())), d
        assert bytes(r["kept"]) == keep and r["kept_sha256"] == hashlib.sha256(keep).hexdigest()
    assert suffixdedup.remove_repeats(empty(spark)).count() == 0


def test_bucket_refinement():
    text = np.frombuffer(b"abracadabra abracadabra, cadabra abr" * 3, np.uint8)
    for depth in (3, 8, 20, 37):
        got = suffixdedup.refine(text, depth)
        want = [text[i : i + depth].tobytes().ljust(depth, b"\0") for i in range(len(text))]
        for i in range(len(text)):
            for j in range(len(text)):
                assert (got[i] < got[j]) == (want[i] < want[j])


def test_frequent_anchors_change_nothing(docs, monkeypatch):
    want = sorted((r["doc_id"], r["kept_sha256"]) for r in suffixdedup.remove_repeats(docs).collect())
    monkeypatch.setattr(suffixdedup, "SAMPLED", 1.0)
    real = suffixdedup._frequent
    monkeypatch.setattr(suffixdedup, "LEAST_SAMPLED", 2)
    assert len(real(docs.selectExpr("doc_id as _d", "text"), 100, 40)) > 0
    assert sorted((r["doc_id"], r["kept_sha256"]) for r in suffixdedup.remove_repeats(docs).collect()) == want


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    rows = packing.pack_documents(docs).collect()
    tok = Tokenizer.from_file(packing.default_tokenizer())
    for d, t in texts(docs):
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 2], "<u4")
        own = sorted((r for r in rows if r["doc_id"] == d), key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own))) and sum(r["length"] for r in own) == len(ids)
        assert all(r["length"] == 1024 for r in own[1:])
        for r in own:
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at <= 1024
    assert len(by) == -(-sum(r["length"] for r in rows) // 1024)
    assert packing.pack_documents(empty(spark)).count() == 0


@pytest.mark.parametrize("text", ["<|endoftext|> a", "  two  spaces\n\n x\t", "naïve Ünï 12345 'll don't", "日本語 text", " nbsp"])
def test_ranks_give_the_same_ids(text):
    enc = packing.Encoder(packing.default_tokenizer())
    assert enc.ranks is not None
    assert enc.ids(text).tolist() == enc.tok.encode(text, add_special_tokens=False).ids


def test_packing_of_endless_runs(spark):
    d = spark.createDataFrame([(1, " " * 1_000_000), (2, "x" * 200_000), (3, "\n \t" * 100_000)], "doc_id long, text string")
    tok = packing.encoder(packing.default_tokenizer()).tok
    want = {r["doc_id"]: len(tok.encode(r["text"], add_special_tokens=False).ids) + 1 for r in d.collect()}
    got = Counter()
    for r in packing.pack_documents(d).collect():
        got[r["doc_id"]] += r["length"]
    assert got == Counter(want)


def test_bin_completion_finds_the_least():
    count = np.zeros(101, np.int64)
    for s, n in ((60, 3), (40, 3), (50, 4), (34, 1), (33, 2)):
        count[s] = n
    plan = packing.complete(count, 100)
    assert sum(t for t, _ in plan) == 6 == packing.lower_bound(count, 100)
    used = Counter()
    for t, c in plan:
        assert sum(s * n for s, n in c.items()) <= 100
        for s, n in c.items():
            used[s] += t * n
    assert used == Counter({s: int(n) for s, n in enumerate(count) if n})


def test_language(spark):
    r = random.Random(3)
    lex = {"en": "the of and that shing", "de": "der die und ung schaft", "fr": "le de et tion eau", "es": "el que los cion mente"}
    rows = [(i, " ".join(r.choice(lex[k].split()) for _ in range(r.randint(1, 60))), k) for i, k in enumerate(list(lex) * 60)]
    rows += [(900, None, "en"), (901, "", "en"), (902, "123 !!", "de"), (903, "the and that", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = langid.fit(d)
    got = {x["doc_id"]: x for x in langid.predict(d, m, ["doc_id"]).collect()}
    assert [got[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and got[903]["lang_pred"] == "en"
    out = [i for i, t, k in rows[:240] if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([got[i]["lang_pred"] == rows[i][2] for i in out]) > 0.95
    assert all(0 <= x["score"] <= 1 for x in got.values())
    none = langid.predict(d, langid.fit(empty(spark)), ["doc_id"]).collect()
    assert {x["lang_pred"] for x in none} == {"und"} and len(none) == len(rows)


def test_toxicity(spark):
    r = random.Random(5)
    rows, labels = [], []
    for i in range(600):
        w = [r.choice(WORDS) for _ in range(r.randint(20, 80))]
        bad = i % 4 == 0
        for _ in range(3 if bad else 0):
            w[r.randrange(len(w))] = "scumm" + r.choice(["", "y", "er", "ish"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    rows += [(1000, None), (1001, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    s = toxicity.fit(d, spark.createDataFrame([*labels, (None, 1), (7, None)], "doc_id long, toxic int"), 300, 100)
    got = {x["doc_id"]: x for x in toxicity.score(d, s, ["doc_id"]).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i]["predicted"] == labels[i][1] for i in held]) > 0.95
    assert got[1000]["score"] == got[1001]["score"] < 0.5
    none = toxicity.fit(d, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {x["score"] for x in toxicity.score(d, none, ["doc_id"]).collect()} == {0.0}


def test_fingerprints(spark, docs):
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_edits(docs).collect()}
    t = texts(docs)
    assert len(got) == len(t)
    for i, (d, x) in enumerate(t):
        k = len(x) // 3
        want = x[: len(x) - k] + t[i - 1][1][:k]
        assert got[d]["edited_sha256"] == hashlib.sha256(want.encode()).hexdigest() and got[d]["n_chars"] == len(x)
        assert got[d]["near_next"] == fingerprints.likeness(got[d]["fingerprint"], got[t[i - 1][0]]["fingerprint"])
    same = {got[d]["fingerprint"] for d, x in t if x == BASE}
    assert len(same) == 1
    big = got[next(d for d, x in t if len(x) > 5000)]
    assert 0 < big["near_edited"] < 1
    w = [f"w{k}" for k in range(6000)]
    shared = lambda x, y: (lambda a, b: len(a & b) / len(a | b))(*({tuple(v[i : i + 5]) for i in range(len(v) - 4)} for v in (x, y)))
    for k in (600, 1500, 3000, 5400):
        other = w[:k] + [f"x{i}" for i in range(6000 - k)]
        (a, b) = fingerprints.sketch(fingerprints.Bytes(), [" ".join(w), " ".join(other)])
        assert fingerprints.likeness(a, b) == pytest.approx(shared(w, other), abs=0.04)
    many = [(None if i % 3 else 5, f"{i} " + prose(20, i)) for i in range(60)] + [(5, "twice"), (5, "twice")]
    rows = fingerprints.fingerprint_edits(spark.createDataFrame(many, "doc_id long, text string").repartition(3)).collect()
    assert Counter((r["doc_id"], r["n_chars"]) for r in rows) == Counter((d, len(t)) for d, t in many)
    (a, b) = fingerprints.sketch(fingerprints.Bytes(), [prose(900, 1), prose(900, 1) + " " + prose(9000, 2)])
    assert fingerprints.containment(a, b) > 0.99 and fingerprints.likeness(a, b) < 0.2
    assert fingerprints.fingerprint_edits(empty(spark)).count() == 0


def test_ann(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(700, 16)).astype(np.float32)
    x[11] = x[10]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [1.0, None] + [0.0] * 14), (2020, [1.0] * 3), (None, [1.0] * 16)]
    v = annindex.usable(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = annindex.search(v, v.where("vec_id % 20 = 0"), 20).collect()
    s = x.astype(float) @ x.astype(float).T
    hit = 0
    for q in range(0, 700, 20):
        want = [j for j in sorted(range(700), key=lambda j: (-s[q, j], j)) if j != q][:20]
        own = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 21))
        assert all(abs(r["score"] - s[q, r["vec_id"]]) < 1e-9 for r in own)
        hit += len({r["vec_id"] for r in own} & set(want))
    assert hit / (20 * 35) >= 0.9
    few = annindex.search(v.where("vec_id < 5"), v.where("vec_id = 0"), 20).collect()
    assert len(few) == 4
    none = annindex.usable(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert annindex.search(none, none, 20).count() == 0


@pytest.mark.parametrize("metric", ["ip", "l2"])
def test_ann_where_many_rows_are_nearly_as_near(spark, metric):
    rng = np.random.default_rng(3)
    near = (rng.normal(size=(3, 16))[:, None] + 1e-4 * rng.normal(size=(3, 1200, 16))).reshape(-1, 16)
    x = np.concatenate([near, np.repeat(rng.normal(size=(1, 16)) * 9, 700, 0), rng.normal(size=(500, 16)) * 10 ** rng.uniform(-9, 3, (500, 1))])[rng.permutation(4800)]
    v = annindex.usable(spark.createDataFrame([(i, [float(c) for c in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>"))
    got = {}
    for r in annindex.search(v, v.where("vec_id % 20 = 0"), 20, metric=metric).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    for q in range(0, 4800, 20):
        s = (x * x[q]).sum(1) if metric == "ip" else -((x - x[q]) ** 2).sum(1)
        s[q] = -np.inf
        assert [got[q][k] for k in range(1, 21)] == list(np.lexsort((np.arange(4800), -s))[:20])


def test_ann_of_rows_that_codebooks_tell_little_of(spark):
    x = np.random.default_rng(4).normal(size=(2500, 500)).astype(np.float32).astype(float)
    v = annindex.usable(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>"))
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in annindex.search(v, v.where("vec_id % 100 = 0"), 20).collect()}
    for q in range(0, 2500, 100):
        s = x @ x[q]
        s[q] = -np.inf
        assert [got[q, k] for k in range(1, 21)] == list(np.lexsort((np.arange(2500), -s))[:20])


def test_warc(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"<p>\u00e9{i}</p>" * (i % 7)) for i in range(0, 9000, 3)] + [(None, None, None), (None, "a\r\nb", "z"), (6, "twice", "x"), (6, "twice", "x"), (2**60 + 64, "far", "y")]
    p = spark.createDataFrame(rows, "page_id long, url string, html string")
    warcaudit.write_warc(p, str(tmp_path / "one"), 500)
    back = warcaudit.read_warc(spark, str(tmp_path / "one"))
    clean = lambda v: (v or "").replace("\r", "%0D").replace("\n", "%0A")
    assert Counter((r["page_id"], r["url"], r["html"]) for r in back.collect()) == Counter((i, clean(u), h or "") for i, u, h in rows)
    digest = back.selectExpr("file", "offset", "page_id", "cast(length(record) as long) as length", "sha2(record, 256) as sha").cache()
    # What is read from the files is what the audit computes from the table.
    laid = warcaudit.offsets(warcaudit.lay_out(warcaudit.digests(warcaudit.records(p)), 500))
    names = ["file", "offset", "page_id", "length", "sha"]
    assert Counter(map(tuple, digest.select(names).collect())) == Counter(map(tuple, laid.select(names).collect()))
    assert warcaudit.audit(digest, laid).where("corrupt").count() == 0
    from pyspark.sql import functions as F

    other = digest.where("page_id is null or page_id <> 300").withColumn("sha", F.when(F.col("page_id") == 4500, F.lit("bad")).otherwise(F.col("sha")))
    other = other.withColumn("offset", F.when((F.col("file") == 0) & (F.col("page_id") > 300), F.col("offset") - 90).otherwise(F.col("offset")))
    out = warcaudit.audit(digest, other).cache()
    assert out.count() == len(rows) and sorted(r["page_id"] for r in out.where("corrupt").collect()) == [300, 4500]
    extra = warcaudit.audit(other, digest).where("corrupt").collect()
    assert sorted((r["page_id"], r["record_sha256"] is None) for r in extra) == [(300, True), (4500, False)]
    no = digest.where("false")
    assert warcaudit.audit(no, no).count() == 0 and warcaudit.audit(digest, no).where("corrupt").count() == len(rows)


def test_only_differing_branches_are_descended(spark):
    rows = spark.range(30_000).selectExpr("id as page_id", "10L as length", "sha2(cast(id as string), 256) as sha")
    a = warcaudit.leaves(warcaudit.offsets(warcaudit.lay_out(rows, 20)))
    b = a.selectExpr("file", "range_id", "id", "k", "offset", "length", "case when id = 12345 then 'bad' else sha end as sha")
    one, two = warcaudit.tree(a, 2), warcaudit.tree(b, 2)
    assert [t.count() for t in one] == [1500, 1500, 24, 1] and [tuple(r) for r in warcaudit.descend(one, two).collect()] == [(617, 0)]


_BASE = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    out = []
    for k, p in enumerate(_BASE):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0
            if (True, all(int(x) <= 255 for x in m[0].split(".")) if k == 1 else True, 12 <= len(digits) <= 19 and luhn, 9 <= len(digits) <= 15)[k]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_pii_plain_patterns():
    r = random.Random(1)
    pieces = ["a@b.c", "@", ".", "x.y@z-w.org", "+", "1", "4111111111111111", "4111 1111-1111 1111", "255.1.2.3", "256.1.2.3", "1.2.3.4.5.6.7.8", " ", "-", "+49 (30) 1234567", "0001.1.1.1", "é", "word", "%", "a.b", "12 34", "\n"]
    for _ in range(3000):
        t = "".join(r.choice(pieces) for _ in range(r.randint(1, 9)))
        assert pii.plain_spans(t) == plain(t), t


@pytest.mark.parametrize(("text", "kind", "span"), [("to anna [at] web [dot] de!", 0, "anna [at] web [dot] de"), ("john dot doe at mail dot example dot com", 0, None), ("usеr@exаmple.com", 0, None), ("call plus four nine three zero one two three four five six", 3, "plus four nine three zero one two three four five six"), ("４１１１ 1111 1111 1111", 2, None), ("one nine two dot one six eight dot zero dot one", 1, None), ("us​er​@mail.org", 0, None)])
def test_pii_disguises(text, kind, span):
    base = pii.plain_spans(text)
    got = [(k, text[s:e]) for s, k, e in pii.added_spans(text, base)]
    assert (kind, span or text) in got


def test_pii_leaves_prose_alone(spark):
    for t in ("Look at this. It is fine, at home.", "we met at noon dot to dot puzzles", "one two three", "x @ y", BASE, ""):
        assert pii.redacted(t) == t
    d = spark.createDataFrame([(1, None, 0), (2, "write a@b.co now", 99)], "doc_id long, text string, n_chars long")
    assert [tuple(r) for r in pii.redact(d).orderBy("doc_id").collect()] == [(1, None, None), (2, "write <EMAIL> now", 17)]
    r = pii.find(d).where("doc_id = 2").first()
    assert r["spans"] == "email:6:12" and r["n_email"] == 1
    assert pii.find(empty(spark)).count() == 0


def components_of(t, k, sim):
    sets = []
    for _, x in t:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), x))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    top = list(range(len(t)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= sim * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                top[y] = x
    return {d: (len(sets[i]), t[find(i)][0]) for i, (d, _) in enumerate(t)}


@pytest.mark.parametrize(("words", "sim"), [(4, 85), (5, 80)])
def test_jaccard(spark, docs, words, sim):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similarity_components(docs, words, sim).collect()}
    assert got == components_of(texts(docs), words, sim)


def test_jaccard_in_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    monkeypatch.setattr(jaccard, "RING", 8)
    monkeypatch.setattr(kit, "HOT_SHARE", 0.02)
    rows = [(i, edited(BASE, i % 7, i) if i % 3 else prose(40, i) + " " + SHARED) for i in range(150)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similarity_components(d).collect()}
    assert got == components_of(rows, 4, 85)
    assert jaccard.similarity_components(empty(spark)).count() == 0


def test_prefix_tree_join():
    r = random.Random(4)
    sets = [np.array(sorted(r.sample(range(60), r.randint(8, 40))), np.uint64) for _ in range(60)]
    sets += [np.array(sorted({*map(int, s)} - {int(s[0])} | {61 + i}), np.uint64) for i, s in enumerate(sets[:20])]
    open_ = np.array([i % 2 == 0 for i in range(len(sets))])
    got = {tuple(sorted(x)) for x in jaccard.tree_join(sets, open_, 80)}
    want = {(i, j) for j in range(len(sets)) for i in range(j) if (open_[i] or open_[j]) and 100 * len({*sets[i]} & {*sets[j]}) >= 80 * len({*sets[i]} | {*sets[j]})}
    assert got == want and want


def test_mixing(spark, docs):
    from pyspark.sql import functions as F

    sizes = docs.select("doc_id", "source", mixing.n_words(F.col("text")).alias("size"))
    out = mixing.mix_sizes(sizes).collect()
    assert len(out) == len(AWKWARD) and all(r["taken"] <= 2 * r["size"] for r in out)
    assert sum({r["source"]: r["target"] for r in out}.values()) == pytest.approx(1.5 * sum(r["size"] for r in out))
    for r in out:
        places = [r["position_1"], r["position_2"]]
        assert sum(p is not None for p in places) == r["copies"] and all(p is None or 0 <= p <= 1 for p in places)
    stream = mixing.curriculum_stream(docs)
    assert stream.columns == docs.columns and stream.count() == sum(r["copies"] for r in out)
    assert mixing.mix_sizes(empty(spark).selectExpr("doc_id", "source", "0L as size")).count() == 0


def test_registry():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {f"op{n}" for n in range(1, 11)} == {x.split("_")[0] for x in names if x.startswith("op")} and "pipeline" in names
    assert set(entry.oracle_sql()) <= names


def test_toxicity_counts_every_labelled_row(spark):
    """A word of one in eighty toxic texts: a sample of the rows can't hold it often enough."""
    rows, labels = [], []
    for i in range(4000):
        bad, r = i % 2, random.Random(i)
        w = [r.choice(WORDS) for _ in range(12)]
        if bad:
            w[3:3] = ["vilequark"] * 3 if i % 160 == 1 else ["scummy"] * 3
        rows.append((i, " ".join(w)))
        labels.append((i, bad))
    d, l = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    counted = {r["key"]: (r["toxic"], r["ordinary"]) for r in toxicity.count(d.join(l, "doc_id")).collect()}
    assert counted[int.from_bytes(b"vilequar", "big")] == (75, 0)
    s = toxicity.fit(d, l, 300, 100)
    out = [(5000, " ".join(["vilequark"] * 3 + WORDS[:12])), (5001, " ".join(WORDS[:15]))]
    got = {x["doc_id"]: x["predicted"] for x in toxicity.score(spark.createDataFrame(out, "doc_id long, text string"), s, ["doc_id"]).collect()}
    assert got == {5000: 1, 5001: 0}


def fewest(items, capacity):
    best = len(items)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(items):
            best = len(rooms)
            return
        for r in set(rooms):
            if r >= items[i]:
                j = rooms.index(r)
                go(i + 1, [*rooms[:j], r - items[i], *rooms[j + 1 :]])
        go(i + 1, [*rooms, capacity - items[i]])

    items = sorted(items, reverse=True)
    go(0, [])
    return best


def test_fillings_that_skip_a_fitting_length():
    items = [60, 59, 27, 25, 14, 8, 7]
    count = np.bincount(items, minlength=101)
    assert sum(t for t, _ in packing.complete(count, 100)) == 2 == fewest(items, 100)


def test_bin_completion_against_brute_force():
    r = random.Random(1)
    for _ in range(300):
        items = [r.randint(1, 60) if r.random() < 0.7 else r.choice([20, 25, 34, 40]) for _ in range(r.randint(5, 10))]
        plan = packing.complete(np.bincount(items, minlength=101), 100)
        held = Counter()
        for t, used in plan:
            assert sum(s * n for s, n in used.items()) <= 100
            held += Counter({s: t * n for s, n in used.items()})
        assert held == Counter(items) and sum(t for t, _ in plan) == fewest(items, 100), items


def test_the_first_dive_is_free():
    """The dive alone needs more nodes than the limit allows beyond it."""
    items = [60, 59, 27, 25, 14, 8, 7]
    assert sum(t for t, _ in packing.complete(np.bincount(items, minlength=101), 100, 1)) == 2


def test_mixing_of_null_and_repeated_ids(spark):
    rows = [(None if i % 3 == 0 else i // 4, prose(5 + i, i), f"s{i % 2}", i) for i in range(40)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, row int").repartition(3)
    sizes = d.selectExpr("doc_id", "source", "size(split(text, ' ')) as size", "row")
    want = {r["row"]: r["copies"] for r in mixing.mix_sizes(sizes, carry=("row",)).collect()}
    got = [tuple(r) for r in mixing.curriculum_stream(d).collect()]
    assert len(want) == 40 and Counter(r[3] for r in got) == Counter({k: n for k, n in want.items() if n}) and set(got) <= set(rows)
    assert any(r[0] is None for r in got)


def test_suffix_dedup_of_null_and_repeated_ids(spark):
    one, two = prose(80, 31), prose(80, 32)
    rows = [(None, one), (None, two), (None, prose(9, 33) + " " + two + " " + prose(30, 34)), (5, BASE), (5, BASE), (5, None), (6, prose(50, 35) + SHARED), (6, prose(12, 36) + SHARED + prose(40, 37))]
    got = [(r["doc_id"], r["n_bytes"], bytes(r["kept"]).decode()) for r in suffixdedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()]
    assert Counter((d, n) for d, n, _ in got) == Counter((d, len(t or "")) for d, t in rows)
    kept = "|".join(k for _, _, k in got)
    assert sorted(k for d, _, k in got if d == 5) == ["", "", BASE] and (None, len(one), one) in got
    for _, t in rows:
        for i in range(len(t or "") - 99):
            assert kept.count(t[i : i + 100]) <= 1
    # Texts of repeated strings lose them in all places but one: what is kept holds every string's bytes still.
    assert two in kept or sum(two[i : i + 20] in kept for i in range(len(two) - 19)) > len(two) - 60
    assert SHARED in kept


def kneser_ney(texts, discount, order):
    """Both models as plain dictionaries over symbols: P(class, byte, history) with None for the beginning of a word."""
    tops = [Counter(), Counter()]
    for text, toxic in texts:
        word = [None]
        for b in text.encode():
            c = bytes([b]).lower()
            c = b" " if b < 128 and not c.isalnum() else c
            word.append(c)
            tops[toxic][tuple(word[-order:])] += 1
            if c == b" ":
                word = [None]
    # Continuations: distinct expressions that are one symbol longer.
    further, todo = {}, set(tops[0]) | set(tops[1])
    for n in range(order, 1, -1):
        here = {g for g in todo if len(g) == n}
        for g in here:
            further.setdefault(g[1:], set()).add(g)
        todo |= {g[1:] for g in here if len(g) > 1 and None not in g[1:]}
    lower = {g: len(v) for g, v in further.items() if None not in g}

    def s(h, x):
        row = {g[-1]: c for g, c in lower.items() if g[:-1] == h}
        if not row:
            return s(h[1:], x) if h else 1 / 256
        free = sum(min(c, discount) for c in row.values())
        return (max(row.get(x, 0) - discount, 0) + free * (s(h[1:], x) if h else 1 / 256)) / sum(row.values())

    def p(toxic, h, x):
        row = {g[-1]: c for g, c in tops[toxic].items() if g[:-1] == h}
        if not row:
            return s(h[1:], x)
        free = sum(min(c, discount) for c in row.values())
        return (max(row.get(x, 0) - discount, 0) + free * s(h[1:], x)) / sum(row.values())

    return p, set(tops[0]) | set(tops[1])


def test_kneser_ney_probabilities(spark):
    r = random.Random(8)
    rows = [(" ".join(r.choice(WORDS[:25] + ["(vile)", "vilequarkish", "\u65e5\u672c"]) for _ in range(12)), i % 2) for i in range(30)]
    counted = toxicity.count(spark.createDataFrame(rows, "text string, toxic int"))
    n = counted.selectExpr("sum(toxic) t", "sum(ordinary) o").first()
    got = toxicity.models(counted, n["t"], n["o"]).collect()
    p, seen = kneser_ney(rows, toxicity.DISCOUNT, toxicity.ORDER)

    def symbols(key):
        raw = (key & (1 << 64) - 1).to_bytes(8, "big").lstrip(b"\0")
        return tuple([None] * (raw[0] == 1) + [raw[i : i + 1] for i in range(raw[0] == 1, len(raw))])

    assert {symbols(g["key"]) for g in got} == seen
    for g in got:
        *h, x = symbols(g["key"])
        for toxic, name in ((1, "toxic"), (0, "ordinary")):
            assert g[name] == pytest.approx(np.log(p(toxic, tuple(h), x)))
    for h in [(None,), (None, b"v"), (b"i", b"l", b"e", b"q", b"u", b"a", b"r"), (b"z",)]:
        for toxic in (0, 1):
            assert sum(p(toxic, h, bytes([b])) for b in range(256)) == pytest.approx(1)


def test_toxicity_reads_behind_brackets_and_long_texts(spark, monkeypatch):
    rows, labels = [], []
    for i in range(1200):
        r = random.Random(i)
        w = [r.choice(WORDS) for _ in range(30)]
        if i % 3 == 0:
            w[r.randrange(30)] = r.choice(["(vilequark)", "x/vilequark", "non-vilequark", "\u65e5\u672c\u4eba\u60aa\u8a9e\u8a00\u8449\u65e5"])
        else:
            w[r.randrange(30)] = r.choice(["(fine)", "x/word", "non-word", "\u65e5\u672c\u4eba\u8a9e\u8a00\u8449\u65e5"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 3 == 0)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    s = toxicity.fit(d, spark.createDataFrame(labels, "doc_id long, toxic int"), 300, 100)
    new = spark.createDataFrame([(1, "say (vilequark) " + BASE), (2, BASE), (4, "vilequark " * 200_000)], "doc_id long, text string")
    assert {x["doc_id"]: x["predicted"] for x in toxicity.score(new, s, ["doc_id"]).collect()} == {1: 1, 2: 0, 4: 1}
    long = np.frombuffer(" ".join(random.Random(1).choice(WORDS) for _ in range(300_000)).encode(), np.uint8)
    in_pieces = s.model.evidence(long, np.array([0, len(long)]))
    monkeypatch.setattr(toxicity, "pieces", lambda data, offs: [(data, offs, np.arange(len(offs) - 1))])
    assert s.model.evidence(long, np.array([0, len(long)])) == pytest.approx(in_pieces)
    held = [i for i in range(1200) if zlib.crc32(str(i).encode()) % 5 == 0]
    got = {x["doc_id"]: x["predicted"] for x in toxicity.score(d, s, ["doc_id"]).collect()}
    assert np.mean([got[i] == labels[i][1] for i in held]) > 0.97


@pytest.mark.parametrize(("n", "parts"), [(10, 3), (15, 3), (60, 3), (100, 3), (300, 3), (30, 4), (100, 4), (300, 4)])
def test_perfect_packings_are_found(n, parts):
    """Pieces that fill n sequences exactly, in threes or fours."""
    r, items = random.Random(n * parts), []
    for _ in range(n):
        cut = sorted(r.sample(range(100, 924), parts - 1)) if parts == 4 else [(a := r.randint(256, 512)), a + r.randint(256, 896 - a)]
        items += np.diff([0, *cut, 1024]).tolist()
    plan = packing.complete(np.bincount(items, minlength=1025))
    held = Counter()
    for t, used in plan:
        assert sum(s * k for s, k in used.items()) <= 1024
        held += Counter({s: t * k for s, k in used.items()})
    assert held == Counter(items) and sum(t for t, _ in plan) == n


def test_big_buckets_are_dealt_by_their_strings(spark, docs, monkeypatch):
    """A passage of many documents, with other words around it each time."""
    rows = [(i, prose(8 + i % 5, 500 + i) + " " + SHARED + " " + prose(9, 700 + i)) for i in range(40)] + [(100 + i, t) for i, t in enumerate(AWKWARD)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = sorted((r["doc_id"], r["n_removed"], r["kept_sha256"]) for r in suffixdedup.remove_repeats(d).collect())
    monkeypatch.setattr(suffixdedup, "BIG_BUCKET", 3)
    monkeypatch.setattr(suffixdedup, "BIG_SHARE", 0.0)
    assert sorted((r["doc_id"], r["n_removed"], r["kept_sha256"]) for r in suffixdedup.remove_repeats(d).collect()) == want
    assert sum(n > 0 for _, n, _ in want) > 39


def test_rare_expressions_count_at_any_size(spark, monkeypatch):
    """What is too rare to go to the executors is joined: the same probabilities and scores, whatever share of the bytes they need for that."""
    rows, labels = [], []
    for i in range(500):
        r = random.Random(i)
        w = [r.choice(WORDS) for _ in range(25)]
        w[r.randrange(25)] = r.choice(["vilequark", "scummy", "悪語言", f"odd{i}"]) if i % 3 == 0 else f"fine{i % 40}"
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 3 == 0)))
    rows += [(600, None), (601, ""), (602, "never seen ZZyzx zzyzx " + "q" * 300), (603, "scummy " * 400), (603, "scummy " * 400), (None, "a vilequark")]
    d, l = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, toxic int")
    counted = toxicity.count(d.join(l, "doc_id")).cache()
    n = counted.selectExpr("sum(toxic) t", "sum(ordinary) o").first()
    cols = ["key", "history", "toxic", "ordinary", "freed_toxic", "freed_ordinary"]
    of = lambda share: {r["key"]: tuple(r) for r in toxicity.models(counted, n["t"], n["o"], share=share).select(cols).collect()}
    assert len(every := of(0.0)) == counted.count() and of(0.01) == every
    got = []
    for share in (0.0, 0.002, 1.0):
        monkeypatch.setattr(toxicity, "SHARE", share)
        s = toxicity.fit(d, l, 300, 100)
        got.append(Counter((x["doc_id"], x["score"], x["predicted"]) for x in toxicity.score(d, s, ["doc_id"]).collect()))
    assert got[0] == got[1] == got[2] and sum(got[0].values()) == len(rows)
    assert {k[0]: k[2] for k in got[0]}[603] == 1


def test_toxicity_deletes_what_it_has_read(spark):
    """Of the tables that fitting and scoring write, only those that are still read stay in the shared folder."""
    rows = [(i, prose(25, i) + (f" vilequark odd{i}" if i % 3 == 0 else f" fine{i % 40}")) for i in range(300)]
    d, l = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    written = lambda: set(os.listdir(kit.shared_dir(spark).removeprefix("file://")))
    before = written()
    got = toxicity.score(d, toxicity.fit(d, l, 300, 100), ["doc_id"])
    assert Counter(x.rsplit("-", 1)[1] for x in written() - before if x.startswith("vellumtide-")) == {"models": 1, "evidence": 2, "values": 2}
    assert got.count() == len(rows)


def test_mixing_deals_rows_once(spark):
    """Join and window deal whole rows alike: one exchange carries them there, one sorts them by position."""
    from pyspark.sql import functions as F

    d = spark.createDataFrame([(i, ["a", "", None, "n"][i % 4], "some words " * (i % 5)) for i in range(60)], "doc_id long, source string, text string")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        for k, v in zip(kept, ("-1", "false")):
            spark.conf.set(k, v)
        plan = mixing.curriculum_stream(d)._jdf.queryExecution().executedPlan()
        wide, todo = 0, [plan]
        while todo:
            p = todo.pop()
            wide += p.nodeName() == "Exchange" and "_row" in p.output().mkString(",")
            todo += [p.children().apply(i) for i in range(p.children().size())]
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert wide == 2
    got = {(r["source"], r["source_size"]) for r in mixing.mix_sizes(d.select("doc_id", "source", mixing.n_words(F.col("text")).alias("size"))).collect()}
    assert len(got) == 4
