"""Mixing sources to target weights by a time-varying curriculum, in DataFrame functions alone.

Every source has a weight schedule, a piecewise linear function of training time in [0, 1]. Its integral is the
source's whole demand. A document's place in its source's token stream is a cumulative token count; the inverse of the
integrated schedule turns that count into a training position, and documents are range-sorted by position.

Prefix sums run in two levels: buckets of a hash of the id, then rows of one bucket, so a source with a third of all rows is spread
over all buckets and only bucket totals meet in one place.

Defined cases: null text has size 0 and takes nothing; null source is a source, last; an empty table gives no rows;
rows with one doc_id are told apart by their size only, and every row, of a null doc_id too, comes as often as its own copies say; columns other than the named ones are carried along by
`curriculum_stream` and don't matter to `mix_sizes`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellumtide.llm._kit import materialize, table

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
CAP = 2.0
#: Multipliers of the weight at evenly spaced times: heavy sources fade, light ones grow, all integrate to 1.
SCHEDULES = ((1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.5, 1.0, 1.5))
BUCKET_DIGITS = 3


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def source_targets(totals: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """totals: one row a source (source, source_size). Water-filling in closed form: in the order of cap to weight, a source is held at its cap
    while the level of the others would lift it above."""
    n = len(weights)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(by_name) - 1
    w = F.element_at(F.array(*map(F.lit, weights)), (rank % n + 1).cast("int"))
    t = totals.select("source", "source_size", (rank % n).cast("int").alias("slot"), w.alias("weight"))
    t = t.withColumn("limit", F.lit(cap) * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    t = t.withColumn("left", F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
    t = t.withColumn("level", F.col("left") / F.sum("weight").over(after))
    t = t.withColumn("held", F.col("limit") <= F.col("weight") * F.col("level"))
    level = F.min(F.when(~F.col("held"), F.col("level"))).over(everything)
    free = F.sum(F.when(~F.col("held"), F.col("weight"))).over(everything)
    rest = F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum(F.when(F.col("held"), F.col("limit"))).over(everything), F.lit(0.0))
    target = F.when(F.col("held") | level.isNull(), F.col("limit")).otherwise(F.col("weight") * rest / free)
    return t.select("source", "source_size", "slot", target.cast("double").alias("target"))


def _position(share: Column, slot: Column, schedules) -> Column:
    """The time by which a source has met `share` of its demand: the inverse of the integrated schedule."""
    out = F.lit(None).cast("double")
    for k, knots in enumerate(schedules):
        step = 1.0 / (len(knots) - 1)
        areas = [(a + b) / 2 * step for a, b in zip(knots, knots[1:])]
        whole, at, got = sum(areas), 0.0, F.lit(1.0)
        parts = []
        for i, area in enumerate(areas):
            a, b = knots[i], knots[i + 1]
            need = share * F.lit(whole) - F.lit(at)
            slope = (b - a) / step
            if abs(slope) < 1e-12:
                t = need / F.lit(a)
            else:
                t = (F.sqrt(F.greatest(F.lit(a * a) + F.lit(2 * slope) * need, F.lit(0.0))) - F.lit(a)) / F.lit(slope)
            parts.append((at + area, F.lit(i * step) + t))
            at += area
        for upto, t in reversed(parts):
            got = F.when(share * F.lit(whole) <= F.lit(upto), t).otherwise(got)
        out = F.when(slot == k, F.least(F.greatest(got, F.lit(0.0)), F.lit(1.0))).otherwise(out)
    return out


def mix_sizes(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, schedules=SCHEDULES, digits: int = BUCKET_DIGITS, carry: tuple = ()) -> DataFrame:
    """rows: doc_id, source, size. Returns doc_id, source, size, source_size, target, copies, taken, position_1, position_2, ... and the columns `carry` of rows.

    Every document of a source is taken floor(target / source_size) times, and the first of the hash order once more,
    until the source's target is met to within half a document."""
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    # One plain key of every source, null too: the join and the window then deal rows alike, so that they travel once.
    name = F.concat(F.when(F.col("source").isNull(), "n").otherwise("s"), F.coalesce(F.col("source").cast("string"), F.lit("")))
    base = rows.select("doc_id", "source", "size", *carry).withColumn("key", key).withColumn("bucket", F.substring("key", 1, digits)).withColumn("_s", name)
    sums = base.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket"))
    run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("in_bucket").over(run), F.lit(0)))
    targets = source_targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap)
    s, t = sums.alias("s"), targets.alias("t")
    offs = s.join(t, F.col("s.source").eqNullSafe(F.col("t.source"))).select(F.col("s.source"), "bucket", "before", "source_size", "slot", "target")
    offs = offs.withColumn("_s", name).drop("source")
    j = base.join(offs, ["_s", "bucket"])
    inner = Window.partitionBy("_s", "bucket").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    cum = F.col("before") + F.coalesce(F.sum("size").over(inner), F.lit(0))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    j = j.withColumn("cum", cum).withColumn("whole", F.floor(ratio + F.lit(1e-12)).cast("int"))
    extra = F.col("target") - F.col("whole") * F.col("source_size")
    j = j.withColumn("copies", F.col("whole") + (F.col("cum") + F.col("size") / 2 <= extra).cast("int"))
    j = j.withColumn("copies", F.when(F.col("size") > 0, F.least(F.col("copies"), F.lit(int(cap)))).otherwise(0))
    most = int(cap)
    places = []
    for c in range(1, most + 1):
        at = (F.col("cum") + F.lit(c - 1) * F.col("source_size") + F.col("size") / 2) / F.greatest(F.col("target"), F.lit(1.0))
        places.append(F.when(F.col("copies") >= c, _position(F.least(at, F.lit(1.0)), F.col("slot"), schedules)).alias(f"position_{c}"))
    return j.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"), *places, *carry)


def curriculum_stream(docs: DataFrame, **how) -> DataFrame:
    """The mixed training stream: every taken copy of every document, all columns of docs, range-sorted by training position."""
    rows = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    plan = mix_sizes(rows, carry=("_row",), **how).where("copies > 0")
    n = int(how.get("cap", CAP))
    plan = plan.select("doc_id", "_row", F.explode(F.array(*[f"position_{c}" for c in range(1, n + 1)])).alias("_position")).where("_position is not null")
    return plan.orderBy("_position", "doc_id").select("_row.*")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed by WEIGHTS to SHARE of all sizes; one row a document, range-sorted by its first training position."""
    docs = table(spark, sf_dir, "documents")
    sizes = materialize(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "sizes")
    out = mix_sizes(sizes)
    return out.orderBy(F.col("position_1").asc_nulls_last(), "doc_id").select("doc_id", "size", "source_size", "target", "taken", "copies")


ORACLE = r"""
WITH base AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(doc_id::VARCHAR) AS key FROM documents),
tot AS (SELECT source, sum(size)::BIGINT AS source_size FROM base GROUP BY source),
w AS (SELECT *, ([5.0, 2.0, 1.0])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight, 2.0 * source_size::DOUBLE AS lim FROM tot),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(lim) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
h AS (SELECT *, lim <= weight * level AS held FROM l),
t AS (SELECT source, source_size, CASE WHEN held THEN lim ELSE weight * (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(CASE WHEN held THEN lim END) OVER (), 0)) / sum(CASE WHEN NOT held THEN weight END) OVER () END AS target FROM h),
c AS (SELECT b.doc_id, b.size, t.source_size, t.target, floor(t.target / t.source_size + 1e-12)::INT AS whole,
        coalesce(sum(b.size) OVER (PARTITION BY b.source ORDER BY b.key, b.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS cum
      FROM base b JOIN t ON b.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, CASE WHEN size > 0 THEN least(whole + (cum + size / 2.0 <= target - whole * source_size)::INT, 2) ELSE 0 END AS copies FROM c)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, copies::INT AS copies FROM k
"""
