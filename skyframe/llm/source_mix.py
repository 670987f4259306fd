"""Mixing sources to target weights by hash-threshold histograms; DataFrame functions only.

Targets: sources in code-point order (null last) weigh ``WEIGHTS`` in turn and share ``SHARE`` of
all words.  A target stops at ``MAX_EPOCHS`` times its source's size and the excess is shared
again by weight: the result is ``min(cap, level * weight)``, whose level follows from one pass
over the sources in order of size over weight.

Selection: a document's 32-bit hash decides.  A source gives every document ``copies`` times and
once more if its hash is under a threshold.  Word sums by (source, top 12 bits) locate the bucket
in which the budget ends; only that bucket is summed again by 12 more bits, and its boundary by
the last 8.  Documents are never sorted, and the result is the same on every run.

The slim table ``doc_id, source, size, hash`` is written once, so texts are read once.  A source
that holds most rows is spread over its hash buckets and summed on the map side.

Edge cases: null text has size 0; a null source is a source of its own; a null doc_id hashes its
text; rows with the same hash share one decision; a source without words has target 0.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

WEIGHTS = (5, 2, 1)
SHARE = Fraction(3, 2)
MAX_EPOCHS = 2
BROADCAST_SOURCES = 100_000  # more sources than this are joined by shuffle

SIZE = r"size(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+', 0))"
HASH = "cast(conv(substr(md5(coalesce(cast(doc_id as string), text, '')), 1, 8), 16, 10) as bigint)"


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: Fraction = SHARE, cap: int = MAX_EPOCHS) -> DataFrame:
    """``(k, source_size, copies, target, rest)`` from ``sizes(k, source, s)``: one row per source.

    The windows below run over sources, not documents.
    """
    big = "decimal(38,0)"
    place = Window.orderBy(F.col("source").isNull(), "source")
    s = sizes.withColumn("w", F.element_at(F.array(*[F.lit(x) for x in weights]), (F.pmod(F.row_number().over(place) - 1, F.lit(len(weights))) + 1).cast("int")))
    # size over weight as an integer: s * lcm / w
    lcm = 1
    for x in weights:
        lcm = lcm * x // __import__("math").gcd(lcm, x)
    s = s.withColumn("ratio", F.expr(f"cast(s as {big}) * cast({lcm} div w as bigint)"))
    order = Window.orderBy("ratio", F.col("source").isNull(), "source")
    before, onward = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    p, q = share.numerator, share.denominator
    s = (
        s.withColumn("total", F.sum("s").over(everything))
        .withColumn("b", F.coalesce(F.sum("s").over(before), F.lit(0)))
        .withColumn("wr", F.sum("w").over(onward))
        .withColumn("capped", F.expr(f"cast({cap * q} as {big}) * s * wr <= cast(w as {big}) * ({p} * total - {cap * q} * b)"))
        .withColumn("bc", F.coalesce(F.sum(F.when(F.col("capped"), F.col("s"))).over(everything), F.lit(0)))
        .withColumn("wu", F.coalesce(F.sum(F.when(~F.col("capped"), F.col("w"))).over(everything), F.lit(0)))
    )
    part, per = f"(w * ({p} * total - {cap * q} * bc))", f"({q} * wu)"
    s = s.withColumn("target", F.expr(f"case when capped then cast({cap} * s as double) else cast({part} as double) / cast({per} as double) end"))
    s = s.withColumn("copies", F.expr(f"case when capped then {cap} when s = 0 then 0 else cast(floor({part} / ({per} * s)) as int) end"))
    return s.select("k", F.col("s").alias("source_size"), "target", F.col("copies").cast("int").alias("copies"), (F.col("target") - F.col("copies") * F.col("s")).alias("rest"))


def _boundary(sums: DataFrame, budget: DataFrame, bucket: str) -> DataFrame:
    """First bucket of each source in which the running sum exceeds its budget, and the budget left there."""
    run = Window.partitionBy("k").orderBy(bucket)  # at most 4096 rows for a source
    cum = sums.withColumn("cum", F.sum("s").over(run)).join(budget, "k").where("cum > rest")
    return cum.groupBy("k").agg(F.min(F.struct(F.col(bucket), (F.col("rest") - (F.col("cum") - F.col("s"))).alias("rest"), F.col("s"))).alias("x")).select("k", f"x.{bucket}", "x.rest", F.col("x.s").alias("at"))


def mix_sources(docs: DataFrame, weights: tuple = WEIGHTS, share: Fraction = SHARE, cap: int = MAX_EPOCHS) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken``: one row per document."""
    slim = C.cut(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text")
        .select("doc_id", "source", F.expr(f"cast({SIZE} as bigint)").alias("size"), F.expr(HASH).alias("h"))
        .withColumn("k", F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), "source")))
        .withColumns({"b1": F.expr("cast(shiftright(h, 20) as int)"), "b2": F.expr("cast(shiftright(h, 8) & 4095 as int)"), "b3": F.expr("cast(h & 255 as int)")})
    )
    sums = C.cut(slim.groupBy("k", "source", "b1").agg(F.sum("size").alias("s")))
    goal = C.cut(targets(sums.groupBy("k", "source").agg(F.sum("s").alias("s")), weights, share, cap))
    e1 = _boundary(sums.select("k", "b1", "s"), goal.select("k", "rest"), "b1")
    sums2 = slim.join(e1.select("k", "b1"), ["k", "b1"]).groupBy("k", "b1", "b2").agg(F.sum("size").alias("s"))
    e2 = C.cut(_boundary(sums2, e1.select("k", "rest"), "b2").join(e1.select("k", "b1"), "k"))
    sums3 = slim.join(e2.select("k", "b1", "b2"), ["k", "b1", "b2"]).groupBy("k", "b3").agg(F.sum("size").alias("s"))
    e3 = _boundary(sums3, e2.select("k", "rest"), "b3").select("k", "b3", (F.col("rest") > F.col("at") - F.col("rest")).alias("take"))
    edge = e2.select("k", "b1", "b2").join(e3, "k").select("k", F.expr("shiftleft(cast(b1 as bigint), 20) + shiftleft(cast(b2 as bigint), 8) + b3 + if(take, 1, 0)").alias("limit"))
    plan = C.cut(goal.join(edge, "k", "left"))
    few = plan.count() <= BROADCAST_SOURCES
    out = slim.join(F.broadcast(plan) if few else plan, "k")
    taken = F.expr("size * (copies + case when limit is null or h < limit then if(rest > 0, 1, 0) else 0 end)")
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", taken.alias("taken"))


def op8_source_mix(spark, sf_dir: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                  CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), text, '')), 1, 8)) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS HUGEINT) AS s, row_number() OVER (ORDER BY source IS NULL, source) AS p FROM d GROUP BY source),
w AS (SELECT *, CASE (p - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, sum(s) OVER () AS total FROM s),
b AS (SELECT *, coalesce(sum(s) OVER (ORDER BY s * 10 / w, p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b,
             sum(w) OVER (ORDER BY s * 10 / w, p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS wr FROM w),
c AS (SELECT *, 4 * s * wr <= w * (3 * total - 4 * b) AS capped FROM b),
f AS (SELECT *, coalesce(sum(s) FILTER (capped) OVER (), 0) AS bc, coalesce(sum(w) FILTER (NOT capped) OVER (), 0) AS wu FROM c),
t AS (SELECT source, s, CASE WHEN capped THEN CAST(2 * s AS DOUBLE) ELSE CAST(w * (3 * total - 4 * bc) AS DOUBLE) / CAST(2 * wu AS DOUBLE) END AS target,
             CASE WHEN capped THEN 2 WHEN w * (3 * total - 4 * bc) >= 2 * wu * s AND s > 0 THEN 1 ELSE 0 END AS copies FROM f),
g AS (SELECT source, h, sum(size) AS x FROM d GROUP BY source, h),
r AS (SELECT g.source, h, x, sum(x) OVER (PARTITION BY g.source ORDER BY h) AS cum FROM g),
e AS (SELECT r.source, min(struct_pack(h := h, cum := cum, x := x)) AS e FROM r JOIN t ON t.source IS NOT DISTINCT FROM r.source
      WHERE cum > target - copies * s GROUP BY r.source),
l AS (SELECT t.*, e.e.h + CASE WHEN (target - copies * s) - (e.e.cum - e.e.x) > e.e.cum - (target - copies * s) THEN 1 ELSE 0 END AS lim
      FROM t LEFT JOIN e ON e.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, CAST(s AS BIGINT) AS source_size, target,
       CAST(size * (copies + CASE WHEN (lim IS NULL OR h < lim) AND target - copies * s > 0 THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN l ON d.source IS NOT DISTINCT FROM l.source
"""
