"""Pixel and catalog relations over the supplied tables, each with its DuckDB twin.

``image`` queries use ``lin_px``: four 64 x 64 bricks of exact integer sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LIN_BRICKS, LIN_SIDE = 4, 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dense(sparse: DataFrame, nrows: int, ncols: int) -> DataFrame:
    """All pixels of each brick; missing ones are 0.

    The grid is generated, and meets the sparse pixels by an equi-join.
    """
    grid = sparse.select("brick").distinct().select("brick", F.explode(F.sequence(F.lit(0), F.lit(nrows - 1))).alias("row")).select("*", F.explode(F.sequence(F.lit(0), F.lit(ncols - 1))).alias("col"))
    return grid.join(sparse, ["brick", "row", "col"], "left").select("brick", "row", "col", F.coalesce("v", F.lit(0.0)).alias("v"))


def lin_px(spark: SparkSession, sf_dir: str, bricks: int = LIN_BRICKS, side: int = LIN_SIDE) -> DataFrame:
    s = table(spark, sf_dir, "lineitem").groupBy(
        F.expr(f"cast(l_suppkey % {bricks} as string)").alias("brick"), F.expr(f"cast(l_partkey % {side} as int)").alias("row"), F.expr(f"cast(l_orderkey % {side} as int)").alias("col")
    ).agg(F.sum("l_quantity").alias("v"))
    return dense(s, side, side)


def evt_px(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("brick"), F.expr("day(ts) - 1").alias("row"), F.hour("ts").alias("col")).agg(F.sum("value").alias("v"))
    return dense(s, 31, 24)


def emb_px(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.lit("emb").alias("brick"), F.col("vec_id").cast("int").alias("row"), F.posexplode("embedding").alias("col", "v")).select("brick", "row", "col", F.col("v").cast("double").alias("v"))


def dims(spark: SparkSession, bricks: int = LIN_BRICKS, side: int = LIN_SIDE) -> DataFrame:
    return spark.range(bricks).select(F.col("id").cast("string").alias("brick"), F.lit(side).alias("nrows"), F.lit(side).alias("ncols"))


def wcs(spark: SparkSession, bricks: int = LIN_BRICKS, side: int = LIN_SIDE) -> DataFrame:
    """One linear projection a brick; the last brick has none."""
    t = 0.262 / 3600
    return spark.range(bricks - 1).select(
        F.col("id").cast("string").alias("brick"),
        F.struct(
            F.lit(side / 2 + 0.5).alias("crpix1"), F.lit(side / 2 + 0.5).alias("crpix2"), (F.lit(187.0) + F.col("id") * 0.25).alias("crval1"), F.lit(12.0).alias("crval2"),
            F.lit(-t).alias("cd1_1"), F.lit(0.0).alias("cd1_2"), F.lit(0.0).alias("cd2_1"), F.lit(t).alias("cd2_2"),
        ).alias("wcs"),
    )


def supplier_wcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A linear projection for each supplier, rotated by some, missing for one in eleven."""
    terms = "100.5D + s_suppkey % 50 as crpix1, 80D + s_suppkey % 40 as crpix2, 150D + s_nationkey * 2.5D as crval1, s_suppkey % 60 - 30D as crval2, -1e-5D * (1 + s_suppkey % 7) as cd1_1, 1e-6D * (s_suppkey % 5 - 2) as cd1_2, 1e-6D * (s_suppkey % 3 - 1) as cd2_1, 1e-5D * (1 + s_suppkey % 6) as cd2_2"
    return table(spark, sf_dir, "supplier").selectExpr("cast(s_suppkey as long) as s_suppkey", "cast(s_nationkey as long) as s_nationkey", f"if(s_suppkey % 11 <> 0, struct({terms}), null) as wcs")


def sky(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sky_of(table(spark, sf_dir, "orders"))


def sky_of(orders: DataFrame) -> DataFrame:
    """Orders as sources on a patch of sky; a stream or a table."""
    return orders.selectExpr(
        "o_orderkey as id", "o_orderpriority as brick", "187.0D + ((o_orderkey * 7919) % 108000) / 360000.0D as ra",
        "12.0D + ((o_orderkey * 104729 + o_custkey * 31) % 108000) / 360000.0D as dec", "cast(cast(floor(o_totalprice) as bigint) % 40 + 5 as int) as npix",
    )


def brick_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "events").select("event_type").distinct().select(
        F.explode(F.array(*[F.concat(F.lit(a), F.col("event_type"), F.lit(b)) for a, b in FILE_FORMS])).alias("name")
    )
    return names.select(F.concat(F.lit("/data/"), "name").alias("path"))


#: Around an event type: image names of two bands, and decoys.
FILE_FORMS = (("legacysurvey-", "-image-r.fits.fz"), ("legacysurvey-", "-image-g.fits.fz"), ("other-", "-image-r.fits.fz"), ("legacysurvey_", "_image.fits"))
