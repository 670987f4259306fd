"""Summaries: image, mesh, residual, component and catalog statistics, top lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .selection import with_median


def image_stats(pixels: DataFrame) -> DataFrame:
    s = pixels.groupBy("brick").agg(F.count("v").alias("n_valid"), F.count_if(F.col("v").isNull()).alias("n_bad"), F.min("v").alias("vmin"), F.max("v").alias("vmax"), F.avg("v").alias("vmean"))
    return with_median(s, pixels, ["brick"], "v", "vmedian")


def sky_patch(pixels: DataFrame, dims: DataFrame) -> DataFrame:
    """Upper median of the central patch, half-width min(100, nrows / 4); NULL if it has no finite pixel."""
    p = pixels.join(dims, "brick").withColumn("h", F.expr("least(100, nrows div 4)"))
    inside = p.where(F.expr("row >= nrows div 2 - h and row < nrows div 2 + h and col >= ncols div 2 - h and col < ncols div 2 + h"))
    return with_median(inside.select("brick").distinct(), inside, ["brick"], "v", "sky")


def grid_summary(grid: DataFrame) -> DataFrame:
    return grid.groupBy("brick").agg(
        (F.max("gr") + 1).alias("grid_rows"), (F.max("gc") + 1).alias("grid_cols"), F.min("bg").alias("bg_min"), F.max("bg").alias("bg_max"), F.avg("bg").alias("bg_mean"), F.min("rms").alias("rms_min"), F.max("rms").alias("rms_max"), F.avg("rms").alias("rms_mean")
    )


def residual_stats(residual: DataFrame) -> DataFrame:
    s = residual.groupBy("brick").agg(F.avg("res").alias("res_mean"), F.stddev_pop("res").alias("res_rms"))
    return with_median(s, residual, ["brick"], "res", "res_median")


def detection_summary(found: DataFrame) -> DataFrame:
    s = found.groupBy("brick").agg(
        F.count("*").alias("n"), F.min("npix").alias("npix_min"), F.max("npix").alias("npix_max"), F.avg("npix").alias("npix_mean"), F.min("peak_snr").alias("snr_min"), F.max("peak_snr").alias("snr_max"), F.avg("peak_snr").alias("snr_mean")
    )
    return with_median(s, found, ["brick"], "npix", "npix_median").withColumn("npix_median", F.col("npix_median").cast("int"))


def flux_stats(catalog: DataFrame) -> DataFrame:
    """Count, edge-flagged count, mean, upper median and maximum of ``flux_auto`` (0 for none)."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    s = catalog.agg(F.count("*").alias("n"), F.count_if(F.expr("(flags & 1) <> 0")).alias("n_edge"), zero(F.avg("flux_auto")).alias("flux_mean"), zero(F.max("flux_auto")).alias("flux_max"))
    return with_median(s, catalog, [], "flux_auto", "flux_median").withColumn("flux_median", zero(F.col("flux_median")))


def top(frame: DataFrame, column: str, n: int) -> DataFrame:
    return frame.orderBy(F.desc(column), "brick", "label").limit(n)
