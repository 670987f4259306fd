"""Separable Gaussian filter as two window passes over a dense pixel relation."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def gaussian_kernel(sigma: float, truncate: float = 3.0) -> list[float]:
    """Normalised taps from -radius to radius, radius = ceil(truncate * sigma)."""
    r = math.ceil(truncate * sigma)
    taps = [math.exp(-(i * i) / (2.0 * sigma * sigma)) for i in range(-r, r + 1)]
    total = sum(taps)
    return [t / total for t in taps]


def convolve_axis(pixels: DataFrame, value: str, line: str | tuple[str, ...], along: str, taps: list[float], out: str) -> DataFrame:
    """One pass along ``along`` in each ``line``; edges repeat the border pixel, NULL counts as 0."""
    w = Window.partitionBy("brick", *((line,) if isinstance(line, str) else line)).orderBy(along)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x, r, total = F.coalesce(F.col(value), F.lit(0.0)), len(taps) // 2, None
    p = pixels.withColumn("x_", x).withColumn("lo_", F.first("x_").over(whole)).withColumn("hi_", F.last("x_").over(whole))
    for k, t in enumerate(taps):
        d = k - r
        v = F.col("x_") if d == 0 else F.coalesce(F.lag("x_", -d).over(w), F.col("lo_")) if d < 0 else F.coalesce(F.lead("x_", d).over(w), F.col("hi_"))
        total = F.lit(t) * v if total is None else total + F.lit(t) * v
    return p.withColumn(out, total).drop("x_", "lo_", "hi_")


def smooth(pixels: DataFrame, value: str, sigma: float, truncate: float = 3.0, out: str = "f") -> DataFrame:
    """Along rows, then along columns."""
    taps = gaussian_kernel(sigma, truncate)
    h = convolve_axis(pixels, value, "row", "col", taps, "h_")
    return convolve_axis(h, "h_", "col", "row", taps, out).drop("h_")
