"""Measurement: moments, Kron radius, elliptical aperture flux, flags, sky position."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import FLAG_EDGE, MeasureConfig
from ..functions.scalar import pix_to_sky


def footprint(labels: DataFrame, found: DataFrame) -> DataFrame:
    """Labelled pixels of kept detections only."""
    return labels.join(found.select("brick", "label", "npix", "rmin", "rmax", "cmin", "cmax"), ["brick", "label"])


def moments(foot: DataFrame) -> DataFrame:
    """Isophotal flux, weighted centroid, axes and angle of each detection.

    One pass: second moments are taken about the corner of the bounding box and moved to the centroid.
    """
    w = F.greatest(F.col("res"), F.lit(0.0))
    x, y = F.col("col") - F.col("cmin"), F.col("row") - F.col("rmin")
    s = lambda e: F.coalesce(F.sum(F.when(F.col("res").isNotNull(), e)), F.lit(0.0))
    g = foot.groupBy("brick", "label", "npix", "rmin", "rmax", "cmin", "cmax").agg(
        s(F.col("res")).alias("flux_iso"), s(w).alias("sw"), s(w * x).alias("sx"), s(w * y).alias("sy"), s(w * x * x).alias("sxx"), s(w * y * y).alias("syy"), s(w * x * y).alias("sxy")
    )
    on = F.col("sw") > 0
    part = lambda e: F.when(on, e)
    g = g.withColumns({"mx": part(F.expr("sx / sw")), "my": part(F.expr("sy / sw"))})
    g = g.withColumns({"mxx": part(F.expr("sxx / sw - mx * mx")), "myy": part(F.expr("syy / sw - my * my")), "mxy": part(F.expr("sxy / sw - mx * my"))})
    g = g.withColumns({
        "x": F.when(on, F.col("cmin") + F.col("mx")).otherwise(F.expr("(cmin + cmax) / 2D")),
        "y": F.when(on, F.col("rmin") + F.col("my")).otherwise(F.expr("(rmin + rmax) / 2D")),
        "half": F.expr("(mxx - myy) / 2D"),
    })
    g = g.withColumn("disc", F.expr("sqrt(half * half + mxy * mxy)"))
    round_ = F.sqrt(F.col("npix") / math.pi)
    g = g.withColumns({
        "a0": F.when(on, F.expr("sqrt(greatest((mxx + myy) / 2D + disc, 0D))")).otherwise(round_),
        "b0": F.when(on, F.expr("sqrt(greatest((mxx + myy) / 2D - disc, 0D))")).otherwise(round_),
        "theta": F.when(on, 0.5 * F.degrees(F.atan2("mxy", "half"))).otherwise(F.lit(0.0)),
    })
    g = g.withColumn("a", F.greatest("a0", F.lit(0.5))).withColumn("b", F.least(F.greatest("b0", F.lit(0.5)), "a"))
    return g.select("brick", "label", "npix", "rmin", "rmax", "cmin", "cmax", "flux_iso", "x", "y", "a", "b", "theta", (1.0 - F.col("b") / F.col("a")).alias("ellipticity"))


def ellipse_radius2(x: str = "x", y: str = "y") -> Column:
    """Squared elliptical radius of pixel (col, row) about the source, in units of its axes."""
    ct, st = "cos(radians(theta))", "sin(radians(theta))"
    u, w = f"((col - {x}) * {ct} + (row - {y}) * {st})", f"((row - {y}) * {ct} - (col - {x}) * {st})"
    return F.expr(f"({u} / a) * ({u} / a) + ({w} / b) * ({w} / b)")


def kron_radius(foot: DataFrame, shape: DataFrame, cfg: MeasureConfig) -> DataFrame:
    """``shape`` with ``kron_radius``.

    The first moment over a footprint whose second moments define the axes is sqrt(2) at most, so the
    pass over pixels is left out when the floor is above that.
    """
    if cfg.kron_min_radius >= math.sqrt(2):
        return shape.withColumn("kron_radius", F.lit(float(cfg.kron_min_radius)))
    raw = raw_kron_radius(foot, shape)
    return shape.join(raw, ["brick", "label"], "left").withColumn("kron_radius", F.greatest(F.coalesce("raw_kron", F.lit(1.0)), F.lit(cfg.kron_min_radius))).drop("raw_kron")


def raw_kron_radius(foot: DataFrame, shape: DataFrame) -> DataFrame:
    px = foot.where("res > 0").select("brick", "label", "row", "col", "res").join(shape.select("brick", "label", "x", "y", "a", "b", "theta"), ["brick", "label"])
    return px.groupBy("brick", "label").agg((F.sum(F.sqrt(ellipse_radius2()) * F.col("res")) / F.sum("res")).alias("raw_kron"))


def aperture_rows(shape: DataFrame, dims: DataFrame, cfg: MeasureConfig) -> DataFrame:
    """``brick, label, row, lo, hi``: in each row the first and last pixel centre inside the Kron ellipse.

    An ellipse meets a row in one stretch; its ends are found among the columns of the clipped box by the
    very test that a pixel is put to, so no pixel on the rim is decided otherwise.
    """
    ap = cfg.kron_factor * F.col("kron_radius")
    s = shape.join(dims, "brick").withColumn("ap2", ap * ap).withColumn("margin", (F.ceil(ap * F.greatest("a", "b")) + 1).cast("int"))
    s = s.withColumns({"r0": F.expr("greatest(rmin - margin, 0)"), "r1": F.expr("least(rmax + margin, nrows - 1)"), "c0": F.expr("greatest(cmin - margin, 0)"), "c1": F.expr("least(cmax + margin, ncols - 1)")})
    s = s.select("brick", "label", "x", "y", "a", "b", "theta", "ap2", "c0", "c1", F.explode(F.expr("sequence(r0, r1)")).alias("row"))
    inside = F.filter(F.expr("sequence(c0, c1)"), lambda c: _inside(c))
    s = s.withColumn("inside", inside).where("size(inside) > 0")
    return s.select("brick", "label", "row", F.element_at("inside", 1).alias("lo"), F.element_at("inside", -1).alias("hi"))


def _inside(c: Column) -> Column:
    dx, dy = c - F.col("x"), F.col("row") - F.col("y")
    ct, st = F.cos(F.radians("theta")), F.sin(F.radians("theta"))
    u, w = (dx * ct + dy * st) / F.col("a"), (dy * ct - dx * st) / F.col("b")
    return u * u + w * w <= F.col("ap2")


def kron_flux(shape: DataFrame, pixels: DataFrame, dims: DataFrame, cfg: MeasureConfig) -> DataFrame:
    """``shape`` with ``flux_auto``: sum of all finite residual pixels inside the Kron ellipse.

    Pixels become running sums along their row, so a source asks for two of them a row, by an
    equi-join, instead of for every pixel that it covers.
    """
    along = Window.partitionBy("brick", "row").orderBy("col").rowsBetween(Window.unboundedPreceding, 0)
    upto = pixels.select("brick", "row", "col", F.sum(F.coalesce("res", F.lit(0.0))).over(along).alias("upto"))
    ends = F.explode(F.array(F.struct(F.col("hi").alias("col"), F.lit(1.0).alias("sign")), F.struct((F.col("lo") - 1).alias("col"), F.lit(-1.0).alias("sign")))).alias("e")
    asked = aperture_rows(shape, dims, cfg).select("brick", "label", "row", ends).select("brick", "label", "row", "e.col", "e.sign").where("col >= 0")
    flux = asked.join(upto, ["brick", "row", "col"]).groupBy("brick", "label").agg(F.sum(F.col("sign") * F.col("upto")).alias("flux_auto"))
    return shape.join(flux, ["brick", "label"], "left").withColumn("flux_auto", F.coalesce("flux_auto", F.lit(0.0)))


def edge_flags(shape: DataFrame, dims: DataFrame) -> DataFrame:
    edge = F.expr("rmin = 0 or rmax + 1 >= nrows or cmin = 0 or cmax + 1 >= ncols")
    return shape.join(dims, "brick").withColumn("flags", F.when(edge, FLAG_EDGE).otherwise(0).cast("short")).drop("nrows", "ncols")


def sky_position(shape: DataFrame, wcs: DataFrame) -> DataFrame:
    """With ``ra, dec``; NULL where the brick has no coordinates."""
    s = shape.join(wcs.select("brick", "wcs"), "brick", "left")
    ra, dec = pix_to_sky("wcs", F.col("x"), F.col("y"))
    return s.withColumn("ra", ra).withColumn("dec", dec).drop("wcs")
