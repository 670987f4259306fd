"""Column expressions: robust statistics, quantisation, world coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def q(x: Column, digits: int = 6) -> Column:
    """Half-up rounding that agrees between engines."""
    s = 10.0**digits
    return F.floor(x * s + 0.5) / s


def finite(x: Column) -> Column:
    """Non-finite values as NULL; aggregates then skip them."""
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def pix_to_sky(wcs: str, x: Column, y: Column) -> tuple[Column, Column]:
    """Linear projection of a 0-based pixel position; NULL without coordinates."""
    f = lambda name: F.col(f"{wcs}.{name}")
    dx, dy = x + 1.0 - f("crpix1"), y + 1.0 - f("crpix2")
    return f("crval1") + f("cd1_1") * dx + f("cd1_2") * dy, f("crval2") + f("cd2_1") * dx + f("cd2_2") * dy


def plate_scale(wcs: str) -> Column:
    """Arcseconds a pixel along the first axis."""
    return F.hypot(F.col(f"{wcs}.cd1_1"), F.col(f"{wcs}.cd2_1")) * 3600.0


def megapixels(nrows: Column, ncols: Column) -> Column:
    return F.expr("1").cast("long") * F.floor(nrows.cast("long") * ncols.cast("long") / F.lit(1_000_000))


def brick_name(path: Column, fallback: Column) -> Column:
    """Second dash-separated part of the file stem."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    return F.coalesce(F.get(F.split(stem, "-"), F.lit(1)), fallback)


def is_brick(path: Column, band: str) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return name.startswith("legacysurvey-") & name.endswith(f"-image-{band}.fits.fz")
