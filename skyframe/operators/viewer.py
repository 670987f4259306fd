"""Analytics behind an image viewer: scaling, stretch, outlines, picking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_SAMPLES = 12_000


def zscale(pixels: DataFrame, dims: DataFrame) -> DataFrame:
    """``brick, z1, z2``: 0.5 % and 99.5 % values of a strided sample in raster order; (0, 1) if empty.

    The sample is MAX_SAMPLES to twice that, whatever the image, so the array is bounded.
    """
    p = pixels.join(dims, "brick").withColumn("step", F.expr(f"greatest(cast(nrows as bigint) * ncols div {MAX_SAMPLES}, 1L)"))
    s = p.where("(cast(row as bigint) * ncols + col) % step = 0").groupBy("brick").agg(F.array_sort(F.collect_list("v")).alias("s"))
    at = lambda i: F.expr(f"s[cast({i} as int)]")
    full = F.size("s") > 0
    return s.select("brick", F.when(full, at("size(s) div 200")).otherwise(F.lit(0.0)).alias("z1"), F.when(full, at("least(size(s) * 199 div 200, size(s) - 1)")).otherwise(F.lit(1.0)).alias("z2"))


def stretch(v: Column, z1: Column, z2: Column, a: float) -> Column:
    """Grey level 0..255 by an inverse hyperbolic sine; NULL is 0."""
    x = F.least(F.greatest((v - z1) / F.greatest(z2 - z1, F.lit(1e-10)), F.lit(-0.5)), F.lit(10.0)) * a
    y = F.asinh(x) / F.greatest(F.asinh(F.lit(a)), F.lit(1e-10))
    return F.coalesce((F.least(F.greatest(y, F.lit(0.0)), F.lit(1.0)) * 255.0).cast("int"), F.lit(0))


def to_screen(x: Column, y: Column, view: dict) -> tuple[Column, Column]:
    """Image to screen position for ``view`` (pan_x, pan_y, zoom, centre cx, cy)."""
    return view["cx"] + (x - view["pan_x"]) * view["zoom"], view["cy"] + (y - view["pan_y"]) * view["zoom"]


def to_image(sx: Column, sy: Column, view: dict) -> tuple[Column, Column]:
    return view["pan_x"] + (sx - view["cx"]) / view["zoom"], view["pan_y"] + (sy - view["cy"]) / view["zoom"]


def in_viewport(catalog: DataFrame, view: dict, expand: float = 60.0) -> DataFrame:
    """Sources whose screen position is in the viewport grown by ``expand``."""
    sx, sy = to_screen(F.col("x"), F.col("y"), view)
    c = catalog.withColumn("sx", sx).withColumn("sy", sy)
    return c.where(F.col("sx").between(-expand, 2 * view["cx"] + expand) & F.col("sy").between(-expand, 2 * view["cy"] + expand))


def colour_class(selected: Column) -> Column:
    return F.when(selected, "selected").when(F.col("flags") != 0, "flagged").otherwise("normal")


def outline(catalog: DataFrame, n: int = 32) -> DataFrame:
    """``points``: the ellipse of each source as n vertices and the first again."""
    t = f"(2D * pi() * (i % {n}) / {n})"
    ex, ey = f"(greatest(a, 2D) * cos({t}))", f"(greatest(b, 1D) * sin({t}))"
    ct, st = "cos(radians(theta))", "sin(radians(theta))"
    return catalog.withColumn("points", F.expr(f"transform(sequence(0, {n}), i -> named_struct('px', x + {ex} * {ct} - {ey} * {st}, 'py', y + {ex} * {st} + {ey} * {ct}))"))


def nearest(catalog: DataFrame, x: float, y: float, zoom: float, reach: float = 50.0) -> DataFrame:
    """The source nearest to an image position, if within ``reach`` screen pixels; none otherwise."""
    d = F.hypot(F.col("x") - x, F.col("y") - y)
    return catalog.withColumn("dist", d).orderBy("dist", "brick", "label").limit(1).where(F.col("dist") * zoom < reach)
