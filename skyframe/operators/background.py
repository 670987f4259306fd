"""Background: sigma-clipped mesh statistics and their bilinear interpolation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import BackgroundConfig


def clip(px: str, kappa: float, max_iter: int) -> Column:
    """Struct ``(px, done)`` after clipping the sorted array ``px``; empty arrays stay."""
    med = "element_at(s.px, cast(size(s.px) div 2 + 1 as int))"
    # one-element arrays bind names: (median), then (median, sigma)
    pick = f"""transform(array({med}), m ->
        named_struct('m', m, 'g', 1.4826D * element_at(array_sort(transform(s.px, x -> abs(x - m))), cast(size(s.px) div 2 + 1 as int))))[0]"""
    step = f"""transform(transform(array({pick}), w -> named_struct('w', w, 'kept',
        filter(s.px, x -> x >= w.m - {kappa}D * w.g and x <= w.m + {kappa}D * w.g))), z ->
        if(z.w.g = 0D or size(z.kept) = size(s.px), named_struct('px', s.px, 'done', true), named_struct('px', z.kept, 'done', false)))[0]"""
    return F.expr(f"aggregate(sequence(1, {max_iter}), named_struct('px', {px}, 'done', size({px}) = 0), (s, i) -> if(s.done, s, {step}))")


def grid(pixels: DataFrame, cfg: BackgroundConfig) -> DataFrame:
    """``brick, gr, gc, n, bg, rms``; a cell without finite pixels keeps a row of NULLs.

    A cell has at most mesh * mesh pixels, so the collected array is bounded.
    """
    m = cfg.mesh
    cells = pixels.groupBy("brick", F.expr(f"row div {m}").cast("int").alias("gr"), F.expr(f"col div {m}").cast("int").alias("gc")).agg(F.array_sort(F.collect_list("v")).alias("px"))
    s = cells.withColumn("px", clip("px", cfg.kappa, cfg.max_iter)["px"])
    s = s.withColumn("n", F.size("px"))
    s = s.withColumn("med", F.expr("if(n > 0, element_at(px, cast(n div 2 + 1 as int)), null)"))
    s = s.withColumn("mean", F.expr("if(n > 0, aggregate(px, 0D, (a, x) -> a + x) / n, null)"))
    s = s.withColumn("rms", F.expr("if(n > 0, sqrt(aggregate(px, 0D, (a, x) -> a + (x - mean) * (x - mean)) / n), null)"))
    mode = F.when((F.col("rms") > 0) & F.expr("abs(mean - med) < 0.3D * rms"), 2.5 * F.col("med") - 1.5 * F.col("mean")).otherwise(F.col("med"))
    return s.select("brick", "gr", "gc", "n", mode.alias("bg"), "rms")


def corners(g: DataFrame) -> DataFrame:
    """For each origin ``(gr0, gc0)`` from -1 on, the four clamped cells around it in one row.

    The grid is smaller than the image by the square of the mesh.
    """
    size = g.groupBy("brick").agg(F.max("gr").alias("mr"), F.max("gc").alias("mc"))
    base = size.select("brick", "mr", "mc", F.explode(F.expr("sequence(-1, mr)")).alias("gr0")).select("*", F.explode(F.expr("sequence(-1, mc)")).alias("gc0"))
    for dr in (0, 1):
        for dc in (0, 1):
            side = g.select("brick", F.col("gr").alias("kr"), F.col("gc").alias("kc"), F.col("bg").alias(f"b{dr}{dc}"), F.col("rms").alias(f"s{dr}{dc}"))
            base = base.withColumn("kr", F.expr(f"least(greatest(gr0 + {dr}, 0), mr)")).withColumn("kc", F.expr(f"least(greatest(gc0 + {dc}, 0), mc)"))
            base = base.join(side, ["brick", "kr", "kc"], "left").drop("kr", "kc")
    return base.drop("mr", "mc")


def interpolate(pixels: DataFrame, g: DataFrame, mesh: int) -> DataFrame:
    """``pixels`` with full-resolution ``bg`` and ``rms``; a NULL cell poisons all pixels that touch it."""
    p = pixels.withColumn("fr", (F.col("row") + 0.5) / mesh - 0.5).withColumn("fc", (F.col("col") + 0.5) / mesh - 0.5)
    p = p.withColumn("gr0", F.floor("fr").cast("int")).withColumn("gc0", F.floor("fc").cast("int"))
    p = p.join(corners(g), ["brick", "gr0", "gc0"], "left").withColumn("dr", F.col("fr") - F.col("gr0")).withColumn("dc", F.col("fc") - F.col("gc0"))
    blend = lambda k: F.expr(f"{k}00 * (1D - dr) * (1D - dc) + {k}01 * (1D - dr) * dc + {k}10 * dr * (1D - dc) + {k}11 * dr * dc")
    return p.select(*pixels.columns, blend("b").alias("bg"), blend("s").alias("rms"))


def residual(full: DataFrame) -> DataFrame:
    """Background-subtracted pixels: ``v - bg`` in ``res``."""
    return full.withColumn("res", F.col("v") - F.col("bg"))
