"""Images larger than a task: sub-tiles with a halo for filtering, and labels joined across their borders.

A sub-tile is the unit of every task.  Smoothing gives a tile its neighbours' pixels up to the
kernel's radius, so each inner pixel sees what it would see in the whole image.  Labelling solves each
tile by itself, names a local component by its first pixel in the raster of the *whole* image,
joins pixels that touch across a border, and takes the least name of each component: that is its
first pixel, so the final numbers are those of an undivided image.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import convolve, unions
from .detect import label_runs

WIDE = 1 << 31  # more than any column: row * WIDE + col is the raster order


def with_halo(pixels: DataFrame, tile: int, halo: int) -> DataFrame:
    """``pixels`` with ``tr, tc``: one copy in the own tile and one in each neighbour within ``halo``."""
    near = lambda c: F.expr(f"sequence(cast(floor(({c} - {halo}) / {tile}D) as int), cast(floor(({c} + {halo}) / {tile}D) as int))")
    return pixels.withColumn("tr", F.explode(near("row"))).withColumn("tc", F.explode(near("col")))


def smooth(pixels: DataFrame, value: str, sigma: float, tile: int, truncate: float = 3.0, out: str = "f") -> DataFrame:
    """``convolve.smooth``, a sub-tile at a time; the image's own border repeats, borders of tiles do not."""
    taps = convolve.gaussian_kernel(sigma, truncate)
    p = with_halo(pixels, tile, len(taps) // 2)
    h = convolve.convolve_axis(p, value, ("tr", "tc", "row"), "col", taps, "h_").where(f"col div {tile} = tc")
    v = convolve.convolve_axis(h, "h_", ("tr", "tc", "col"), "row", taps, out).where(f"row div {tile} = tr")
    return v.drop("h_", "tr", "tc")


def local_runs(masked: DataFrame, tile: int) -> DataFrame:
    """Horizontal runs of mask pixels inside each tile, with ``name``: the first pixel of their component in the tile."""
    m = masked.select("brick", "row", "col", F.expr(f"row div {tile}").cast("int").alias("tr"), F.expr(f"col div {tile}").cast("int").alias("tc"))
    w = Window.partitionBy("brick", "tr", "tc", "row").orderBy("col")
    r = m.withColumn("isle", F.col("col") - F.row_number().over(w)).groupBy("brick", "tr", "tc", "row", "isle").agg(F.min("col").alias("c0"), F.max("col").alias("c1")).drop("isle")

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        p = part.sort_values(["row", "c0"], kind="stable")
        label = label_runs(p["row"].to_numpy(np.int64), p["c0"].to_numpy(np.int64), p["c1"].to_numpy(np.int64))
        first = np.unique(label, return_index=True)[1]
        p["name"] = (p["row"].to_numpy(np.int64) * WIDE + p["c0"].to_numpy(np.int64))[first][label - 1]
        return p[["brick", "row", "c0", "c1", "name"]]

    return r.groupBy("brick", "tr", "tc").applyInPandas(solve, "brick string, row int, c0 int, c1 int, name long")


def border_pairs(runs: DataFrame, tile: int) -> DataFrame:
    """``a, b``: names ``(brick, name)`` of components that touch across a border, by equi-joins of border pixels."""
    edge = f"row % {tile} in (0, {tile} - 1)"
    side = runs.where(f"c0 % {tile} = 0 or c1 % {tile} = {tile} - 1 or {edge}")
    px = side.select("brick", "row", "name", F.explode(F.expr("sequence(c0, c1)")).alias("col")).where(f"{edge} or col % {tile} in (0, {tile} - 1)")
    steps = [(1, -1), (1, 0), (1, 1), (0, 1)]  # half of the eight neighbours
    ahead = px.select("brick", F.col("name").alias("from"), F.col("row").alias("r"), F.col("col").alias("c"), F.explode(F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in steps])).alias("d"))
    ahead = ahead.select("brick", "from", (F.col("r") + F.col("d.dr")).alias("row"), (F.col("c") + F.col("d.dc")).alias("col"))
    pairs = ahead.join(px, ["brick", "row", "col"]).where("from <> name")
    node = lambda c: F.struct("brick", F.col(c).alias("name"))
    return pairs.select(node("from").alias("a"), node("name").alias("b")).distinct()


def label_components(masked: DataFrame, tile: int) -> DataFrame:
    """``detect.label_components`` for images of any size: same labels, no task with more than a tile."""
    runs = unions.cut(local_runs(masked, tile))
    root = unions.roots(border_pairs(runs, tile)).select(F.col("id.brick").alias("brick"), F.col("id.name").alias("name"), F.col("root.name").alias("root"))
    runs = runs.join(root, ["brick", "name"], "left").withColumn("root", F.coalesce("root", "name"))
    place = unions.numbered(runs.select("brick", "root").distinct(), "brick", "root")
    first = place.groupBy("brick").agg(F.min("place").alias("least"))
    label = place.join(first, "brick").select("brick", "root", (F.col("place") - F.col("least") + 1).cast("int").alias("label"))
    cells = runs.join(label, ["brick", "root"]).select("brick", "row", "label", F.explode(F.expr("sequence(c0, c1)")).alias("col"))
    return masked.join(cells, ["brick", "row", "col"])
