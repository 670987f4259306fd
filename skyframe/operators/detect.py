"""Detection: signal-to-noise mask, 8-connected components, and their summaries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DetectConfig


def snr_map(smoothed: DataFrame) -> DataFrame:
    return smoothed.withColumn("snr", F.when(F.col("rms") > 0, F.col("f") / F.col("rms")).otherwise(F.lit(0.0)))


def mask(snr: DataFrame, thresh: float) -> DataFrame:
    return snr.where(F.col("snr") > thresh)


def runs(masked: DataFrame) -> DataFrame:
    """Horizontal runs of mask pixels: ``brick, row, c0, c1``."""
    w = Window.partitionBy("brick", "row").orderBy("col")
    return masked.select("brick", "row", "col", (F.col("col") - F.row_number().over(w)).alias("isle")).groupBy("brick", "row", "isle").agg(F.min("col").alias("c0"), F.max("col").alias("c1")).drop("isle")


def label_runs(row: np.ndarray, c0: np.ndarray, c1: np.ndarray) -> np.ndarray:
    """Labels 1.. in raster order of each 8-connected component of sorted runs."""
    n = len(row)
    root = np.arange(n)
    if n:
        width = int(c1.max()) + 3
        lo, hi = (row + 1) * width + c0 - 1, (row + 1) * width + c1 + 1  # runs of the next row that touch
        a = np.searchsorted(row * width + c1, lo, side="left")
        b = np.searchsorted(row * width + c0, hi, side="right")
        count = np.maximum(b - a, 0)
        left = np.repeat(np.arange(n), count)
        right = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(a, count)
        while True:
            x, y = root[left], root[right]
            if (x == y).all():
                break
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(root, root[root]):
                root = root[root]
    return np.unique(root, return_inverse=True)[1] + 1


def label_components(masked: DataFrame) -> DataFrame:
    """``masked`` with ``label``: 8-connected components, numbered by their first pixel in raster order.

    Only runs of mask pixels reach Python, a brick at a time: few per cent of an image, folded again.
    """

    def solve(brick: pd.DataFrame) -> pd.DataFrame:
        b = brick.sort_values(["row", "c0"], kind="stable")
        b["label"] = label_runs(b["row"].to_numpy(np.int64), b["c0"].to_numpy(np.int64), b["c1"].to_numpy(np.int64)).astype(np.int32)
        return b[["brick", "row", "c0", "c1", "label"]]

    labelled = runs(masked).groupBy("brick").applyInPandas(solve, "brick string, row int, c0 int, c1 int, label int")
    cells = labelled.select("brick", "row", "label", F.explode(F.expr("sequence(c0, c1)")).alias("col"))
    return masked.join(cells, ["brick", "row", "col"])


def components(labels: DataFrame) -> DataFrame:
    """One row per label: count, bounding box, greatest signal to noise and its first pixel."""
    first = F.struct(F.col("snr"), -F.col("row"), -F.col("col"))
    return labels.groupBy("brick", "label").agg(
        F.count("*").cast("int").alias("npix"), F.min("row").alias("rmin"), F.max("row").alias("rmax"), F.min("col").alias("cmin"), F.max("col").alias("cmax"),
        F.max("snr").alias("peak_snr"), F.max_by(F.struct("row", "col"), first).alias("p"),
    ).select("brick", "label", "npix", "rmin", "rmax", "cmin", "cmax", "peak_snr", F.col("p.row").alias("peak_row"), F.col("p.col").alias("peak_col"))


def detections(labels: DataFrame, cfg: DetectConfig) -> DataFrame:
    return components(labels).where(F.col("npix") >= cfg.minarea)


def by_snr(found: DataFrame) -> DataFrame:
    return found.orderBy(F.desc("peak_snr"), "brick", "label")
