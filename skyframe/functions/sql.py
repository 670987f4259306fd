"""The engine in SQL: a table function for detection and views over one set of images.

    SELECT * FROM detect_sources(TABLE(pixel) PARTITION BY (brick), 64, 1.5D)

takes each image of ``pixel(brick, row, col, v)`` to one task and gives its catalog in pixel
coordinates.  ``create_views`` names the steps of the relational form: ``pixel, bg_grid, detection,
catalog``.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.functions import udtf

from ..config import BackgroundConfig, DetectConfig, MeasureConfig
from ..operators import background, detect
from ..plans import pipeline, tile
from ..plans.durable import cut

FOUND = "brick string, label int, npix int, x double, y double, a double, b double, theta double, ellipticity double, kron_radius double, flux_iso double, flux_auto double, flags int, peak_snr double, peak_row int, peak_col int, rmin int, rmax int, cmin int, cmax int"
NAMES = [c.split()[0] for c in FOUND.split(", ")]


class DetectSources:
    """Gathers the pixels of one partition, an image, in flat arrays; missing pixels count as NULL."""

    def __init__(self) -> None:
        self.rows, self.cols, self.values, self.brick, self.settings = array("i"), array("i"), array("d"), None, (64, 1.5)

    def eval(self, pixel: Row, mesh: int = 64, thresh: float = 1.5) -> None:
        self.brick, self.settings = pixel["brick"], (int(mesh), float(thresh))
        self.rows.append(pixel["row"])
        self.cols.append(pixel["col"])
        self.values.append(float("nan") if pixel["v"] is None else pixel["v"])

    def terminate(self) -> Iterator[tuple]:
        if not len(self.rows):
            return
        r, c = np.frombuffer(self.rows, np.int32), np.frombuffer(self.cols, np.int32)
        image = np.full((r.max() + 1, c.max() + 1), np.nan)
        image[r, c] = np.frombuffer(self.values, np.float64)
        mesh, thresh = self.settings
        found = tile.process(image, None, BackgroundConfig(mesh), DetectConfig(thresh=thresh), MeasureConfig())
        for values in zip(*(found[n].tolist() for n in NAMES[1:])):
            yield (self.brick, *values)


def register(spark: SparkSession) -> None:
    """Make ``detect_sources`` known to the session."""
    spark.udtf.register("detect_sources", udtf(DetectSources, returnType=FOUND))


def create_views(px: DataFrame, dims: DataFrame, wcs: DataFrame, bcfg: BackgroundConfig = BackgroundConfig(), dcfg: DetectConfig = DetectConfig(), mcfg: MeasureConfig = MeasureConfig(), suffix: str = "") -> None:
    """Temporary views ``pixel, bg_grid, detection, catalog`` (with ``suffix``) over a dense pixel relation.

    Filtered pixels and labels are written once; the views read them.
    """
    filtered = cut(pipeline.filtered(px, bcfg, dcfg))
    labels = cut(pipeline.labelled(filtered, dcfg))
    for name, rows in (
        ("pixel", px), ("bg_grid", background.grid(px, bcfg)), ("detection", detect.detections(labels, dcfg)), ("catalog", pipeline.measured_from(filtered, dims, wcs, dcfg, mcfg)),
    ):
        rows.createOrReplaceTempView(name + suffix)
