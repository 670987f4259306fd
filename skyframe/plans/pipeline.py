"""Whole pipelines: one image, a folder of images, and the relational form over any pixel relation."""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from contextlib import nullcontext

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import BackgroundConfig, DedupConfig, DetectConfig, MeasureConfig
from ..operators import background, convolve, detect, measure, mosaic
from ..functions.scalar import brick_name
from ..operators.dedup import deduplicate
from ..sources import fits, images
from . import tile
from .durable import cut, tune
from .progress import Progress

CATALOG = "brick string, label int, npix int, x double, y double, ra double, dec double, a double, b double, theta double, ellipticity double, kron_radius double, flux_iso double, flux_auto double, flags short, peak_snr double, peak_row int, peak_col int, rmin int, rmax int, cmin int, cmax int"
COLUMNS = [c.split()[0] for c in CATALOG.split(", ")]


def dimensions(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("brick").agg((F.max("row") + 1).alias("nrows"), (F.max("col") + 1).alias("ncols"))


def filtered(pixels: DataFrame, bcfg: BackgroundConfig, dcfg: DetectConfig, tile: int | None = None) -> DataFrame:
    """``pixels`` with ``bg, rms, res, f, snr``; with ``tile``, filtered a sub-tile at a time."""
    full = background.residual(background.interpolate(pixels, background.grid(pixels, bcfg), bcfg.mesh))
    return detect.snr_map(mosaic.smooth(full, "res", dcfg.sigma, tile, dcfg.truncate) if tile else convolve.smooth(full, "res", dcfg.sigma, dcfg.truncate))


def masked_strips(sparse: DataFrame, nrows: int, ncols: int, bcfg: BackgroundConfig, dcfg: DetectConfig, rows: int) -> DataFrame:
    """Mask pixels ``brick, row, col, snr`` of images given by their pixels other than 0, ``brick, row, col, v``.

    A task filters a strip of about ``rows`` rows, with as many rows around as bear on it: those of the kernel,
    and the mesh cells between which their background is interpolated.  Only its own pixels leave.
    """
    high = bcfg.mesh * -(-rows // bcfg.mesh)
    halo = bcfg.mesh * (-(-math.ceil(dcfg.truncate * dcfg.sigma) // bcfg.mesh) + 1)

    def work(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        top = key[1] * high
        lo, hi = max(0, top - halo), min(nrows, top + high + halo)
        p = part[part["v"].notna()]
        px = np.zeros((hi - lo, ncols))
        px[p["row"].to_numpy(np.int64) - lo, p["col"].to_numpy(np.int64)] = p["v"]
        snr = tile.signal(px, bcfg, dcfg)[1][top - lo : top - lo + high]
        r, c = np.nonzero(snr > dcfg.thresh)
        return pd.DataFrame({"brick": key[0], "row": r + top, "col": c, "snr": snr[r, c]})

    last = (nrows - 1) // high
    near = f"sequence(greatest(cast(floor((row - {halo}) / {high}D) as int), 0), least(cast(floor((row + {halo}) / {high}D) as int), {last}))"
    seen = sparse.select("brick", F.explode(F.expr(near)).alias("strip"), "row", "col", "v")
    none = sparse.select("brick").distinct().select("brick", F.explode(F.expr(f"sequence(0, {last})")).alias("strip"), F.lit(None).cast("int").alias("row"), F.lit(None).cast("int").alias("col"), F.lit(None).cast("double").alias("v"))
    return seen.unionByName(none).groupBy("brick", "strip").applyInPandas(work, "brick string, row int, col int, snr double")


def labelled(px: DataFrame, dcfg: DetectConfig, tile: int | None = None) -> DataFrame:
    """Mask pixels of filtered ``px`` with ``label``."""
    masked = detect.mask(px, dcfg.thresh)
    return mosaic.label_components(masked, tile) if tile else detect.label_components(masked)


def measured(pixels: DataFrame, dims: DataFrame, wcs: DataFrame, bcfg: BackgroundConfig, dcfg: DetectConfig, mcfg: MeasureConfig, tile: int | None = None) -> DataFrame:
    """The catalog of a dense pixel relation, in DataFrame operations except for labelling.

    The filtered pixels feed mask, moments and aperture, so they are written once; so are the labels.
    Images that do not fit a task are cut into sub-tiles of ``tile`` pixels.
    """
    px = cut(filtered(pixels, bcfg, dcfg, tile))
    return measured_from(px, dims, wcs, dcfg, mcfg, tile)


def measured_from(px: DataFrame, dims: DataFrame, wcs: DataFrame, dcfg: DetectConfig, mcfg: MeasureConfig, tile: int | None = None) -> DataFrame:
    """``measured`` from filtered pixels that are cheap to read again."""
    labels = cut(labelled(px, dcfg, tile))
    found = detect.detections(labels, dcfg)
    foot = measure.footprint(labels, found)
    shape = measure.kron_radius(foot, measure.moments(foot), mcfg)
    shape = measure.kron_flux(shape, px, dims, mcfg)
    shape = measure.sky_position(measure.edge_flags(shape, dims), wcs)
    return shape.join(found.select("brick", "label", "peak_snr", "peak_row", "peak_col"), ["brick", "label"]).select(*COLUMNS)


def _frame(brick: str, cols: dict[str, np.ndarray]) -> pd.DataFrame:
    out = pd.DataFrame(cols)
    out["brick"] = brick
    for c in ("ra", "dec"):
        out[c] = out[c].astype(object).where(out[c].notna(), None)
    return out[COLUMNS]


def catalog_of_tiles(tiles: DataFrame, bcfg: BackgroundConfig = BackgroundConfig(), dcfg: DetectConfig = DetectConfig(), mcfg: MeasureConfig = MeasureConfig()) -> DataFrame:
    """Catalog rows of ``tiles(brick, nrows, ncols, wcs, data)``: an image a task, no shuffle."""
    tune(tiles.sparkSession)
    good = tiles.where("data is not null").select("brick", "nrows", "ncols", "wcs", "data")

    def run(batches):
        for b in batches:
            for r in b.to_dict("records"):
                image = np.asarray(r["data"], np.float64).reshape(int(r["nrows"]), int(r["ncols"]))
                w = r["wcs"]
                w = w if isinstance(w, dict) and all(v is not None for v in w.values()) else None
                yield _frame(r["brick"], tile.process(image, w, bcfg, dcfg, mcfg))

    return good.mapInPandas(run, CATALOG)


def to_tiles(pixels: DataFrame, dims: DataFrame, wcs: DataFrame | None = None) -> DataFrame:
    """A dense pixel relation packed to one row a brick."""
    order = F.expr("transform(array_sort(collect_list(struct(row, col, v))), p -> cast(p.v as float))")
    t = pixels.groupBy("brick").agg(order.alias("data")).join(dims, "brick")
    if wcs is None:
        return t.withColumn("wcs", F.lit(None).cast(images.WCS_TYPE))
    return t.join(wcs.select("brick", "wcs"), "brick", "left")


def catalog_of_files(files: DataFrame, bcfg: BackgroundConfig = BackgroundConfig(), dcfg: DetectConfig = DetectConfig(), mcfg: MeasureConfig = MeasureConfig(), progress: Progress | None = None) -> DataFrame:
    """Catalog rows of image files ``(path, content)``: decoded and measured in the task that reads them.

    A file that cannot be read gives one row with ``error_kind`` and ``error`` and no source.
    ``progress`` is told of every file.
    """
    tune(files.sparkSession)
    seen = progress and progress.seen
    named = files.select("path", brick_name(F.col("path"), F.lit("unknown")).alias("brick"), "content")

    def run(batches):
        for b in batches:
            for path, brick, content in zip(b["path"], b["brick"], b["content"]):
                began, failed = time.perf_counter(), None
                try:
                    image, w = fits.read_image(bytes(content))
                    out = _frame(brick, tile.process(image, w, bcfg, dcfg, mcfg)).assign(path=path, error_kind=None, error=None)
                except fits.FitsError as e:
                    failed = str(e)
                    out = pd.DataFrame([{c: None for c in COLUMNS} | {"brick": brick, "path": path, "error_kind": e.kind, "error": failed}])
                if seen is not None:
                    seen.add({path: (brick, 0 if failed else len(out), time.perf_counter() - began, failed)})
                yield out

    return named.mapInPandas(run, CATALOG + ", path string, error_kind string, error string")


def process_brick(spark: SparkSession, path: str, **cfg) -> DataFrame:
    """Catalog of one file, detections by falling signal to noise; a bad file raises."""
    folder, _, name = path.rpartition("/")
    rows = cut(catalog_of_files(spark.read.format("binaryFile").option("pathGlobFilter", name).load(folder or "."), **cfg))
    _raise(rows)
    return rows.select(*COLUMNS).orderBy(F.desc("peak_snr"), "label")


def _raise(rows: DataFrame) -> None:
    bad = rows.where("error is not null").first()
    if bad:
        raise OSError(f"{bad.path}: {bad.error}")


def run(spark: SparkSession, data_dir: str, band: str = "r", dedup_arcsec: float = 1.0, same_brick: bool = True, on_error: str = "skip", say: Callable[[str], None] | None = None, **cfg) -> DataFrame:
    """Combined, de-duplicated catalog of a folder in right-ascension order; ``say`` gets a line an image.

    ``same_brick`` also merges inside a brick.  A folder without images raises; bad files are left
    out, or raise with ``on_error="fail"``.  Images are measured once: the raw catalog is written
    before de-duplication reads it.
    """
    files = images._files(spark, data_dir, f"legacysurvey-*-image-{band}.fits.fz")
    total = files.select("path").count()
    if not total:
        raise ValueError(f"no images of band {band} in {data_dir}")
    return combined(files.repartition(total, "path"), dedup_arcsec, same_brick, on_error, say and Progress(spark, total, say), **cfg)


def combined(files: DataFrame, dedup_arcsec: float = 1.0, same_brick: bool = True, on_error: str = "skip", progress: Progress | None = None, **cfg) -> DataFrame:
    """``run`` over given files ``(path, content)``."""
    with progress or nullcontext():
        rows = cut(catalog_of_files(files, progress=progress, **cfg))
    if on_error == "fail":
        _raise(rows)
    # rows keep the order of files and detections on ties
    key = F.concat_ws("|", "brick", F.format_string("%020.6f", 1e9 - F.col("peak_snr")), F.format_string("%010d", "label"))
    cat = rows.where("error is null").select(*COLUMNS, key.alias("id"))
    return deduplicate(cat, DedupConfig(dedup_arcsec, same_brick)).drop("id")
