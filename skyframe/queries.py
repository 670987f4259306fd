"""Registered queries: every operator over the supplied tables, with DuckDB SQL where SQL can say it.

Image queries run on ``lin_px`` with a mesh of 16 and a threshold of 0.5.  Sums of floats are
quantised with ``floor(x * 1e6 + 0.5) / 1e6`` on both sides.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import BackgroundConfig, DedupConfig, DetectConfig, MeasureConfig
from .functions import sql
from .functions.scalar import brick_name, finite, is_brick, megapixels, pix_to_sky, plate_scale, q
from .operators import background, convolve, dedup, detect, measure, mosaic, summaries, viewer
from .plans import pipeline
from .plans.durable import cut, shared_dir
from .sources import fits, sinks, strips, views

BG, DET, MES = BackgroundConfig(mesh=16), DetectConfig(thresh=0.5), MeasureConfig()
VIEW = {"cx": 400.0, "cy": 300.0, "pan_x": 32.0, "pan_y": 32.0, "zoom": 8.0}
SIDE = views.LIN_SIDE


# ---------------------------------------------------------------- Spark


class Stages:
    """The steps of one run over ``lin_px``; filtered pixels and labels are written once, the rest are plans."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.px, self.dims, self.wcs = spark, views.lin_px(spark, sf_dir), views.dims(spark), views.wcs(spark)

    grid = property(lambda s: background.grid(s.px, BG))
    full = property(lambda s: background.interpolate(s.px, s.grid, BG.mesh))
    res = property(lambda s: background.residual(s.full))
    smooth = property(lambda s: convolve.smooth(s.res, "res", DET.sigma))
    snr = property(lambda s: detect.snr_map(s.smooth))
    filtered = cached_property(lambda s: cut(s.snr))
    mask = property(lambda s: detect.mask(s.filtered, DET.thresh))
    labels = cached_property(lambda s: cut(detect.label_components(s.mask)))
    found = property(lambda s: detect.detections(s.labels, DET))

    @property
    def catalog(self) -> DataFrame:
        return pipeline.measured_from(self.filtered, self.dims, self.wcs, DET, MES)

    def shape(self) -> tuple[DataFrame, DataFrame]:
        labels = self.labels
        foot = measure.footprint(labels, detect.detections(labels, DET))
        return foot, measure.moments(foot)


def _q(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: q(F.col(n), digits) for n in names})


def _lin(f: Callable[[Stages], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(Stages(spark, sf_dir))


PIXEL = ("brick", "row", "col")
DETECTION = ("brick", "label", "npix", "rmin", "rmax", "cmin", "cmax", "peak_snr", "peak_row", "peak_col")
SOURCE_COLS = ("brick", "label", "npix", "x", "y", "ra", "dec", "a", "b", "theta", "ellipticity", "kron_radius", "flux_iso", "flux_auto", "flags", "peak_snr")
FLOATS = ("x", "y", "ra", "dec", "a", "b", "theta", "ellipticity", "kron_radius", "flux_iso", "flux_auto", "peak_snr")


def _wcs_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners and centre of an image for each supplier's projection, some of them rotated and some missing."""
    n = F.col("s_nationkey").cast("double")
    pts = views.supplier_wcs(spark, sf_dir).select("s_suppkey", "s_nationkey", "wcs", F.explode(F.array(*[F.struct(F.lit(k).alias("point"), (n * a + b).alias("x"), (n * c + d).alias("y")) for k, a, b, c, d in POINTS])).alias("p"))
    ra, dec = pix_to_sky("wcs", F.col("p.x"), F.col("p.y"))
    side = F.col("s_nationkey").cast("int") * 100 + 500
    return _q(pts.select("s_suppkey", "p.point", ra.alias("ra"), dec.alias("dec"), plate_scale("wcs").alias("scale"), megapixels(side, side + 17).cast("long").alias("megapixels")), "ra", "dec", "scale", digits=7)


POINTS = (("first", 0, 0, 0, 0), ("centre", 0.5, 31.5, 0.5, 40.0), ("last", 1, 63, 1, 80), ("far", -3, 100, 7, -3))


def _field_of_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extent in right ascension of each supplier's image."""
    w = views.supplier_wcs(spark, sf_dir)
    last = F.col("s_nationkey").cast("double") + 63.0
    a, b = pix_to_sky("wcs", F.lit(0.0), F.lit(0.0)), pix_to_sky("wcs", last, last)
    return _q(w.select("s_suppkey", F.abs(b[0] - a[0]).alias("fov")), "fov", digits=7)


def _first_pass(s: Stages) -> DataFrame:
    """Median, scatter and kept pixels of a single clipping pass."""
    cells = s.px.groupBy("brick", F.expr(f"row div {BG.mesh}").cast("int").alias("gr"), F.expr(f"col div {BG.mesh}").cast("int").alias("gc")).agg(F.array_sort(F.collect_list("v")).alias("px"))
    return cells.select("brick", "gr", "gc", F.size(background.clip("px", BG.kappa, 1)["px"]).cast("long").alias("kept"), F.expr("element_at(px, cast(size(px) div 2 + 1 as int))").alias("median"))


def _kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The taps of a filter whose width grows with the key of a nation."""

    def run(batches):
        for b in batches:
            for key in b["n_nationkey"]:
                taps = convolve.gaussian_kernel(0.5 + int(key) / 8)
                yield pd.DataFrame({"n_nationkey": int(key), "k": np.arange(len(taps), dtype=np.int32) - len(taps) // 2, "tap": taps})

    return _q(views.table(spark, sf_dir, "nation").select("n_nationkey").mapInPandas(run, "n_nationkey long, k int, tap double"), "tap", digits=9)


def _raw_kron(s: Stages) -> DataFrame:
    foot, shape = s.shape()
    return _q(measure.raw_kron_radius(foot, shape), "raw_kron")


def _kron_flux(s: Stages) -> DataFrame:
    foot, shape = s.shape()
    shape = measure.kron_radius(foot, shape, MES)
    return _q(measure.kron_flux(shape, s.filtered, s.dims, MES).select("brick", "label", "kron_radius", "flux_auto"), "kron_radius", "flux_auto")


def _catalog(s: Stages) -> DataFrame:
    return _q(s.catalog.select(*SOURCE_COLS), *FLOATS)


def _tile_catalog(s: Stages) -> DataFrame:
    """The numpy form of the whole pipeline over the same pixels; same rows as ``measurements``."""
    tiles = pipeline.to_tiles(s.px, s.dims, s.wcs)
    return _q(pipeline.catalog_of_tiles(tiles, BG, DET, MES).select(*SOURCE_COLS), *FLOATS)


def _edge_flags(s: Stages) -> DataFrame:
    return measure.edge_flags(s.found.select("brick", "label", "rmin", "rmax", "cmin", "cmax"), s.dims).select("brick", "label", F.col("flags").cast("int").alias("flags"))


def _csv_rows(s: Stages) -> DataFrame:
    return sinks.csv_lines(s.catalog, True).select("brick", "label", "line")


def _brick_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = views.brick_files(spark, sf_dir)
    return f.select("path", is_brick(F.col("path"), "r").alias("chosen"), brick_name(F.col("path"), F.lit("unknown")).alias("brick")).orderBy("path")


def _cat_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Right-ascension order with missing positions last."""
    c = views.sky(spark, sf_dir).withColumn("ra", F.expr("if(id % 70 = 0, null, ra)"))
    return dedup.numbered(c).select("id", F.col("place").cast("long").alias("place"))


def _null_px(s: Stages) -> DataFrame:
    """Pixels of which one in eleven is no number."""
    bad = F.when(F.col("row") % 2 == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))
    return s.px.withColumn("v", finite(F.when((F.col("row") * 7 + F.col("col") * 3) % 11 == 0, bad).otherwise(F.col("v"))))


def _files(s: Stages) -> DataFrame:
    """The bricks as compressed image files, and one file that is broken."""

    def run(batches):
        for b in batches:
            for r in b.to_dict("records"):
                w = r["wcs"] if isinstance(r["wcs"], dict) and all(v is not None for v in r["wcs"].values()) else None
                image = fits.write_rice_image(np.asarray(r["data"], np.float64).reshape(r["nrows"], r["ncols"]), w)
                yield pd.DataFrame({"path": [f"/data/legacysurvey-{r['brick']}-image-r.fits.fz"], "content": [image]})

    good = pipeline.to_tiles(s.px, s.dims, s.wcs).select("brick", "nrows", "ncols", "data", "wcs").mapInPandas(run, "path string, content binary")
    return good.unionByName(s.spark.createDataFrame([("/data/legacysurvey-bad-image-r.fits.fz", bytearray(b"broken"))], good.schema))


def _run_files(s: Stages) -> DataFrame:
    """The whole run from files to a combined catalog; no two sources of these bricks lie within the tolerance."""
    return _q(pipeline.combined(_files(s), dedup_arcsec=1e-3, bcfg=BG, dcfg=DET, mcfg=MES).select(*SOURCE_COLS), *FLOATS)


OVERLAP = 6.0  # seconds of arc between the corners of neighbouring bricks
NEAR = DedupConfig(2.0, True)


def _run_overlap(s: Stages) -> DataFrame:
    """The whole run over bricks that lie over each other, so that de-duplication takes sources out."""
    s.wcs = s.wcs.withColumn("wcs", F.col("wcs").withField("crval1", F.lit(187.0) + F.col("brick").cast("int") * (OVERLAP / 3600)))
    return _q(pipeline.combined(_files(s), NEAR.tolerance_arcsec, NEAR.same_brick, bcfg=BG, dcfg=DET, mcfg=MES).select(*SOURCE_COLS), *FLOATS)


def _forms_compared(s: Stages) -> DataFrame:
    """Sources of the relational and of the tile form for each brick, and how many agree in place, size and flux."""
    a = _q(s.catalog.select("brick", "npix", "x", "y", "flux_auto"), "x", "y", "flux_auto")
    b = _q(pipeline.catalog_of_tiles(pipeline.to_tiles(s.px, s.dims, s.wcs), BG, DET, MES).select("brick", "npix", "x", "y", "flux_auto"), "x", "y", "flux_auto")
    both = a.withColumn("form", F.lit(1)).unionByName(b.withColumn("form", F.lit(2))).groupBy("brick", "npix", "x", "y", "flux_auto").agg(F.count_if(F.col("form") == 1).alias("n1"), F.count_if(F.col("form") == 2).alias("n2"))
    return both.groupBy("brick").agg(F.sum("n1").alias("relational"), F.sum("n2").alias("tile"), F.sum(F.least("n1", "n2")).alias("agreeing"))


def _file_errors(s: Stages) -> DataFrame:
    rows = pipeline.catalog_of_files(_files(s), BG, DET, MES)
    return rows.where("error is not null").select("path", "error_kind").unionByName(rows.where("error is null").select("path", F.lit("none").alias("error_kind")).distinct())


def _wcs_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier's projection written to the header of an image of one of three kinds, whole or with one key missing, and read back."""
    keys = [k.lower() for k in fits.WCS_KEYS]

    def run(batches):
        for b in batches:
            rows = []
            for r in b.to_dict("records"):
                given = r["wcs"] if isinstance(r["wcs"], dict) else dict.fromkeys(keys)
                coords = {k: given[k] for k in keys if given[k] is not None and k != r["missing"]}
                x = np.arange(12).reshape(3, 4) + int(r["s_nationkey"])
                data = fits.write_rice_image(x, coords) if r["kind"] == "tiles" else fits.write_image(x, -32, coords, leading_empty=r["kind"] == "extension")
                image, w = fits.read_image(data)
                rows.append((int(r["s_suppkey"]), r["kind"], int(image.sum()), *(w or dict.fromkeys(keys)).values()))
            yield pd.DataFrame(rows, columns=["s_suppkey", "kind", "total", *keys]).astype(dict.fromkeys(keys, float))

    kind, missing = F.expr("element_at(array('primary', 'extension', 'tiles'), cast(s_suppkey % 3 + 1 as int))"), F.get(F.array(*map(F.lit, keys)), (F.col("s_suppkey") % 13).cast("int"))
    cases = views.supplier_wcs(spark, sf_dir).withColumn("kind", kind).withColumn("missing", missing)
    out = cases.mapInPandas(run, "s_suppkey long, kind string, total long, " + ", ".join(f"{k} double" for k in keys))
    return _q(out.select("s_suppkey", "kind", "total", *[F.nanvl(F.col(k), F.lit(None)).alias(k) for k in keys]), *keys, digits=9)


def _csv_single(s: Stages) -> DataFrame:
    return sinks.csv_lines(s.catalog, False).select("brick", "label", "line")


def _pairs(same: bool) -> Callable[[SparkSession, str], DataFrame]:
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = dedup.candidate_pairs(views.sky(spark, sf_dir), DedupConfig(same_brick=same))
        return _q(p.select("id_i", "id_j", "sep"), "sep")

    return f


def _removed(same: bool) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: dedup.removed(views.sky(spark, sf_dir), DedupConfig(same_brick=same)).select("id")


def _final(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views.sky(spark, sf_dir)
    return c.join(dedup.removed(c, DedupConfig()), "id", "left_anti").agg(F.count("*").alias("n"), F.sum("npix").cast("long").alias("npix"), F.sum("id").cast("long").alias("ids"))


def _stretch(s: Stages) -> DataFrame:
    z = viewer.zscale(s.px, s.dims)
    g = s.px.join(z, "brick").select("brick", viewer.stretch(F.col("v"), F.col("z1"), F.col("z2"), 5.0).alias("grey"))
    return g.groupBy("brick", "grey").agg(F.count("*").alias("n"))


def _outline(s: Stages) -> DataFrame:
    o = viewer.outline(s.catalog).select("brick", "label", F.posexplode("points").alias("i", "p"))
    return _q(o.select("brick", "label", "i", F.col("p.px").alias("px"), F.col("p.py").alias("py")), "px", "py")


def _viewport(s: Stages) -> DataFrame:
    v = viewer.in_viewport(s.catalog, VIEW | {"zoom": 30.0})
    return _q(v.select("brick", "label", "sx", "sy", viewer.colour_class(F.col("label") == 1).alias("colour")), "sx", "sy")


def _nearest(s: Stages) -> DataFrame:
    return _q(viewer.nearest(s.catalog, 30.0, 20.0, 8.0).select("brick", "label", "dist"), "dist")


def _event_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = views.evt_px(spark, sf_dir)
    labels = cut(detect.label_components(detect.mask(pipeline.filtered(px, BackgroundConfig(mesh=8), DET), DET.thresh)))
    return _q(detect.detections(labels, DET), "peak_snr")


def _embedding_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ragged image of real floats."""
    px = pipeline.filtered(views.emb_px(spark, sf_dir), BG, DET)
    labels = cut(detect.label_components(detect.mask(px, DET.thresh)))
    return _q(detect.detections(labels, DET), "peak_snr")


def _image_roundtrip(encode) -> Callable[[Stages], DataFrame]:
    """Pixels written as FITS images and read back."""

    def f(s: Stages) -> DataFrame:
        def run(batches):
            for b in batches:
                for r in b.to_dict("records"):
                    image, _ = fits.read_image(encode(np.asarray(r["data"], np.float64).reshape(r["nrows"], r["ncols"])))
                    yield pd.DataFrame({"brick": r["brick"], "row": np.repeat(np.arange(image.shape[0]), image.shape[1]).astype(np.int32), "col": np.tile(np.arange(image.shape[1]), image.shape[0]).astype(np.int32), "v": image.ravel().astype(float)})

        return pipeline.to_tiles(s.px, s.dims).select("brick", "nrows", "ncols", "data").mapInPandas(run, "brick string, row int, col int, v double")

    return f


TABLE_FLOATS = {"flux_iso": "FLUX_ISO", "flux_auto": "FLUX_AUTO", "a": "A_IMAGE", "b": "B_IMAGE", "theta": "THETA", "ellipticity": "ELLIP", "kron_radius": "KRON_RAD"}


def _single_table(s: Stages) -> DataFrame:
    """The catalog of each brick written as its own FITS table and read back, all columns."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.astype(object).where(group.notna(), None).to_dict("records")
        brick = rows[0]["brick"]
        data = fits.table_header(len(rows), False, "r", brick) + fits.table_rows(rows, False)
        t, first = fits.read_table(data), next(fits.hdus(data))[0]
        out = {c: t[n].astype(float) for c, n in {"x": "X_IMAGE", "y": "Y_IMAGE", "ra": "RA", "dec": "DEC", **TABLE_FLOATS}.items()}
        return pd.DataFrame({"brick": str(first["OBJECT"]).strip(), "band": str(first["FILTER"]).strip(), **out, "npix": t["NPIX"].astype(np.int32), "flags": t["FLAGS"].astype(np.int16)})

    kinds = "brick string, band string, x double, y double, ra double, dec double, " + ", ".join(f"{c} double" for c in TABLE_FLOATS) + ", npix int, flags short"
    out = s.catalog.groupBy("brick").applyInPandas(run, kinds)
    out = out.withColumns({c: F.nanvl(F.col(c), F.lit(None)) for c in ("ra", "dec")})
    return _q(_q(out, "x", "y", "ra", "dec"), *TABLE_FLOATS, digits=2)


def _catalog_roundtrip(s: Stages) -> DataFrame:
    """The catalog written as a FITS table and read back."""

    def run(batches):
        for b in batches:
            rows = b.astype(object).where(b.notna(), None).to_dict("records")
            t = fits.read_table(fits.table_header(len(rows), True, "r") + fits.table_rows(rows, True))
            yield pd.DataFrame({"brick": [x.decode().strip() for x in t["BRICK"]], "x": t["X_IMAGE"].astype(float), "y": t["Y_IMAGE"].astype(float), "ra": [None if np.isnan(x) else float(x) for x in t["RA"]], "npix": t["NPIX"].astype(np.int32), "flags": t["FLAGS"].astype(np.int16)})

    return _q(s.catalog.mapInPandas(run, "brick string, x double, y double, ra double, npix int, flags short"), "x", "y", "ra")


def _fits_file(s: Stages) -> DataFrame:
    """The catalog as one FITS file that its tasks write, read back in the order of the file."""
    path = f"{shared_dir(s.spark)}/skyframe/files/{uuid.uuid4().hex}.fits"
    os.makedirs(os.path.dirname(sinks.whole_file.mounted(path)), exist_ok=True)
    sinks.write_fits(s.catalog.orderBy("brick", "label"), path)
    out = sinks.read_fits(s.spark, path).select("place", "brick", "x", "y", "ra", "dec", *TABLE_FLOATS, "npix", "flags")
    return _q(_q(out, "x", "y", "ra", "dec"), *TABLE_FLOATS, digits=2)


def _csv_file(s: Stages) -> DataFrame:
    path = f"{shared_dir(s.spark)}/skyframe/files/{uuid.uuid4().hex}.csv"
    os.makedirs(os.path.dirname(sinks.whole_file.mounted(path)), exist_ok=True)
    sinks.write_csv(s.catalog.orderBy("brick", "label"), path)
    return sinks.read_csv(s.spark, path).select(F.col("value").alias("line"))


def _sql_detect(s: Stages) -> DataFrame:
    """The table function, an image a partition, over the pixels of the view."""
    name = f"_{uuid.uuid4().hex}"
    s.px.createOrReplaceTempView("pixel" + name)
    sql.register(s.spark)
    found = s.spark.sql(f"SELECT * FROM detect_sources(TABLE(pixel{name}) PARTITION BY (brick), {BG.mesh}, {DET.thresh}D)")
    cols = [c for c in SOURCE_COLS if c not in ("ra", "dec")]
    return _q(found.select(*cols), *[c for c in FLOATS if c in cols])


def _sql_views(s: Stages) -> DataFrame:
    """A report in SQL over the views of one run."""
    name = f"_{uuid.uuid4().hex}"
    sql.create_views(s.px, s.dims, s.wcs, BG, DET, MES, name)
    out = s.spark.sql(f"""SELECT p.brick, pixels, cells, level, found, sources, brightest, first_ra FROM (SELECT brick, count(*) AS pixels FROM pixel{name} GROUP BY brick) p
        JOIN (SELECT brick, count(*) AS cells, avg(bg) AS level FROM bg_grid{name} GROUP BY brick) g ON g.brick = p.brick
        LEFT JOIN (SELECT brick, count(*) AS found FROM detection{name} WHERE npix >= 10 GROUP BY brick) d ON d.brick = p.brick
        LEFT JOIN (SELECT brick, count(*) AS sources, max(flux_auto) AS brightest, min(ra) AS first_ra FROM catalog{name} GROUP BY brick) c ON c.brick = p.brick""")
    return _q(out, "level", "brightest", "first_ra")


def _written(s: Stages) -> str:
    """A folder of its own with the bricks as compressed image files."""
    folder = f"{shared_dir(s.spark)}/skyframe/files/{uuid.uuid4().hex}"
    sinks.write_files(_files(s).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content"), folder)
    return folder


def _strip_pixels(s: Stages) -> DataFrame:
    """Each image decoded by four tasks, each from its own bytes."""
    return strips.pixels(strips.read_strips(s.spark, _written(s), 4))


def _headers(s: Stages) -> DataFrame:
    """Sizes and coordinates from header blocks alone."""
    h = strips.headers(s.spark, _written(s))
    return _q(h.select("brick", "band", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("nrows", "ncols")], F.col("wcs.crval1").alias("crval1"), F.col("wcs.cd1_1").alias("cd1_1"), F.coalesce("error_kind", F.lit("none")).alias("error_kind")), "crval1", "cd1_1", digits=9)


TILE = SIDE // 4  # each brick as 16 sub-tiles


def _mosaic_catalog(s: Stages) -> DataFrame:
    return _q(pipeline.measured(s.px, s.dims, s.wcs, BG, DET, MES, TILE).select(*SOURCE_COLS), *FLOATS)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "scan_pixels": _lin(lambda s: s.px),
    "image_stats": _lin(lambda s: _q(summaries.image_stats(s.px), "vmean")),
    "sky_patch": _lin(lambda s: summaries.sky_patch(s.px, s.dims)),
    "wcs_points": _wcs_points,
    "field_of_view": _field_of_view,
    "clip_first_pass": _lin(_first_pass),
    "bg_grid": _lin(lambda s: _q(s.grid.withColumn("n", F.col("n").cast("long")), "bg", "rms")),
    "bg_summary": _lin(lambda s: _q(summaries.grid_summary(s.grid), "bg_min", "bg_max", "bg_mean", "rms_min", "rms_max", "rms_mean")),
    "bg_full": _lin(lambda s: _q(s.full.select(*PIXEL, "bg", "rms"), "bg", "rms")),
    "residual": _lin(lambda s: _q(s.res.select(*PIXEL, "res"), "res")),
    "residual_stats": _lin(lambda s: _q(summaries.residual_stats(s.res), "res_mean", "res_median", "res_rms")),
    "kernel": _kernel,
    "conv_h": _lin(lambda s: _q(convolve.convolve_axis(s.px, "v", "row", "col", convolve.gaussian_kernel(DET.sigma), "f").select(*PIXEL, "f"), "f")),
    "conv_hv": _lin(lambda s: _q(convolve.smooth(s.px, "v", DET.sigma).select(*PIXEL, "f"), "f")),
    "snr_map": _lin(lambda s: _q(s.snr.select(*PIXEL, "snr"), "snr")),
    "mask": _lin(lambda s: s.mask.select(*PIXEL)),
    "labels": _lin(lambda s: s.labels.select(*PIXEL, "label")),
    "components": _lin(lambda s: _q(detect.components(s.labels), "peak_snr")),
    "detections": _lin(lambda s: _q(detect.by_snr(s.found), "peak_snr")),
    "detection_summary": _lin(lambda s: _q(summaries.detection_summary(s.found), "npix_mean", "snr_min", "snr_max", "snr_mean")),
    "top10_snr": _lin(lambda s: _q(summaries.top(s.found, "peak_snr", 10).select("brick", "label", "npix", "peak_snr", (F.col("rmax") - F.col("rmin") + 1).alias("height"), (F.col("cmax") - F.col("cmin") + 1).alias("width")), "peak_snr")),
    "iso_flux_centroid": _lin(lambda s: _q(s.shape()[1].select("brick", "label", "npix", "flux_iso", "x", "y"), "flux_iso", "x", "y")),
    "moments_axes": _lin(lambda s: _q(s.shape()[1].select("brick", "label", "a", "b", "theta", "ellipticity"), "a", "b", "theta", "ellipticity")),
    "kron_radius": _lin(_raw_kron),
    "kron_flux": _lin(_kron_flux),
    "edge_flags": _lin(_edge_flags),
    "measurements": _lin(_catalog),
    "measurements_tile": _lin(_tile_catalog),
    "strips": _lin(_strip_pixels),
    "headers": _lin(_headers),
    "sql_detect": _lin(_sql_detect),
    "sql_views": _lin(_sql_views),
    "smooth_mosaic": _lin(lambda s: _q(mosaic.smooth(s.px, "v", DET.sigma, TILE).select(*PIXEL, "f"), "f")),
    "labels_mosaic": _lin(lambda s: mosaic.label_components(s.mask, TILE).select(*PIXEL, "label")),
    "measurements_mosaic": _lin(_mosaic_catalog),
    "top15_flux": _lin(lambda s: _q(summaries.top(s.catalog, "flux_auto", 15).select("brick", "label", "flux_auto"), "flux_auto")),
    "flux_stats": _lin(lambda s: _q(summaries.flux_stats(s.catalog), "flux_mean", "flux_median", "flux_max")),
    "brick_names": _brick_names,
    "ra_sorted": _cat_order,
    "dedup_pairs": _pairs(False),
    "dedup_pairs_any": _pairs(True),
    "dedup_removed": _removed(False),
    "dedup_removed_any": _removed(True),
    "dedup_final": _final,
    "csv_rows": _lin(_csv_rows),
    "zscale": _lin(lambda s: viewer.zscale(s.px, s.dims)),
    "stretch_hist": _lin(_stretch),
    "ellipse_points": _lin(_outline),
    "viewport_filter": _lin(_viewport),
    "nearest_source": _lin(_nearest),
    "event_detections": _event_detections,
    "embedding_detections": _embedding_detections,
    "fits_roundtrip": _lin(_image_roundtrip(lambda x: fits.write_image(x, -32))),
    "rice_roundtrip": _lin(_image_roundtrip(fits.write_rice_image)),
    "catalog_roundtrip": _lin(_catalog_roundtrip),
    "single_table": _lin(_single_table),
    "csv_single": _lin(_csv_single),
    "fits_file": _lin(_fits_file),
    "csv_file": _lin(_csv_file),
    "run_files": _lin(_run_files),
    "run_overlap": _lin(_run_overlap),
    "forms_compared": _lin(_forms_compared),
    "file_errors": _lin(_file_errors),
    "wcs_headers": _wcs_headers,
    "null_stats": _lin(lambda s: _q(summaries.image_stats(_null_px(s)), "vmean")),
    "null_grid": _lin(lambda s: _q(background.grid(_null_px(s), BG).withColumn("n", F.col("n").cast("long")), "bg", "rms")),
    "null_smooth": _lin(lambda s: _q(convolve.smooth(_null_px(s), "v", DET.sigma).select(*PIXEL, "f"), "f")),
}


# ---------------------------------------------------------------- DuckDB

TAPS = convolve.gaussian_kernel(DET.sigma)


def _taps(value: str, part: str, order: str, taps: list[float] = TAPS) -> str:
    terms = []
    for k, t in enumerate(taps):
        d = k - len(taps) // 2
        x = value if d == 0 else f"coalesce({'lag' if d < 0 else 'lead'}({value}, {abs(d)}) OVER w, {'first_value' if d < 0 else 'last_value'}({value}) OVER a)"
        terms.append(f"{t!r}e0 * {x}")
    return f"SELECT *, {' + '.join(terms)} AS {{out}} FROM {{src}} WINDOW w AS (PARTITION BY brick, {part} ORDER BY {order}), a AS (PARTITION BY brick, {part} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"


def _sql_q(x: str, digits: int = 6) -> str:
    return f"floor(({x}) * 1e{digits} + 0.5e0) / 1e{digits}"


def _ctes(source: str, nrows: int | str, ncols: int, mesh: int, det: DetectConfig = DET) -> dict[str, str]:
    """The steps over the pixels of ``source``; ``nrows`` may be a scalar subquery."""
    taps = convolve.gaussian_kernel(det.sigma)
    corner = lambda g, dr, dc: f"JOIN g g{dr}{dc} ON g{dr}{dc}.brick = p.brick AND g{dr}{dc}.gr = least(greatest(p.r0 + {dr}, 0), p.mr) AND g{dr}{dc}.gc = least(greatest(p.c0 + {dc}, 0), p.mc)"
    blend = lambda c: f"g00.{c} * (1 - p.dr) * (1 - p.dc) + g01.{c} * (1 - p.dr) * p.dc + g10.{c} * p.dr * (1 - p.dc) + g11.{c} * p.dr * p.dc"
    ell = "(({u}) / a) * (({u}) / a) + (({w}) / b) * (({w}) / b)".format(u="(k.col - s.x) * cos(radians(theta)) + (k.row - s.y) * sin(radians(theta))", w="(k.row - s.y) * cos(radians(theta)) - (k.col - s.x) * sin(radians(theta))")
    return {
        "raw": source,
        "px": f"SELECT b.brick, CAST(r.i AS INT) AS row, CAST(c.i AS INT) AS col, coalesce(raw.v, 0e0) AS v FROM (SELECT DISTINCT brick FROM raw) b, range({nrows}) r(i), range({ncols}) c(i) LEFT JOIN raw ON raw.brick = b.brick AND raw.row = r.i AND raw.col = c.i",
        "cell": f"SELECT brick, row // {mesh} AS gr, col // {mesh} AS gc, list_sort(list(v)) AS px FROM px GROUP BY ALL",
        "clip": f"""SELECT brick, gr, gc, 0 AS it, px, false AS done FROM cell UNION ALL
            SELECT brick, gr, gc, it + 1, CASE WHEN g = 0 OR len(kept) = len(px) THEN px ELSE kept END, g = 0 OR len(kept) = len(px)
            FROM (SELECT *, list_filter(px, lambda x: x >= m - {BG.kappa}e0 * g AND x <= m + {BG.kappa}e0 * g) AS kept
                  FROM (SELECT *, 1.4826e0 * list_sort(list_transform(px, lambda x: abs(x - m)))[len(px) // 2 + 1] AS g
                        FROM (SELECT *, px[len(px) // 2 + 1] AS m FROM clip WHERE NOT done AND it < {BG.max_iter})))""",
        "last": "SELECT brick, gr, gc, arg_max(px, it) AS px FROM clip GROUP BY ALL",
        "mom": "SELECT *, len(px) AS n, px[len(px) // 2 + 1] AS med, list_avg(px) AS mean FROM last",
        "g": """SELECT brick, gr, gc, n, CASE WHEN rms > 0 AND abs(mean - med) < 0.3e0 * rms THEN 2.5e0 * med - 1.5e0 * mean ELSE med END AS bg, rms
            FROM (SELECT *, sqrt(list_sum(list_transform(px, lambda x: (x - mean) * (x - mean))) / n) AS rms FROM mom)""",
        "place": f"""SELECT px.*, fr - r0 AS dr, fc - c0 AS dc, r0, c0, mr, mc
            FROM (SELECT *, (row + 0.5e0) / {mesh} - 0.5e0 AS fr, (col + 0.5e0) / {mesh} - 0.5e0 AS fc, CAST(floor((row + 0.5e0) / {mesh} - 0.5e0) AS INT) AS r0, CAST(floor((col + 0.5e0) / {mesh} - 0.5e0) AS INT) AS c0 FROM px) px
            JOIN (SELECT brick, max(gr) AS mr, max(gc) AS mc FROM g GROUP BY brick) m USING (brick)""",
        "full_": f"SELECT p.brick, p.row, p.col, p.v, {blend('bg')} AS bg, {blend('rms')} AS rms FROM place p " + " ".join(corner("g", a, b) for a in (0, 1) for b in (0, 1)),
        "res": "SELECT *, v - bg AS res FROM full_",
        "hh": _taps("res", "row", "col", taps).format(out="h", src="res"),
        "sm": _taps("h", "col", "row", taps).format(out="f", src="hh"),
        "snr": "SELECT *, CASE WHEN rms > 0 THEN f / rms ELSE 0e0 END AS snr FROM sm",
        "mask": f"SELECT * FROM snr WHERE snr > {det.thresh}e0",
        "reach": f"SELECT brick, row, col, row * {ncols} + col AS root FROM mask UNION SELECT m.brick, m.row, m.col, r.root FROM reach r JOIN mask m ON m.brick = r.brick AND m.row BETWEEN r.row - 1 AND r.row + 1 AND m.col BETWEEN r.col - 1 AND r.col + 1 WHERE r.root < m.row * {ncols} + m.col",
        "rooted": "SELECT brick, row, col, min(root) AS root FROM reach GROUP BY ALL",
        "lab": "SELECT mask.*, CAST(dense_rank() OVER (PARTITION BY brick ORDER BY root) AS INT) AS label FROM mask JOIN rooted USING (brick, row, col)",
        "comp": """SELECT brick, label, CAST(count(*) AS INT) AS npix, min(row) AS rmin, max(row) AS rmax, min(col) AS cmin, max(col) AS cmax, max(snr) AS peak_snr,
            arg_max(row, struct_pack(s := snr, r := -row, c := -col)) AS peak_row, arg_max(col, struct_pack(s := snr, r := -row, c := -col)) AS peak_col FROM lab GROUP BY brick, label""",
        "det": f"SELECT * FROM comp WHERE npix >= {det.minarea}",
        "foot": "SELECT lab.*, npix, rmin, rmax, cmin, cmax FROM lab JOIN det USING (brick, label)",
        "cen": """SELECT brick, label, npix, rmin, rmax, cmin, cmax, sum(res) AS flux_iso, sum(greatest(res, 0)) AS sw,
            CASE WHEN sum(greatest(res, 0)) > 0 THEN sum(greatest(res, 0) * col) / sum(greatest(res, 0)) ELSE (cmin + cmax) / 2e0 END AS x,
            CASE WHEN sum(greatest(res, 0)) > 0 THEN sum(greatest(res, 0) * row) / sum(greatest(res, 0)) ELSE (rmin + rmax) / 2e0 END AS y FROM foot GROUP BY brick, label, npix, rmin, rmax, cmin, cmax""",
        "mo2": """SELECT c.brick, c.label, c.npix, c.rmin, c.rmax, c.cmin, c.cmax, flux_iso, sw, x, y, sum(greatest(res, 0) * (col - x) * (col - x)) / nullif(sw, 0) AS mxx, sum(greatest(res, 0) * (row - y) * (row - y)) / nullif(sw, 0) AS myy,
            sum(greatest(res, 0) * (col - x) * (row - y)) / nullif(sw, 0) AS mxy FROM cen c JOIN foot f ON f.brick = c.brick AND f.label = c.label
            GROUP BY c.brick, c.label, c.npix, c.rmin, c.rmax, c.cmin, c.cmax, flux_iso, sw, x, y""",
        "ax": """SELECT *, CASE WHEN sw > 0 THEN sqrt(greatest((mxx + myy) / 2 + sqrt((mxx - myy) / 2 * (mxx - myy) / 2 + mxy * mxy), 0)) ELSE sqrt(npix / pi()) END AS a0,
            CASE WHEN sw > 0 THEN sqrt(greatest((mxx + myy) / 2 - sqrt((mxx - myy) / 2 * (mxx - myy) / 2 + mxy * mxy), 0)) ELSE sqrt(npix / pi()) END AS b0,
            CASE WHEN sw > 0 THEN 0.5e0 * degrees(atan2(mxy, (mxx - myy) / 2)) ELSE 0e0 END AS theta FROM mo2""",
        "shp": "SELECT *, greatest(a0, 0.5e0) AS a, least(greatest(b0, 0.5e0), greatest(a0, 0.5e0)) AS b FROM ax",
        "rawk": f"SELECT s.brick, s.label, sum(sqrt({ell}) * res) / sum(res) AS raw_kron FROM shp s JOIN lab k ON k.brick = s.brick AND k.label = s.label WHERE res > 0 GROUP BY s.brick, s.label",
        "kron": f"SELECT shp.*, greatest(coalesce(raw_kron, 1), {MES.kron_min_radius}e0) AS kron_radius FROM shp LEFT JOIN rawk USING (brick, label)",
        "flux": f"""SELECT s.brick, s.label, sum(CASE WHEN {ell} <= ({MES.kron_factor}e0 * kron_radius) * ({MES.kron_factor}e0 * kron_radius) THEN res END) AS flux_auto
            FROM kron s JOIN sm k ON k.brick = s.brick GROUP BY s.brick, s.label""",
        "wcs": f"SELECT CAST(i AS VARCHAR) AS brick, {SIDE / 2 + 0.5}e0 AS p, 187e0 + i * 0.25e0 AS v1, 12e0 AS v2, 0.262e0 / 3600 AS t FROM range({views.LIN_BRICKS - 1}) w(i)",
        "cat": f"""SELECT kron.*, coalesce(flux_auto, 0) AS flux_auto, 1 - b / a AS ellipticity, peak_snr, peak_row, peak_col,
            CAST(CASE WHEN kron.rmin = 0 OR kron.rmax + 1 >= {nrows} OR kron.cmin = 0 OR kron.cmax + 1 >= {ncols} THEN 1 ELSE 0 END AS SMALLINT) AS flags,
            v1 - t * (x + 1 - p) AS ra, v2 + t * (y + 1 - p) AS dec
            FROM kron JOIN flux USING (brick, label) JOIN comp USING (brick, label) LEFT JOIN wcs USING (brick)""",
        "zs": f"""SELECT brick, s[len(s) // 200 + 1] AS z1, s[least(len(s) * 199 // 200, len(s) - 1) + 1] AS z2
            FROM (SELECT brick, list_sort(list(v)) AS s FROM px WHERE (row * {ncols} + col) % greatest({nrows} * {ncols} // {viewer.MAX_SAMPLES}, 1) = 0 GROUP BY brick)""",
    }


LIN = f"SELECT CAST(l_suppkey % {views.LIN_BRICKS} AS VARCHAR) AS brick, l_partkey % {SIDE} AS row, l_orderkey % {SIDE} AS col, sum(l_quantity) AS v FROM lineitem GROUP BY ALL"
EVT = "SELECT event_type AS brick, day(ts) - 1 AS row, hour(ts) AS col, sum(value) AS v FROM events GROUP BY ALL"
SKY = """SELECT o_orderkey AS id, o_orderpriority AS brick, 187e0 + ((o_orderkey * 7919) % 108000) / 360000e0 AS ra, 12e0 + ((o_orderkey * 104729 + o_custkey * 31) % 108000) / 360000e0 AS dec,
    CAST(CAST(floor(o_totalprice) AS BIGINT) % 40 + 5 AS INT) AS npix FROM orders"""


WCS_SQL = """SELECT *, CASE WHEN has THEN 100.5e0 + s_suppkey % 50 END AS crpix1, CASE WHEN has THEN 80e0 + s_suppkey % 40 END AS crpix2, CASE WHEN has THEN 150e0 + s_nationkey * 2.5e0 END AS crval1, CASE WHEN has THEN s_suppkey % 60 - 30e0 END AS crval2,
    CASE WHEN has THEN -1e-5 * (1 + s_suppkey % 7) END AS cd1_1, CASE WHEN has THEN 1e-6 * (s_suppkey % 5 - 2) END AS cd1_2, CASE WHEN has THEN 1e-6 * (s_suppkey % 3 - 1) END AS cd2_1, CASE WHEN has THEN 1e-5 * (1 + s_suppkey % 6) END AS cd2_2
    FROM (SELECT s_suppkey, s_nationkey, s_suppkey % 11 <> 0 AS has FROM supplier)"""


EMB = "SELECT 'emb' AS brick, CAST(vec_id AS INT) AS row, CAST(unnest(range(64)) AS INT) AS col, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings"


def _with(select: str, ctes: dict[str, str] | None = None) -> str:
    import re

    ctes = ctes or _LIN_CTES
    need: set[str] = set()

    def visit(sql: str) -> None:
        for name in ctes:
            if name not in need and re.search(rf"\b(FROM|JOIN)\s*\(?\s*{name}\b", sql):
                need.add(name)
                visit(ctes[name])

    visit(select)
    parts = [f"{n} AS {'' if n in ('clip', 'reach') else 'MATERIALIZED '}({ctes[n]})" for n in ctes if n in need]
    return ("WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else "") + select


_LIN_CTES = _ctes(LIN, SIDE, SIDE, BG.mesh)
_NULL_PX = "SELECT brick, row, col, CASE WHEN (row * 7 + col * 3) % 11 <> 0 THEN v END AS v FROM ({0})".format(_LIN_CTES["px"])
_NULL_CTES = _LIN_CTES | {"px": _NULL_PX, "cell": _LIN_CTES["cell"].replace("FROM px", "FROM px WHERE v IS NOT NULL")}
_MED = "list_sort(list({x}))[CAST(count({x}) // 2 + 1 AS INT)]"


def _cols(*names: str, digits: int = 6) -> str:
    return ", ".join(f"{_sql_q(n, digits)} AS {n}" for n in names)


def _pairs_sql(same: bool, tol: float = 1.0) -> str:
    brick = "" if same else "AND i.brick <> j.brick"
    return f"""pairs AS MATERIALIZED (SELECT i.id AS id_i, j.id AS id_j, i.ra AS ra_i, j.ra AS ra_j, i.npix AS npix_i, j.npix AS npix_j,
        sqrt(((j.ra - i.ra) * i.cd) * ((j.ra - i.ra) * i.cd) + (j.dec - i.dec) * (j.dec - i.dec)) * 3600e0 AS sep
        FROM (SELECT *, greatest(abs(cos(radians(dec))), 0.01e0) AS cd, CAST(floor(dec * 3600 / {tol!r}e0) AS BIGINT) AS z FROM sky) i
        JOIN (SELECT *, CAST(floor(dec * 3600 / {tol!r}e0) AS BIGINT) AS z FROM sky) j ON j.z BETWEEN i.z - 1 AND i.z + 1 AND (i.ra < j.ra OR i.ra = j.ra AND i.id < j.id) {brick}
        AND j.ra - i.ra <= {tol!r}e0 / 3600e0 / i.cd WHERE sqrt(((j.ra - i.ra) * i.cd) * ((j.ra - i.ra) * i.cd) + (j.dec - i.dec) * (j.dec - i.dec)) * 3600e0 < {tol!r}e0)"""


def _greedy_sql(sky: str, same: bool, tol: float, kind: str) -> str:
    """The greedy scan as a recursive list of removed rows over the pairs in scan order: steps up to ``bad``."""
    return f"""sky AS MATERIALIZED ({sky}), {_pairs_sql(same, tol)},
        o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY ra_i, id_i, ra_j, id_j) AS k FROM pairs),
        scan AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS {kind}[]) AS gone UNION ALL
            SELECT o.k, CASE WHEN list_contains(gone, id_i) OR list_contains(gone, id_j) THEN gone WHEN npix_i >= npix_j THEN list_append(gone, id_j) ELSE list_append(gone, id_i) END
            FROM scan JOIN o ON o.k = scan.k + 1),
        bad AS MATERIALIZED (SELECT unnest(arg_max(gone, k)) AS id FROM scan)"""


def _dedup_sql(same: bool, select: str) -> str:
    return f"WITH RECURSIVE {_greedy_sql(SKY, same, 1.0, 'BIGINT')} {select}"


ORACLES: dict[str, str] = {
    "scan_pixels": _with("SELECT * FROM px"),
    "image_stats": _with(f"SELECT brick, count(v) AS n_valid, count(*) - count(v) AS n_bad, min(v) AS vmin, max(v) AS vmax, {_sql_q('avg(v)')} AS vmean, {_MED.format(x='v')} AS vmedian FROM px GROUP BY brick"),
    "sky_patch": _with(f"SELECT brick, {_MED.format(x='v')} AS sky FROM px WHERE row >= {SIDE // 4} AND row < {3 * SIDE // 4} AND col >= {SIDE // 4} AND col < {3 * SIDE // 4} GROUP BY brick"),
    "wcs_points": "SELECT s_suppkey, point, " + _sql_q("crval1 + cd1_1 * (x + 1 - crpix1) + cd1_2 * (y + 1 - crpix2)", 7) + " AS ra, " + _sql_q("crval2 + cd2_1 * (x + 1 - crpix1) + cd2_2 * (y + 1 - crpix2)", 7) + " AS dec, " + _sql_q("sqrt(cd1_1 * cd1_1 + cd2_1 * cd2_1) * 3600", 7) + " AS scale, CAST((s_nationkey * 100 + 500) * (s_nationkey * 100 + 517) // 1000000 AS BIGINT) AS megapixels FROM (" + WCS_SQL + ") w, (SELECT s_suppkey AS key, unnest([" + ", ".join(f"{{'point': '{n}', 'x': {float(a)!r}e0 * s_nationkey + {float(b)!r}e0, 'y': {float(c)!r}e0 * s_nationkey + {float(d)!r}e0}}" for n, a, b, c, d in POINTS) + "], recursive := true) FROM supplier) p WHERE p.key = w.s_suppkey",
    "field_of_view": "SELECT s_suppkey, " + _sql_q("abs((crval1 + cd1_1 * (s_nationkey + 63e0 + 1 - crpix1) + cd1_2 * (s_nationkey + 63e0 + 1 - crpix2)) - (crval1 + cd1_1 * (1 - crpix1) + cd1_2 * (1 - crpix2)))", 7) + " AS fov FROM (" + WCS_SQL + ")",
    "clip_first_pass": _with("SELECT brick, CAST(gr AS INT) AS gr, CAST(gc AS INT) AS gc, len(arg_max(px, it)) AS kept, arg_min(px, it)[len(arg_min(px, it)) // 2 + 1] AS median FROM clip WHERE it <= 1 GROUP BY brick, gr, gc"),
    "bg_grid": _with(f"SELECT brick, gr, gc, n, {_cols('bg', 'rms')} FROM g"),
    "bg_summary": _with("SELECT brick, max(gr) + 1 AS grid_rows, max(gc) + 1 AS grid_cols, " + ", ".join(f"{_sql_q(f'{f}({c})')} AS {c}_{n}" for c in ("bg", "rms") for f, n in (("min", "min"), ("max", "max"), ("avg", "mean"))) + " FROM g GROUP BY brick"),
    "bg_full": _with(f"SELECT brick, row, col, {_cols('bg', 'rms')} FROM full_"),
    "residual": _with(f"SELECT brick, row, col, {_cols('res')} FROM res"),
    "residual_stats": _with(f"SELECT brick, {_sql_q('avg(res)')} AS res_mean, {_sql_q(_MED.format(x='res'))} AS res_median, {_sql_q('stddev_pop(res)')} AS res_rms FROM res GROUP BY brick"),
    "kernel": "WITH t AS (SELECT n_nationkey, 0.5e0 + n_nationkey / 8e0 AS sigma, CAST(unnest(range(-CAST(ceil(3 * (0.5e0 + n_nationkey / 8e0)) AS BIGINT), CAST(ceil(3 * (0.5e0 + n_nationkey / 8e0)) AS BIGINT) + 1)) AS INT) AS k FROM nation) SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, k, " + _sql_q("exp(-(k * k) / (2 * sigma * sigma)) / sum(exp(-(k * k) / (2 * sigma * sigma))) OVER (PARTITION BY n_nationkey)", 9) + " AS tap FROM t",
    "conv_h": _with(f"SELECT brick, row, col, {_cols('f')} FROM ({_taps('v', 'row', 'col').format(out='f', src='px')})"),
    "conv_hv": _with(f"SELECT brick, row, col, {_cols('f')} FROM ({_taps('h', 'col', 'row').format(out='f', src='(' + _taps('v', 'row', 'col').format(out='h', src='px') + ')')})"),
    "snr_map": _with(f"SELECT brick, row, col, {_cols('snr')} FROM snr"),
    "mask": _with("SELECT brick, row, col FROM mask"),
    "labels": _with("SELECT brick, row, col, label FROM lab"),
    "components": _with(f"SELECT brick, label, npix, rmin, rmax, cmin, cmax, {_cols('peak_snr')}, peak_row, peak_col FROM comp"),
    "detections": _with(f"SELECT brick, label, npix, rmin, rmax, cmin, cmax, {_cols('peak_snr')}, peak_row, peak_col FROM det"),
    "detection_summary": _with(f"SELECT brick, count(*) AS n, min(npix) AS npix_min, max(npix) AS npix_max, {_MED.format(x='npix')} AS npix_median, {_sql_q('avg(npix)')} AS npix_mean, {_sql_q('min(peak_snr)')} AS snr_min, {_sql_q('max(peak_snr)')} AS snr_max, {_sql_q('avg(peak_snr)')} AS snr_mean FROM det GROUP BY brick"),
    "top10_snr": _with(f"SELECT brick, label, npix, {_cols('peak_snr')}, rmax - rmin + 1 AS height, cmax - cmin + 1 AS width FROM (SELECT * FROM det ORDER BY peak_snr DESC, brick, label LIMIT 10)"),
    "iso_flux_centroid": _with(f"SELECT brick, label, npix, {_cols('flux_iso', 'x', 'y')} FROM cen"),
    "moments_axes": _with(f"SELECT brick, label, {_cols('a', 'b', 'theta')}, {_sql_q('1 - b / a')} AS ellipticity FROM shp"),
    "kron_radius": _with(f"SELECT brick, label, {_cols('raw_kron')} FROM rawk"),
    "kron_flux": _with(f"SELECT brick, label, {_cols('kron_radius', 'flux_auto')} FROM cat"),
    "edge_flags": _with("SELECT brick, label, CAST(flags AS INT) AS flags FROM cat"),
    "measurements": _with(f"SELECT brick, label, npix, {_cols(*FLOATS)}, flags FROM cat"),
    "measurements_tile": _with(f"SELECT brick, label, npix, {_cols(*FLOATS)}, flags FROM cat"),
    "top15_flux": _with(f"SELECT brick, label, {_cols('flux_auto')} FROM (SELECT * FROM cat ORDER BY flux_auto DESC, brick, label LIMIT 15)"),
    "flux_stats": _with(f"SELECT count(*) AS n, count(*) FILTER (flags & 1 <> 0) AS n_edge, {_sql_q('coalesce(avg(flux_auto), 0)')} AS flux_mean, {_sql_q('coalesce(' + _MED.format(x='flux_auto') + ', 0)')} AS flux_median, {_sql_q('coalesce(max(flux_auto), 0)')} AS flux_max FROM cat"),
    "brick_names": "SELECT '/data/' || n AS path, starts_with(n, 'legacysurvey-') AND ends_with(n, '-image-r.fits.fz') AS chosen, coalesce(nullif(split_part(regexp_replace(n, '\\.[^.]*$', ''), '-', 2), ''), 'unknown') AS brick FROM (SELECT unnest([" + ", ".join(f"'{a}' || event_type || '{b}'" for a, b in views.FILE_FORMS) + "]) AS n FROM (SELECT DISTINCT event_type FROM events))",
    "ra_sorted": f"SELECT id, row_number() OVER (ORDER BY CASE WHEN id % 70 = 0 THEN NULL ELSE ra END NULLS LAST, id) AS place FROM ({SKY})",
    "dedup_pairs": f"WITH sky AS ({SKY}), {_pairs_sql(False)} SELECT id_i, id_j, {_cols('sep')} FROM pairs",
    "dedup_pairs_any": f"WITH sky AS ({SKY}), {_pairs_sql(True)} SELECT id_i, id_j, {_cols('sep')} FROM pairs",
    "dedup_removed": _dedup_sql(False, "SELECT id FROM bad"),
    "dedup_removed_any": _dedup_sql(True, "SELECT id FROM bad"),
    "dedup_final": _dedup_sql(False, "SELECT count(*) AS n, CAST(sum(npix) AS BIGINT) AS npix, CAST(sum(id) AS BIGINT) AS ids FROM sky WHERE id NOT IN (SELECT id FROM bad)"),
    "csv_rows": _with("SELECT brick, label, concat_ws(',', brick, " + ", ".join(f"CAST({f} AS VARCHAR)" if d is None else f"coalesce(printf('%.{d}f', CAST({f} AS DOUBLE)), 'nan')" for _, f, d in sinks.CSV) + ") AS line FROM cat"),
    "zscale": _with("SELECT * FROM zs"),
    "stretch_hist": _with("SELECT brick, CAST(floor(least(greatest(asinh(least(greatest((v - z1) / greatest(z2 - z1, 1e-10), -0.5e0), 10e0) * 5e0) / asinh(5e0), 0), 1) * 255) AS INT) AS grey, count(*) AS n FROM px JOIN zs USING (brick) GROUP BY ALL"),
    "ellipse_points": _with(f"SELECT brick, label, i, {_sql_q('x + ex * ct - ey * st')} AS px, {_sql_q('y + ex * st + ey * ct')} AS py FROM (SELECT brick, label, CAST(i AS INT) AS i, x, y, greatest(a, 2) * cos(2 * pi() * (i % 32) / 32) AS ex, greatest(b, 1) * sin(2 * pi() * (i % 32) / 32) AS ey, cos(radians(theta)) AS ct, sin(radians(theta)) AS st FROM cat, range(33) v(i))"),
    "viewport_filter": _with(f"SELECT brick, label, {_cols('sx', 'sy')}, CASE WHEN label = 1 THEN 'selected' WHEN flags <> 0 THEN 'flagged' ELSE 'normal' END AS colour FROM (SELECT *, 400 + (x - 32) * 30 AS sx, 300 + (y - 32) * 30 AS sy FROM cat) WHERE sx BETWEEN -60 AND 860 AND sy BETWEEN -60 AND 660"),
    "nearest_source": _with(f"SELECT brick, label, {_cols('dist')} FROM (SELECT *, sqrt((x - 30) * (x - 30) + (y - 20) * (y - 20)) AS dist FROM cat ORDER BY dist, brick, label LIMIT 1) WHERE dist * 8 < 50"),
    "event_detections": _with(f"SELECT brick, label, npix, rmin, rmax, cmin, cmax, {_cols('peak_snr')}, peak_row, peak_col FROM det", _ctes(EVT, 31, 24, 8)),
    "embedding_detections": _with(f"SELECT brick, label, npix, rmin, rmax, cmin, cmax, {_cols('peak_snr')}, peak_row, peak_col FROM det", _ctes(EMB, 1, 64, BG.mesh) | {"px": "SELECT * FROM raw"}),
    "fits_roundtrip": _with("SELECT * FROM px"),
    "rice_roundtrip": _with("SELECT * FROM px"),
    "catalog_roundtrip": _with(f"SELECT brick, {_cols('x', 'y', 'ra')}, npix, flags FROM cat"),
    "single_table": _with("SELECT brick, 'r' AS band, npix, flags, " + _cols("x", "y", "ra", "dec") + ", " + ", ".join(f"{_sql_q(f'CAST(CAST({c} AS FLOAT) AS DOUBLE)', 2)} AS {c}" for c in TABLE_FLOATS) + " FROM cat"),
    "csv_single": _with("SELECT brick, label, concat_ws(',', " + ", ".join(f"CAST({f} AS VARCHAR)" if d is None else f"coalesce(printf('%.{d}f', CAST({f} AS DOUBLE)), 'nan')" for _, f, d in sinks.CSV) + ") AS line FROM cat"),
    "run_files": _with(f"SELECT brick, label, npix, {_cols(*FLOATS)}, flags FROM cat"),
    "file_errors": _with("SELECT '/data/legacysurvey-' || brick || '-image-r.fits.fz' AS path, 'none' AS error_kind FROM (SELECT DISTINCT brick FROM raw) UNION ALL SELECT '/data/legacysurvey-bad-image-r.fits.fz', 'fits'"),
    "wcs_headers": "SELECT CAST(s_suppkey AS BIGINT) AS s_suppkey, ['primary', 'extension', 'tiles'][s_suppkey % 3 + 1] AS kind, CAST(66 + 12 * s_nationkey AS BIGINT) AS total, " + ", ".join(f"CASE WHEN s_suppkey % 13 >= 8 THEN {_sql_q(k.lower(), 9)} END AS {k.lower()}" for k in fits.WCS_KEYS) + " FROM (" + WCS_SQL + ")",
    "null_stats": _with(f"SELECT brick, count(v) AS n_valid, count(*) - count(v) AS n_bad, min(v) AS vmin, max(v) AS vmax, {_sql_q('avg(v)')} AS vmean, list_sort(list(v) FILTER (v IS NOT NULL))[CAST(count(v) // 2 + 1 AS INT)] AS vmedian FROM px GROUP BY brick", _NULL_CTES),
    "null_grid": _with(f"SELECT brick, gr, gc, n, {_cols('bg', 'rms')} FROM g", _NULL_CTES),
    "null_smooth": _with(f"SELECT brick, row, col, {_cols('f')} FROM ({_taps('h', 'col', 'row').format(out='f', src='(' + _taps('v', 'row', 'col').format(out='h', src='(SELECT brick, row, col, coalesce(v, 0e0) AS v FROM px)') + ')')})", _NULL_CTES),
}
ORACLES |= {"smooth_mosaic": ORACLES["conv_hv"], "labels_mosaic": ORACLES["labels"], "measurements_mosaic": ORACLES["measurements"]}
ORACLES |= {
    "fits_file": _with("SELECT row_number() OVER (ORDER BY brick, label) AS place, brick, npix, CAST(flags AS INT) AS flags, " + _cols("x", "y", "ra", "dec") + ", " + ", ".join(f"{_sql_q(f'CAST(CAST({c} AS FLOAT) AS DOUBLE)', 2)} AS {c}" for c in TABLE_FLOATS) + " FROM cat"),
    "csv_file": f"SELECT line FROM ({ORACLES['csv_rows']})",
}
ORACLES |= {
    "sql_detect": _with("SELECT brick, label, npix, flags, " + _cols(*[c for c in FLOATS if c not in ("ra", "dec")]) + " FROM cat"),
    "sql_views": _with(f"""SELECT p.brick, pixels, cells, {_sql_q('level')} AS level, found, sources, {_sql_q('brightest')} AS brightest, {_sql_q('first_ra')} AS first_ra FROM (SELECT brick, count(*) AS pixels FROM px GROUP BY brick) p
        JOIN (SELECT brick, count(*) AS cells, avg(bg) AS level FROM g GROUP BY brick) g_ USING (brick) LEFT JOIN (SELECT brick, count(*) AS found FROM det WHERE npix >= 10 GROUP BY brick) d USING (brick)
        LEFT JOIN (SELECT brick, count(*) AS sources, max(flux_auto) AS brightest, min(ra) AS first_ra FROM cat GROUP BY brick) c USING (brick)"""),
}
ORACLES |= {
    "strips": ORACLES["scan_pixels"],
    "headers": _with(f"SELECT brick, 'r' AS band, {SIDE} AS nrows, {SIDE} AS ncols, {_sql_q('v1', 9)} AS crval1, {_sql_q('-t', 9)} AS cd1_1, 'none' AS error_kind FROM (SELECT DISTINCT brick FROM raw) LEFT JOIN wcs USING (brick) UNION ALL SELECT 'bad', 'r', 0, 0, NULL, NULL, 'fits'"),
}
_OVER_CTES = _LIN_CTES | {"wcs": _LIN_CTES["wcs"].replace("187e0 + i * 0.25e0", f"187e0 + i * ({OVERLAP!r}e0 / 3600)")}
_OVER_SKY = "SELECT brick || '|' || label AS id, brick, ra, dec, npix FROM cat WHERE ra IS NOT NULL"
ORACLES |= {
    "run_overlap": _with("SELECT * FROM cat", _OVER_CTES).rsplit("SELECT * FROM cat", 1)[0].rstrip() + f",\n{_greedy_sql(_OVER_SKY, NEAR.same_brick, NEAR.tolerance_arcsec, 'VARCHAR')}\nSELECT brick, label, npix, {_cols(*FLOATS)}, flags FROM cat WHERE brick || '|' || label NOT IN (SELECT id FROM bad)",
    "forms_compared": _with("SELECT brick, count(*) AS relational, count(*) AS tile, count(*) AS agreeing FROM det GROUP BY brick"),
}
