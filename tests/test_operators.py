"""Behaviour of single operators on literal images."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skyframe.config import BackgroundConfig, DedupConfig, DetectConfig, MeasureConfig
from skyframe.operators import background, convolve, dedup, detect, mosaic, selection, summaries
from skyframe.plans import pipeline, tile


def frame(spark, image, brick="b"):
    r, c = np.indices(image.shape)
    v = np.where(np.isfinite(image), image, np.nan).ravel()
    pdf = pd.DataFrame({"brick": brick, "row": r.ravel().astype("int32"), "col": c.ravel().astype("int32"), "v": v})
    return spark.createDataFrame(pdf, "brick string, row int, col int, v double").withColumn("v", F.expr("if(isnan(v), null, v)"))


def stats(px, kappa=3.0, it=10):
    bg, rms = tile.clip_cells(np.array([px], float), kappa, it)
    return bg[0], rms[0]


def test_clip_of_a_ramp():
    bg, _ = stats(100 + (np.arange(1001) - 500) * 0.01)
    assert np.isfinite(bg) and abs(bg - 100) < 1


def test_mode_of_a_symmetric_sample():
    assert abs(stats(np.arange(201.0), it=1)[0] - 100) < 1


@pytest.mark.parametrize("value", [3.0, 7.0, 5.0])
def test_uniform_image(spark, value):
    px = frame(spark, np.full((32, 32), value))
    g = background.grid(px, BackgroundConfig(mesh=16))
    full = background.residual(background.interpolate(px, g, 16)).agg(F.max(F.abs(F.col("bg") - value)), F.max(F.abs("res")), F.max("rms")).first()
    assert max(full) < 1e-9


@pytest.mark.parametrize("sigma", [0.5, 1.0, 1.6, 3.0])
def test_kernel(sigma):
    k = convolve.gaussian_kernel(sigma)
    assert abs(sum(k) - 1) < 1e-12 and np.allclose(k, k[::-1]) and len(k) == 2 * math.ceil(3 * sigma) + 1


def test_smoothing(spark):
    flat = convolve.smooth(frame(spark, np.full((16, 16), 5.0)), "v", 1.6).agg(F.max(F.abs(F.col("f") - 5))).first()[0]
    assert flat < 1e-9
    delta = np.zeros((32, 32))
    delta[16, 16] = 1
    out = convolve.smooth(frame(spark, delta), "v", 2.0).toPandas()
    assert abs(out.f.sum() - 1) < 0.05 and out.f.idxmax() == out.index[(out.row == 16) & (out.col == 16)][0]
    assert np.allclose(out.sort_values(["row", "col"]).f.to_numpy().reshape(32, 32), tile.smooth(delta, 2.0))


def found(spark, image, minarea=5):
    px = frame(spark, image).withColumn("f", F.col("v")).withColumn("rms", F.lit(1.0))
    labels = detect.label_components(detect.mask(detect.snr_map(px), 1.5))
    return labels, detect.detections(labels, DetectConfig(minarea=minarea)).collect()


def blob(image, r, c, h, value=10.0):
    image[r - h : r + h + 1, c - h : c + h + 1] = value
    return image


def test_detection_of_blobs(spark):
    assert found(spark, np.zeros((32, 32)))[1] == []
    (one,) = found(spark, blob(np.zeros((64, 64)), 32, 32, 2))[1]
    assert one.npix == 25 and (one.peak_row, one.peak_col) == (30, 30)
    assert len(found(spark, blob(blob(np.zeros((64, 64)), 12, 12, 2), 52, 52, 2))[1]) == 2
    tri = np.zeros((32, 32))
    tri[16, 15:18] = 10
    assert found(spark, tri)[1] == []
    labels, (one,) = found(spark, blob(np.zeros((32, 32)), 16, 16, 1))
    assert labels.where(F.col("label") == one.label).count() == one.npix == 9


def flood(mask):
    lab, k = np.zeros(mask.shape, int), 0
    for r, c in zip(*np.nonzero(mask)):
        if not lab[r, c]:
            k += 1
            stack = [(r, c)]
            lab[r, c] = k
            while stack:
                y, x = stack.pop()
                for i in range(max(y - 1, 0), min(y + 2, mask.shape[0])):
                    for j in range(max(x - 1, 0), min(x + 2, mask.shape[1])):
                        if mask[i, j] and not lab[i, j]:
                            lab[i, j] = k
                            stack.append((i, j))
    return lab


@pytest.mark.parametrize("density", [0.1, 0.35, 0.5, 0.7])
def test_labels_equal_flood_fill(density):
    rng = np.random.default_rng(int(density * 100))
    mask = rng.random((40, 53)) < density
    r, c, lab = tile.labels(mask)
    got = np.zeros(mask.shape, int)
    got[r, c] = lab
    assert np.array_equal(got, flood(mask))


def test_shapes_that_join_late():
    u = np.zeros((6, 7), bool)
    u[:5, 1] = u[:5, 5] = u[4, 1:6] = True
    assert set(tile.labels(u)[2]) == {1}
    d = np.eye(5, dtype=bool)[:, ::-1]
    assert set(tile.labels(d)[2]) == {1}


def noisy(seed=3, shape=(70, 50)):
    rng = np.random.default_rng(seed)
    image = rng.normal(10, 1, shape)
    yy, xx = np.indices(shape)
    for r, c, f in ((20, 20, 60), (40, 30, 90), (0, 10, 70), (55, 44, 50)):
        image += f * np.exp(-((yy - r) ** 2 + (xx - c) ** 2) / 5)
    image[33, 12] = np.nan
    image[5, 45] = np.inf
    return image


def test_relational_equals_tile(spark):
    image, cfgs = noisy(), (BackgroundConfig(mesh=16), DetectConfig(thresh=0.5), MeasureConfig())
    px = frame(spark, image)
    dims = pipeline.dimensions(px)
    wcs = spark.sql("select 'b' brick, named_struct('crpix1',1d,'crpix2',2d,'crval1',10d,'crval2',-3d,'cd1_1',-1e-4d,'cd1_2',1e-5d,'cd2_1',0d,'cd2_2',1e-4d) wcs")
    got = pipeline.measured(px, dims, wcs, *cfgs).toPandas().sort_values("label").reset_index(drop=True)
    want = pd.DataFrame(tile.process(image, wcs.first().wcs.asDict(), *cfgs)).sort_values("label").reset_index(drop=True)
    assert len(got) == len(want) > 0
    for c in want.columns:
        assert np.allclose(got[c].astype(float), want[c].astype(float), rtol=1e-7, atol=1e-7), c
    assert (got.kron_radius == 3.5).all()


def test_raw_kron_radius_is_at_most_sqrt2():
    out = tile.process(noisy(), None, BackgroundConfig(mesh=16), DetectConfig(thresh=0.5), MeasureConfig(kron_min_radius=0.0))
    assert (out["kron_radius"] <= math.sqrt(2)).all() and (out["kron_radius"] > 0).all()


def test_empty_cell_poisons_its_neighbours(spark):
    image = np.full((32, 32), 4.0)
    image[:16, :16] = np.nan
    px = frame(spark, image)
    g = background.grid(px, BackgroundConfig(mesh=16))
    assert g.count() == 4 and g.where("bg is null").count() == 1
    full = background.interpolate(px, g, 16)
    assert full.where("row = 20 and col = 20").first().bg is None and full.where("row = 31 and col = 31").first().bg == 4


def greedy(rows, tol, same):
    rows = sorted(rows, key=lambda r: (r[2], r[0]))
    keep, t = [True] * len(rows), tol / 3600
    for i, (_, bi, rai, deci, ni) in enumerate(rows):
        if not keep[i]:
            continue
        cd = max(abs(math.cos(math.radians(deci))), 0.01)
        for j in range(i + 1, len(rows)):
            if not keep[j]:
                continue
            _, bj, raj, decj, nj = rows[j]
            if raj - rai > t / cd:
                break
            if bi == bj and not same:
                continue
            if math.sqrt(((raj - rai) * cd) ** 2 + (decj - deci) ** 2) * 3600 < tol:
                if ni >= nj:
                    keep[j] = False
                else:
                    keep[i] = False
                    break
    return sorted(r[0] for r, k in zip(rows, keep) if not k)


@pytest.mark.parametrize("same", [False, True])
def test_dedup_equals_greedy_scan(spark, same):
    rng = np.random.default_rng(11)
    rows = [(i, f"b{rng.integers(3)}", 10 + rng.random() * 0.004, 5 + rng.random() * 0.004, int(rng.integers(5, 9))) for i in range(400)]
    cat = spark.createDataFrame(rows + [(999, "b0", None, None, 5)], "id long, brick string, ra double, dec double, npix int")
    assert sorted(r.id for r in dedup.removed(cat, DedupConfig(1.0, same)).collect()) == greedy(rows, 1.0, same)
    left = dedup.deduplicate(cat, DedupConfig(1.0, same)).collect()
    assert left[-1].id == 999 and [r.ra for r in left[:-1]] == sorted(r.ra for r in left[:-1])


@pytest.mark.parametrize("dec", [0.0, 5.0, -72.0, 89.999])
def test_dedup_of_wide_components(spark, dec):
    """Chains that leave the halo of a cell, beside small groups, at all declinations; ids beyond the floats' integers."""
    rng, t = np.random.default_rng(3), 0.8 / 3600
    stretch = 1 / max(math.cos(math.radians(dec)), 0.01)
    spots = [(10 + k * t * stretch, dec) for k in range(150)] + [(10.2 + 0.1 * t * k, dec - t * k) for k in range(90)]
    spots += [(10.4 + rng.random() * 0.004 * stretch, dec - rng.random() * 0.004) for _ in range(300)]
    rows = [((1 << 60) + i, f"b{rng.integers(3)}", x, min(y, 90.0), int(rng.integers(5, 9))) for i, (x, y) in enumerate(spots)]
    cat = spark.createDataFrame(rows, "id long, brick string, ra double, dec double, npix int").repartition(3)
    found = dedup.decisions(cat, DedupConfig(1.0, True)).collect()
    assert sorted(r.id for r in found if r.gone) == greedy(rows, 1.0, True)
    assert len({r.id for r in found}) == len(found) and all(r.low <= r.high and r.root <= r.id for r in found)
    wide = [r for r in found if r.root == 1 << 60]
    assert len(wide) >= (150 if dec != 89.999 else 2)


def crowd(n=20_000, dec=12.0):
    """Three sources a square tolerance over several tiles: all of them are one component of pairs."""
    rng, side = np.random.default_rng(8), 0.0225
    return [(i, f"b{rng.integers(5)}", 187 + rng.random() * side, dec + rng.random() * side, int(rng.integers(5, 45))) for i in range(n)]


CROWD = "id long, brick string, ra double, dec double, npix int"


@pytest.mark.parametrize("same", [False, True])
def test_a_crowded_field_is_scanned_by_tiles(spark, monkeypatch, same):
    """The component is never brought together, neither in rounds nor in one group."""
    rows = crowd()
    cat = spark.createDataFrame(rows, CROWD).repartition(5)
    monkeypatch.setattr(dedup, "roots", None)
    assert sorted(r.id for r in dedup.removed(cat, DedupConfig(1.0, same)).collect()) == greedy(rows, 1.0, same)


def test_what_is_left_of_a_crowded_field(spark, monkeypatch):
    rows = crowd(dec=-60.0)
    monkeypatch.setattr(dedup, "roots", None)
    left = dedup.deduplicate(spark.createDataFrame(rows + [(-1, "b0", None, None, 5)], CROWD)).collect()
    gone = set(greedy(rows, 1.0, False))
    assert sorted(r.id for r in left) == [-1] + [r[0] for r in rows if r[0] not in gone]
    assert left[-1].id == -1 and [(r.ra, r.id) for r in left[:-1]] == sorted((r.ra, r.id) for r in left[:-1])


@pytest.mark.parametrize("dec", [0.0, 12.0, -72.0, 89.99])
def test_pairs_meet_few_others(spark, dec):
    """All pairs of a crowded field at any declination, from few copies of rows and few meetings."""
    rng, side = np.random.default_rng(6), 0.005
    ra, y = 187 + rng.random(1500) * side / math.cos(math.radians(dec)), dec + (rng.random(1500) - 0.5) * side
    cat = spark.createDataFrame([(i, "b", float(a), float(b), 5) for i, (a, b) in enumerate(zip(ra, y))], CROWD)
    cos = np.maximum(np.abs(np.cos(np.radians(y))), 0.01)
    d, h = ra[None, :] - ra[:, None], y[None, :] - y[:, None]
    want = np.argwhere((d > 0) & (d <= 1 / 3600 / cos[:, None]) & (np.hypot(d * cos[:, None], h) * 3600 < 1))
    assert sorted((r.id_i, r.id_j) for r in dedup.candidate_pairs(cat, DedupConfig(1.0, True)).collect()) == [tuple(x) for x in want.tolist()]
    left, right = dedup.sides(cat, DedupConfig(1.0, True))
    assert left.count() < 3.3 * 1500 and left.join(right, ["zone", "slice"]).count() < 16 * len(want)


@pytest.mark.parametrize("tile", [1, 3, 8, 100])
def test_mosaic_labels_and_filter(spark, tile):
    """Spirals, diagonals, rings and noise across tile borders are labelled and smoothed as in the whole image."""
    rng = np.random.default_rng(tile)
    image = (rng.random((26, 31)) < 0.35).astype(float)
    image[3, :] = image[:, 5] = 1
    image[10:20, 8:25] = 0
    image[np.arange(10, 20), np.arange(8, 18)] = image[10, 8:25] = image[10:20, 24] = image[19, 12:25] = 1
    px = frame(spark, image, "a").unionByName(frame(spark, image[::-1], "b"))
    masked = px.where("v > 0").withColumn("snr", F.col("v"))
    want = {tuple(r) for r in detect.label_components(masked).select("brick", "row", "col", "label").collect()}
    assert {tuple(r) for r in mosaic.label_components(masked, tile).select("brick", "row", "col", "label").collect()} == want
    assert mosaic.label_components(masked.limit(0), tile).count() == 0
    a, b = (d.orderBy("brick", "row", "col").toPandas().f.to_numpy() for d in (convolve.smooth(px, "v", 1.6), mosaic.smooth(px, "v", 1.6, tile)))
    assert np.allclose(a, b, atol=1e-12) and len(a) == 2 * image.size


def test_medians_by_radix_selection(spark):
    """Signs, zeros, subnormals, huge and equal values, even and odd counts, groups of nothing but NULL, a null key."""
    rng = np.random.default_rng(1)
    groups = {
        "normal": rng.normal(0, 1, 501), "even": rng.normal(5, 3, 400), "wide": rng.choice([-1.0, 1.0], 301) * 10.0 ** rng.integers(-308, 308, 301), "tiny": np.r_[5e-324, -5e-324, 1e-310, -1e-310],
        "zeros": np.r_[0.0, -0.0, 0.0], "equal": np.full(1000, 2.5), "one": np.r_[-7.25], "near": 1 + np.arange(300) * 2.0**-52, "ends": np.r_[-1.7e308, 1.7e308], "null": np.r_[3.0, 1.0], None: np.r_[9.0, 8.0, 1.0],
    }
    rows = [(g, float(x)) for g, v in groups.items() for x in v] + [(g, None) for g in ("normal", "none", "none")]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r.g: r.m for r in selection.with_median(df.groupBy("g").agg(F.count("*").alias("n")), df, ["g"], "v", "m").collect()}
    assert got == {g: sorted(v)[len(v) // 2] for g, v in groups.items()} | {"none": None}
    assert summaries.flux_stats(df.limit(0).selectExpr("v as flux_auto", "0 as flags")).first().flux_median == 0
    assert [r.m for r in selection.upper_medians(df.where("g = 'wide'"), [], "v", "m").collect()] == [got["wide"]]


def test_median_of_ten_million_values(spark):
    """Every count is made before the shuffle: no task takes more rows than there are buckets."""
    n = 10_000_000
    df = spark.range(0, n, 1, 8).selectExpr("cast(id * 7919 % 10000019 as double) / 3 - 1e6 as v")
    m = selection.upper_medians(df, [], "v", "m")
    assert m.first().m == sorted((i * 7919 % 10_000_019) / 3 - 1e6 for i in range(n))[n // 2]
    plan = m._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan and "collect" not in plan.lower() and plan.count("partial_count") >= 4
