"""Image and catalog files: codecs, discovery, sinks, pipelines over folders, the stream."""

import os

import numpy as np
import pytest

from skyframe.config import BackgroundConfig, DetectConfig
from skyframe.plans import pipeline
from skyframe.sources import fits, images, rice, sinks
from skyframe.streaming import incremental

from .test_operators import noisy

WCS = dict(crpix1=1.0, crpix2=1.0, crval1=187.0, crval2=12.0, cd1_1=-7e-5, cd1_2=0.0, cd2_1=0.0, cd2_2=7e-5)
CFG = dict(bcfg=BackgroundConfig(mesh=16), dcfg=DetectConfig(thresh=0.5))


@pytest.mark.parametrize("width", [1, 2, 4])
@pytest.mark.parametrize("block", [16, 32])
def test_rice_round_trip(width, block):
    rng = np.random.default_rng(width * 100 + block)
    top = {1: 255, 2: 30_000, 4: 2**31 - 5}[width]
    for x in (np.zeros(70, int), np.arange(200) % 250, rng.integers(0 if width == 1 else -top, top, 100), rng.normal(100, 3, 333).astype(int), np.array([5])):
        assert np.array_equal(rice.decode(rice.encode(x, block, width), len(x), block, width), x)


@pytest.mark.parametrize("bitpix", [8, 16, 32, 64, -32, -64])
def test_plain_images(bitpix):
    x = np.arange(35).reshape(5, 7) % 100
    image, wcs = fits.read_image(fits.write_image(x, bitpix, WCS))
    assert image.dtype == np.float32 and np.array_equal(image, x) and wcs == WCS
    assert fits.read_image(fits.write_image(x, bitpix, leading_empty=True))[1] is None
    scaled = fits.read_image(fits.write_image(x, bitpix, extra=[fits.card("BSCALE", 2.0), fits.card("BZERO", 10.0)]))[0]
    assert np.array_equal(scaled, 2 * x + 10)


def test_compressed_images():
    x = np.random.default_rng(1).normal(5, 2, (9, 40))
    x[3, 3] = np.nan
    image, wcs = fits.read_image(fits.write_rice_image(x, WCS, scale=0.01))
    assert wcs == WCS and np.isnan(image[3, 3]) and np.nanmax(np.abs(image - x)) < 0.006
    ints = np.random.default_rng(2).integers(-500, 500, (9, 40))
    assert np.array_equal(fits.read_image(fits.write_rice_image(ints))[0], ints)


def test_dithering_follows_the_convention():
    t = fits.dither_table()
    seed = 1
    for _ in range(10_000):
        seed = 16807 * seed % 2147483647
    assert seed == 1043618065 and len(t) == 10_000 and 0 < t.min() and t.max() < 1


def test_rice_stream_by_hand():
    """First value 5, a block of split width 0 with the differences 0, 1, -1, and a block of zeros."""
    bits = f"{5:032b}" + f"{1:05b}" + "1" + "001" + "01" + f"{0:05b}"
    data = np.packbits([int(b) for b in bits.ljust(-(-len(bits) // 8) * 8, "0")]).tobytes()
    assert rice.decode(data, 6, block=3).tolist() == [5, 6, 5, 5, 5, 5]
    raw = f"{7:032b}" + f"{26:05b}" + "".join(f"{x:032b}" for x in (0, 2 * 2**20, 1))
    assert rice.decode(np.packbits([int(b) for b in raw.ljust(-(-len(raw) // 8) * 8, "0")]).tobytes(), 3, block=3).tolist() == [7, 7 + 2**20, 6 + 2**20]
    long_run = f"{0:032b}" + f"{1:05b}" + "1" + "0" * 300 + "1"
    assert rice.decode(np.packbits([int(b) for b in long_run.ljust(-(-len(long_run) // 8) * 8, "0")]).tobytes(), 2).tolist() == [0, 150]
    with pytest.raises(rice.RiceError):
        rice.decode(data[:5], 200)


def tile_file(tiles, extra, column="COMPRESSED_DATA", kind="RICE_1", shape=(1, 3)):
    """A compressed image made card by card: one tile a row, scale 0.5 and zero 10."""
    off, rows = 0, b""
    for t in tiles:
        rows += np.array([len(t), off], ">i4").tobytes() + np.array([0.5, 10.0], ">f8").tobytes()
        off += len(t)
    c = fits.card
    cards = [c("XTENSION", "BINTABLE"), c("BITPIX", 8), c("NAXIS", 2), c("NAXIS1", 24), c("NAXIS2", len(tiles)), c("PCOUNT", off), c("GCOUNT", 1), c("TFIELDS", 3)]
    for k, (name, form) in enumerate(((column, "1PB"), ("ZSCALE", "1D"), ("ZZERO", "1D")), 1):
        cards += [c(f"TTYPE{k}", name), c(f"TFORM{k}", form)]
    cards += [c("ZIMAGE", True), c("ZBITPIX", -32), c("ZNAXIS1", shape[1]), c("ZNAXIS2", shape[0]), c("ZTILE1", shape[1]), c("ZTILE2", 1), c("ZCMPTYPE", kind), *extra]
    data = rows + b"".join(tiles)
    return fits.header_block([c("SIMPLE", True), c("BITPIX", 8), c("NAXIS", 0)]) + fits.header_block(cards) + data + bytes(-len(data) % 2880)


def test_dithered_and_gzip_tiles():
    import gzip

    x, c = np.array([4, 9, -2147483646]), fits.card
    table = fits.dither_table()
    noise = table[int(table[1] * 500) :][:3]
    tile = rice.encode(x)
    one, two = ([c("ZQUANTIZ", f"SUBTRACTIVE_DITHER_{k}"), c("ZDITHER0", 2)] for k in (1, 2))
    want = (x - noise + 0.5) * 0.5 + 10
    assert np.allclose(fits.read_image(tile_file([tile], one))[0][0], want)
    assert np.allclose(fits.read_image(tile_file([tile], two))[0][0], [*want[:2], 0.0])
    packed = gzip.compress(x.astype(">i4").tobytes())
    assert np.allclose(fits.read_image(tile_file([packed], [], kind="GZIP_1"))[0][0], x * 0.5 + 10)
    plain = gzip.compress(np.array([1.5, 2.5, np.nan], ">f4").tobytes())
    got = fits.read_image(tile_file([plain], [], column="GZIP_COMPRESSED_DATA"))[0][0]
    assert got[:2].tolist() == [1.5, 2.5] and np.isnan(got[2])


def test_command_line(spark, folder, tmp_path, capsys, monkeypatch):
    from skyframe import __main__ as cli

    monkeypatch.chdir(tmp_path)
    image = f"{folder}/legacysurvey-0001m002-image-r.fits.fz"
    assert cli.main([]) == 1 and cli.main(["other", image]) == 1
    assert cli.main(["detect", f"{folder}/legacysurvey-0003m002-image-r.fits.fz"]) == 1
    assert cli.argument(["x"], 0, 1.6) == 1.6 and cli.argument(["2"], 0, 1.6) == 2.0 and cli.argument([], 0, 5) == 5
    for args in (["inspect", image], ["background", image, "16", "x"], ["detect", image, "1.6", "0.5"], ["catalog", image, "one"], ["run", folder, "r", "all"]):
        assert cli.main(args) == 0, args
    assert "bricks" in capsys.readouterr().out
    assert len(sinks.read_catalog("one.fits")) == len((tmp_path / "one.csv").read_text().splitlines()) - 4
    header = (tmp_path / "all.fits").read_bytes()[:2880]
    assert header[:30] == b"SIMPLE  =                    T" and header[80:110] == b"BITPIX  =                    8" and b"FILTER  = 'r       '" in header and len(header.rstrip()) % 80 <= 80


def test_discovery_is_sorted(spark, folder):
    paths = [r.path for r in images.find_bricks(spark, folder).select("path").collect()]
    assert len(paths) == 3 and paths == sorted(paths)


def test_bad_files():
    for data, kind in ((b"", "fits"), (b"x" * 3000, "fits"), (fits.write_image(np.zeros(5), -32), "no_image"), (fits.write_image(np.zeros((2, 3, 4)), -32), "bad_shape")):
        with pytest.raises(fits.FitsError) as e:
            fits.read_image(data)
        assert e.value.kind == kind


@pytest.fixture
def folder(tmp_path):
    for name, seed in (("0001m002", 3), ("0002m002", 4)):
        (tmp_path / f"legacysurvey-{name}-image-r.fits.fz").write_bytes(fits.write_image(noisy(seed), -32, WCS))
    (tmp_path / "legacysurvey-0003m002-image-r.fits.fz").write_bytes(b"broken")
    (tmp_path / "legacysurvey-0001m002-image-g.fits.fz").write_bytes(fits.write_image(noisy(5), -32))
    (tmp_path / "other-0001m002-image-r.fits.fz").write_bytes(b"")
    return str(tmp_path)


def test_discovery_and_errors(spark, folder):
    tiles = images.read_images(spark, folder)
    assert sorted(r.brick for r in tiles.select("brick").collect()) == ["0001m002", "0002m002", "0003m002"]
    assert [r.kind for r in images.errors(tiles).collect()] == ["fits"]
    px = images.pixels(tiles).where("brick = '0001m002'")
    assert px.count() == 3500 and px.where("v is null").count() == 2
    spark.dataSource.register(images.FitsImageSource)
    assert spark.read.format("fits_image").option("glob", "legacysurvey-*-image-r.fits.fz").load(folder).where("error is null").count() == 2


def test_pipelines(spark, folder, tmp_path):
    one = pipeline.process_brick(spark, f"{folder}/legacysurvey-0001m002-image-r.fits.fz", **CFG).collect()
    assert [r.peak_snr for r in one] == sorted((r.peak_snr for r in one), reverse=True) and one[0].ra is not None
    cat = pipeline.run(spark, folder, **CFG)
    rows = cat.collect()
    assert {r.brick for r in rows} == {"0001m002", "0002m002"} and [r.ra for r in rows] == sorted(r.ra for r in rows)
    with pytest.raises(ValueError):
        pipeline.run(spark, folder, band="z")
    with pytest.raises(OSError):
        pipeline.run(spark, folder, on_error="fail", **CFG)
    n = sinks.write_fits(cat, f"{tmp_path}/c.fits")
    table = sinks.read_catalog(f"{tmp_path}/c.fits")
    assert n == len(rows) == len(table) and table.dtype.itemsize == 78 and fits.table_dtype(False).itemsize == 66
    assert np.allclose(table["RA"], [r.ra for r in rows]) and [b.strip() for b in table["BRICK"]] == [r.brick.encode() for r in rows]
    assert (tmp_path / "c.fits").stat().st_size % 2880 == 0
    assert sinks.write_csv(cat, f"{tmp_path}/c.csv") == n
    lines = (tmp_path / "c.csv").read_text().splitlines()
    assert sum(x.startswith("#") for x in lines) == 3 and len(lines) == n + 4 and len(lines[4].split(",")) == 14


def test_stream_of_images(spark, folder, tmp_path):
    q = incremental.grow_catalog(spark, folder, f"{tmp_path}/cat", f"{tmp_path}/ckpt", CFG["bcfg"], CFG["dcfg"])
    q.awaitTermination(120)
    assert incremental.current_catalog(spark, f"{tmp_path}/cat").select("brick").distinct().count() == 2  # two images of one brick, one of another


def card(text):
    return text.encode().ljust(80)


def test_cards_by_their_bytes():
    """Values right-justified to column 30, strings quoted from column 11 and padded to eight, comments only where given."""
    assert fits.card("SIMPLE", True) == card("SIMPLE  =                    T")
    assert fits.card("EXTEND", False, "no") == card("EXTEND  =                    F / no")
    assert fits.card("NAXIS1", 96, "Bytes in a row") == card("NAXIS1  =                   96 / Bytes in a row")
    assert fits.card("FILTER", "r") == card("FILTER  = 'r       '")
    assert fits.card("OBJECT", "1234p567-long", "Brick") == card("OBJECT  = '1234p567-long'      / Brick")
    assert fits.card("CRVAL1", 187.25) == card("CRVAL1  =               187.25") and fits.card("END") == card("END")
    assert len(fits.card("COMMENT", "x" * 200)) == 80


def test_a_table_by_its_bytes(spark, tmp_path):
    """The whole file of a two-row catalog, put together by hand."""
    import struct

    names = "brick string, ra double, dec double, x double, y double, flux_iso double, flux_auto double, a double, b double, theta double, ellipticity double, kron_radius double, npix int, flags short"
    rows = [("b1", 187.5, -2.25, 3.0, 4.5, 1.25, 2.5, 0.75, 0.5, -30.0, 0.25, 3.5, 12, 1), ("a-brick-of-many-letters", None, None, 1.0, 2.0, -1.0, 0.0, 1.0, 1.0, 0.0, 0.0, 3.5, 5, 0)]
    cat = spark.createDataFrame(rows, names)
    assert sinks.write_fits(cat, f"{tmp_path}/t.fits", "g") == 2
    data = (tmp_path / "t.fits").read_bytes()
    first = b"".join(map(card, ("SIMPLE  =                    T", "BITPIX  =                    8", "NAXIS   =                    0", "EXTEND  =                    T")))
    assert data.startswith(first) and len(data) % 2880 == 0 and set(data[len(data) - 2880 + 2 * 78 :]) == {0}
    at = data.index(b"XTENSION")
    assert at == 2880 and data[at : at + 80] == card("XTENSION= 'BINTABLE'")
    for text in ("NAXIS1  =                   78", "NAXIS2  =                    2", "TFIELDS =                   14", "TTYPE1  = 'BRICK   '", "TFORM1  = '12A     '", "TTYPE2  = 'RA      '", "TFORM2  = '1D      '", "TUNIT2  = 'deg     '", "TTYPE14 = 'FLAGS   '", "TFORM14 = '1I      '"):
        assert text.encode() in data[at:], text
    body = b"".join(r[0].encode()[:12].ljust(12) + struct.pack(">4d7fih", *(float("nan") if v is None else v for v in r[1:5]), *r[5:12], r[12], r[13]) for r in rows)
    assert data[-2880:][: len(body)] == body
    assert sinks.write_fits(cat.where("brick = 'b1'"), f"{tmp_path}/one.fits", "g", "b1") == 1 and b"OBJECT  = 'b1      '" in (tmp_path / "one.fits").read_bytes()
    assert sinks.write_fits(cat.limit(0), f"{tmp_path}/none.fits") == 0 and len(sinks.read_catalog(f"{tmp_path}/none.fits")) == 0
    assert sinks.write_csv(cat.limit(0), f"{tmp_path}/none.csv") == 0 and len((tmp_path / "none.csv").read_text().splitlines()) == 4
    with pytest.raises(ValueError, match="part files"):
        sinks.write_fits(cat, "s3a://bucket/t.fits")


def test_tasks_write_at_their_places(tmp_path):
    """A piece that is written in part, again, or twice over leaves the same file; a stopped write leaves none."""
    import pyarrow as pa

    from skyframe.sources.whole_file import PieceWriter

    w = PieceWriter(f"{tmp_path}/f", b"head", 22)
    batch = lambda *rows: pa.RecordBatch.from_pylist([{"base": b, "content": c} for b, c in rows])
    (tmp_path / "f").write_bytes(b"old")

    def broken():
        yield batch((10, b"6789"))
        raise OSError("executor lost")

    with pytest.raises(OSError, match="lost"):
        w.write(broken())
    assert (tmp_path / "f").read_bytes() == b"old"
    again = [w.write(iter([batch((10, b"6789"), (10, b"ab")), batch((10, b"cd"))])), w.write(iter([batch((4, b"012"), (4, b"345"))])), w.write(iter([]))]
    w.commit(again)
    assert (tmp_path / "f").read_bytes() == b"head0123456789abcd\0\0\0\0"
    w.write(iter([batch((4, b"zzz"))]))
    w.abort([])
    assert sorted(p.name for p in tmp_path.iterdir()) == ["f"] and (tmp_path / "f").read_bytes().startswith(b"head01")


RETRIED = """
import sys
from pyspark import TaskContext
from pyspark.sql import SparkSession
from skyframe.sources import whole_file

folder = sys.argv[1]
spark = SparkSession.builder.master("local[3,3]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "3").config("spark.checkpoint.dir", folder + "/shared").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
lines = spark.range(0, 5000, 1, 7).selectExpr("encode(concat(id, '\\n'), 'utf-8') as content")
pieces, end, n = whole_file.placed(lines, 5)


def fails_once(batches):
    for k, b in enumerate(batches):
        yield b
        if k == 1 and TaskContext.get().partitionId() == 1 and TaskContext.get().attemptNumber() == 0:
            open(folder + "/failed", "w").close()
            raise RuntimeError("lost")


spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
whole_file.save(pieces.mapInArrow(fails_once, "base long, content binary"), folder + "/out.txt", b"head\\n", end)
assert n == 5000
"""


def test_a_failed_task_writes_again(tmp_path):
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    (tmp_path / "job.py").write_text(RETRIED)
    done = subprocess.run([sys.executable, str(tmp_path / "job.py"), str(tmp_path)], env=os.environ | {"PYTHONPATH": root, "SPARK_LOCAL_IP": "127.0.0.1"}, capture_output=True, text=True, timeout=240)
    assert done.returncode == 0, done.stderr[-1500:]
    assert (tmp_path / "failed").exists() and not (tmp_path / "out.txt.draft").exists()
    assert (tmp_path / "out.txt").read_text() == "head\n" + "".join(f"{i}\n" for i in range(5000))


def test_progress_of_a_retried_run(tmp_path):
    """A task fails after its first image and runs again: each image is said once, the broken one as failed."""
    import subprocess
    import sys

    for k in range(5):
        (tmp_path / f"legacysurvey-000{k}m002-image-r.fits.fz").write_bytes(fits.write_image(noisy(k), -32, WCS))
    (tmp_path / "legacysurvey-0009m002-image-r.fits.fz").write_bytes(b"broken")
    script = f"""
import os, sys
from pyspark import TaskContext
from pyspark.sql import SparkSession
from skyframe.config import BackgroundConfig, DetectConfig
from skyframe.plans import pipeline
from skyframe.plans.progress import Progress

folder = {str(tmp_path)!r}
spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", folder + "/shared").getOrCreate()
spark.sparkContext.setLogLevel("OFF")


def fails_once(batches):
    n = 0
    for b in batches:
        for k in range(len(b)):
            yield b.iloc[k : k + 1]
            n += 1
            if n == 2 and TaskContext.get().attemptNumber() == 0:
                open(f"{{folder}}/failed{{TaskContext.get().partitionId()}}", "w").close()
                raise RuntimeError("lost")


files = spark.read.format("binaryFile").option("pathGlobFilter", "*.fz").load(folder).select("path", "content").coalesce(2)
p = Progress(spark, 6)
pipeline.combined(files.mapInPandas(fails_once, "path string, content binary"), progress=p, bcfg=BackgroundConfig(mesh=16), dcfg=DetectConfig(thresh=0.5)).count()
"""
    (tmp_path / "job.py").write_text(script)
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, str(tmp_path / "job.py")], env=os.environ | {"PYTHONPATH": root, "SPARK_LOCAL_IP": "127.0.0.1"}, capture_output=True, text=True, timeout=240)
    assert done.returncode == 0, done.stderr[-1500:]
    said = [x for x in done.stdout.splitlines() if x.startswith("[")]
    assert any(p.name.startswith("failed") for p in tmp_path.iterdir())
    assert [x.split("]")[0] for x in said] == [f"[{k}/6" for k in range(1, 7)]
    assert sorted(x.split()[1] for x in said) == [*(f"000{k}m002" for k in range(5)), "0009m002"]
    assert sum("FAILED" in x for x in said) == 1 and sum("→" in x and "sources" in x for x in said) == 5


def images_of_all_kinds(folder):
    """Plain, behind an empty unit, RICE with odd sizes, and quantised tiles."""
    rng, made = np.random.default_rng(8), {}
    for k, (name, shape) in enumerate({"plain": (37, 21), "later": (12, 30), "rice": (41, 17), "quant": (23, 40), "tiny": (2, 3)}.items()):
        x = np.round(rng.normal(100, 30, shape))
        data = fits.write_rice_image(x, WCS, 0.5 if name == "quant" else None) if name in ("rice", "quant") else fits.write_image(x, (-32, 16, 0, 0, -64)[k], WCS, leading_empty=name == "later")
        (folder / f"survey-{name}-image-{'rg'[k % 2]}.fits.fz").write_bytes(data)
        made[name] = fits.read_image(data)[0]
    return made


@pytest.mark.parametrize("splits", [1, 4, 50])
def test_strips_make_up_the_image(spark, tmp_path, splits):
    """Shares of tiles and rows, more shares than rows too; each byte is read about once."""
    from skyframe.sources import strips

    made = images_of_all_kinds(tmp_path)
    rows = strips.read_strips(spark, str(tmp_path), splits).collect()
    assert len(rows) == splits * len(made)
    for name, want in made.items():
        mine = sorted((r for r in rows if r.brick == name and r.data), key=lambda r: r.row0)
        got = np.concatenate([np.array(r.data, np.float32).reshape(-1, r.ncols) for r in mine])
        assert np.array_equal(got, want, equal_nan=True) and (r := mine[0]).wcs.crval1 == 187.0 and (r.nrows, r.ncols) == want.shape
    if splits == 4:
        big = tmp_path / "big"
        big.mkdir()
        (big / "survey-big-image-r.fits.fz").write_bytes(fits.write_rice_image(np.round(np.random.default_rng(1).normal(0, 500, (800, 300))), WCS))
        size = (big / "survey-big-image-r.fits.fz").stat().st_size
        parts = strips.read_strips(spark, str(big), 4).collect()
        assert sum(r.bytes_read for r in parts) < size + 4 * 4 * 2880 and max(r.bytes_read for r in parts) < 0.3 * size + 4 * 2880
        assert {tuple(r) for r in strips.pixels(strips.read_strips(spark, str(big), 4)).where("row = 333").collect()} == {tuple(r) for r in images.pixels(images.read_images(spark, str(big), glob="*.fz")).where("row = 333").collect()}


def test_headers_read_no_pixels(spark, tmp_path):
    """A file whose pixels are gone still has a header; filters on names open no other file."""
    from skyframe.plans.durable import setting
    from skyframe.sources import strips

    made = images_of_all_kinds(tmp_path)
    whole = (tmp_path / "survey-rice-image-r.fits.fz").read_bytes()
    (tmp_path / "survey-cut-image-r.fits.fz").write_bytes(whole[: 2880 * 3])
    (tmp_path / "survey-bad-image-g.fits.fz").write_bytes(b"broken")
    (tmp_path / "survey-none-image-g.fits.fz").write_bytes(fits.write_image(np.zeros(5), -32))
    got = {r.brick: r for r in strips.headers(spark, str(tmp_path)).collect()}
    assert {n: (got[n].nrows, got[n].ncols) for n in made} == {n: x.shape for n, x in made.items()}
    assert (got["cut"].nrows, got["cut"].ncols) == made["rice"].shape and all(r.bytes_read <= 3 * 2880 for r in got.values())
    assert (got["bad"].error_kind, got["none"].error_kind) == ("fits", "no_image")
    with setting(spark, "spark.sql.python.filterPushdown.enabled", "true"):
        for source in (strips.FitsHeaderSource, strips.FitsStripSource):
            spark.dataSource.register(source)
            load = lambda: spark.read.format(source.name()).option("pushdown", "true").load(str(tmp_path))  # noqa: E731, B023
            one = load().where("brick = 'plain' and band = 'r' and nrows > 3")
            assert {r.brick for r in one.collect()} == {"plain"}
            assert one.rdd.getNumPartitions() == (1 if source is strips.FitsHeaderSource else 4)
            assert {r.brick for r in load().where("brick in ('tiny', 'later', 'x')").collect()} == {"tiny", "later"}
            assert load().where("brick = 'plain' and brick = 'rice'").count() == 0 and load().where("ncols = 21").select("brick").distinct().count() == 1
