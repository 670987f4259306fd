"""Command line: ``python -m skyframe inspect|background|detect|measure|catalog|run PATH ...``.

Arguments are positional with defaults, and one that cannot be read takes its default:
``background FILE [mesh] [kappa]``, ``detect|measure FILE [sigma] [thresh] [minarea]``,
``catalog FILE [stem] [band]``, ``run FOLDER [band] [stem]``.
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import BackgroundConfig, DetectConfig
from .operators import background, summaries
from .plans import pipeline
from .sources import images, sinks


def argument(args: list[str], k: int, default):
    try:
        return type(default)(args[k])
    except (IndexError, ValueError):
        return default


def report(title: str, df: DataFrame) -> None:
    print(title)
    df.show(20, False)


def main(args: list[str]) -> int:
    if len(args) < 2:
        print(__doc__)
        return 1
    command, path, rest = args[0], args[1], args[2:]
    spark = SparkSession.builder.appName("skyframe").getOrCreate()
    if command == "run":
        band, stem = argument(rest, 0, "r"), argument(rest, 1, "catalog")
        cat = pipeline.run(spark, path, band, same_brick=False, say=print).cache()
        sinks.write_fits(cat, f"{stem}.fits", band)
        sinks.write_csv(cat, f"{stem}.csv", band)
        report("bricks", cat.groupBy("brick").agg(F.count("*").alias("sources")).orderBy("brick"))
        report("catalog", summaries.flux_stats(cat))
        return 0
    folder, _, name = path.rpartition("/")
    tiles = images.read_images(spark, folder or ".", glob=name)
    bad = images.errors(tiles).first()
    if bad:
        print(f"{bad.path}: {bad.message}", file=sys.stderr)
        return 1
    if command in ("inspect", "background"):
        px = images.pixels(tiles)
        dims = pipeline.dimensions(px)
        if command == "inspect":
            report("pixels", summaries.image_stats(px))
            report("sky", summaries.sky_patch(px, dims))
        else:
            cfg = BackgroundConfig(argument(rest, 0, 64), argument(rest, 1, 3.0))
            grid = background.grid(px, cfg)
            report("mesh", summaries.grid_summary(grid))
            report("residual", summaries.residual_stats(background.residual(background.interpolate(px, grid, cfg.mesh))))
        return 0
    cfg = DetectConfig(argument(rest, 0, 1.6), argument(rest, 1, 1.5), argument(rest, 2, 5)) if command in ("detect", "measure") else DetectConfig()
    cat = pipeline.catalog_of_tiles(tiles, dcfg=cfg).cache()
    if command == "detect":
        report("detections", summaries.detection_summary(cat))
        report("brightest", summaries.top(cat, "peak_snr", 10))
    elif command == "measure":
        report("sources", summaries.flux_stats(cat))
        report("brightest", summaries.top(cat, "flux_auto", 15))
    elif command == "catalog":
        stem, band = argument(rest, 0, "catalog"), argument(rest, 1, "r")
        brick = tiles.select("brick").first().brick
        out = cat.orderBy(F.desc("flux_auto"), "label")
        sinks.write_fits(out, f"{stem}.fits", band, brick)
        sinks.write_csv(out, f"{stem}.csv", band, brick)
        report("catalog", summaries.flux_stats(cat))
    else:
        print(__doc__)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
