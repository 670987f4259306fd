"""Image files as DataFrames: discovery, a data source, and pixel relations."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegerType, StringType, StructField, StructType

from ..functions.scalar import brick_name, finite
from ..plans.durable import tune
from . import fits

WCS_TYPE = StructType([StructField(k.lower(), DoubleType()) for k in fits.WCS_KEYS])
TILE = StructType([
    StructField("path", StringType()), StructField("brick", StringType()), StructField("nrows", IntegerType()), StructField("ncols", IntegerType()), StructField("wcs", WCS_TYPE),
    StructField("data", ArrayType(FloatType())), StructField("error_kind", StringType()), StructField("error", StringType()),
])


def _files(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)


def find_bricks(spark: SparkSession, folder: str, band: str = "r") -> DataFrame:
    """``path, content``: image files of a band in a folder (not below it), by path, read through Spark's file system."""
    return _files(spark, folder, f"legacysurvey-*-image-{band}.fits.fz").orderBy("path")


def read_images(spark: SparkSession, folder: str, band: str = "r", glob: str | None = None) -> DataFrame:
    """One row a file with decoded pixels, or with the error that stopped it.

    Files are decoded where they are read; a batch is bounded in bytes, so an image has one for itself.
    """
    files = _files(spark, folder, glob or f"legacysurvey-*-image-{band}.fits.fz")  # sorting would shuffle the files' contents
    tune(spark)
    return decoded(files)


def decoded(files: DataFrame) -> DataFrame:
    """Images of files ``(path, content)``, a table or a stream."""

    def decode(batches):
        for b in batches:
            rows = []
            for path, brick, content in zip(b["path"], b["brick"], b["content"]):
                try:
                    image, wcs = fits.read_image(bytes(content))
                    rows.append((path, brick, *image.shape, wcs, image.ravel(), None, None))
                except fits.FitsError as e:
                    rows.append((path, brick, None, None, None, None, e.kind, str(e)))
            yield pd.DataFrame(rows, columns=[f.name for f in TILE])

    return files.select("path", brick_name(F.col("path"), F.lit("unknown")).alias("brick"), "content").mapInPandas(decode, TILE)


def pixels(tiles: DataFrame) -> DataFrame:
    """``brick, row, col, v`` of good tiles; non-finite values are NULL."""
    p = tiles.where("error is null").select("brick", "ncols", F.posexplode("data").alias("i", "x"))
    return p.select("brick", F.expr("cast(i div ncols as int)").alias("row"), F.expr("cast(i % ncols as int)").alias("col"), finite(F.col("x")).alias("v"))


def errors(tiles: DataFrame) -> DataFrame:
    return tiles.where("error is not null").select("path", F.col("error_kind").alias("kind"), F.col("error").alias("message"))


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class FitsImageReader(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def partitions(self):
        import glob
        import os

        path = self.options["path"].removeprefix("file://")
        names = sorted(glob.glob(os.path.join(path, self.options.get("glob", "*.fits*")))) if os.path.isdir(path) else [path]
        return [_File(x) for x in names]

    def read(self, partition):
        stem = partition.path.rpartition("/")[2].partition(".")[0]
        parts = stem.split("-")
        brick = parts[1] if len(parts) > 1 else "unknown"
        try:
            with open(partition.path, "rb") as f:
                image, wcs = fits.read_image(f.read())
            yield (partition.path, brick, *image.shape, wcs and tuple(wcs.values()), image.ravel().tolist(), None, None)
        except fits.FitsError as e:
            yield (partition.path, brick, None, None, None, None, e.kind, str(e))


class FitsImageSource(DataSource):
    """``spark.read.format("fits_image").load(folder)`` for folders that all executors mount.

    ``read_images`` reads through Spark's own file system instead and suits object stores.
    """

    @classmethod
    def name(cls):
        return "fits_image"

    def schema(self):
        return TILE

    def reader(self, schema):
        return FitsImageReader(self.options)


def image_array(row) -> np.ndarray:
    return np.array(row["data"], np.float32).reshape(row["nrows"], row["ncols"])
