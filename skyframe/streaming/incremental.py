"""Catalogs that grow as images arrive: a file stream, one catalog batch at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import BackgroundConfig, DedupConfig, DetectConfig, MeasureConfig
from ..operators.dedup import deduplicate
from ..plans.pipeline import catalog_of_tiles
from ..sources.images import decoded


def arriving(spark: SparkSession, folder: str, glob: str = "legacysurvey-*.fits*") -> DataFrame:
    """``path, content`` of image files as they appear."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).load(folder)


def grow_catalog(spark: SparkSession, folder: str, catalog: str, checkpoint: str, bcfg: BackgroundConfig = BackgroundConfig(), dcfg: DetectConfig = DetectConfig(), mcfg: MeasureConfig = MeasureConfig()) -> StreamingQuery:
    """Append the sources of new images to a Parquet catalog, partitioned by batch; each batch is written once.

    A repeated batch after a failure overwrites its own folder, so rows never double.
    """

    def write(batch: DataFrame, number: int) -> None:
        catalog_of_tiles(decoded(batch), bcfg, dcfg, mcfg).write.mode("overwrite").parquet(f"{catalog}/batch={number}")

    return arriving(spark, folder).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_catalog(spark: SparkSession, catalog: str, cfg: DedupConfig = DedupConfig()) -> DataFrame:
    """The de-duplicated catalog of all batches so far."""
    c = spark.read.parquet(catalog).withColumn("id", F.concat_ws("|", F.format_string("%010d", "batch"), "brick", F.format_string("%010d", "label")))
    return deduplicate(c, cfg).drop("id")
