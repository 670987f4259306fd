"""A catalog that is kept by declination zone: a batch of new sources reads and writes only zones that it touches.

Every source stays in the catalog with a mark ``gone``: what a batch brings may take a source out, and
may bring one back whose rival goes itself.  Whether a row goes depends on its component of
candidate pairs alone, so a batch decides anew the components that hold one of its rows, from the
zones of its rows and their neighbours; where such a component reaches the edge of what was read, the
next zone is read too.  Where all zones are read, components need not be told apart.

A batch writes the zones that it changed under ``batch=N/zone=Z``, whole; the newest version of a
zone counts.  Versions of a batch's own number are never read, so a batch that runs again after a
failure finds what it found before and overwrites its own folder.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..config import DedupConfig
from ..operators.dedup import decisions, removed
from ..plans.durable import cut

HEIGHT = 0.05  # degrees: a zone is far taller than a component, and there are 3,600 at most
NOWHERE = -1_000_000  # zone of sources without a position

log = logging.getLogger(__name__)


def zone_of(dec: Column, height: float = HEIGHT) -> Column:
    return F.coalesce(F.floor(dec / height).cast("int"), F.lit(NOWHERE))


def create(spark: SparkSession, path: str, schema: StructType) -> None:
    """An empty catalog, or nothing where there is one."""
    spark.createDataFrame([], schema).selectExpr("*", "false as gone", "0 as zone").write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("zone").parquet(f"{path}/batch=-1")


def versions(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """All versions of all zones: the columns of ``schema``, ``gone, batch, zone``."""
    whole = StructType(list(schema.fields)).add("gone", "boolean").add("batch", "integer").add("zone", "integer")
    return spark.read.schema(whole).parquet(path)


def newest(rows: DataFrame) -> DataFrame:
    """The last version of each zone; partition columns alone tell which that is."""
    return rows.join(rows.groupBy("zone").agg(F.max("batch").alias("batch")), ["zone", "batch"])


def catalog(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The de-duplicated catalog as it stands."""
    return newest(versions(spark, path, schema)).where("not gone").drop("gone", "batch")


def merge(batch: DataFrame, path: str, number: int, cfg: DedupConfig = DedupConfig(), height: float = HEIGHT) -> dict:
    """Take the sources of ``batch`` (``id, brick, ra, dec, npix``, further columns stay) into the catalog at ``path``.

    A known id is left as it is; of rows with one id in a batch the least counts.
    """
    spark, schema = batch.sparkSession, batch.schema
    others = [c for c in batch.columns if c != "id"]
    new = cut(batch.groupBy("id").agg(F.min(F.struct(*others)).alias("r")).select(*[F.col("id") if c == "id" else F.col(f"r.{c}") for c in batch.columns]).withColumn("zone", zone_of(F.col("dec"), height)))
    touched = {r.zone for r in new.select("zone").distinct().collect()}  # no more than there are zones
    if not touched:
        return {"new": 0, "zones_read": [], "zones_written": []}
    tol = cfg.tolerance_arcsec / 3600.0
    read = {z + d for z in touched for d in (-1, 0, 1) if z != NOWHERE} | touched
    held = {r.zone for r in versions(spark, path, schema).where(F.col("batch") < number).select("zone").distinct().collect()} - {NOWHERE}
    while True:
        known = newest(versions(spark, path, schema).where(F.col("zone").isin(sorted(read)) & (F.col("batch") < number))).drop("batch")
        fresh = new.join(known.select("id"), "id", "left_anti")
        rows = cut(known.withColumn("fresh", F.lit(False)).unionByName(fresh.withColumns({"gone": F.lit(False), "fresh": F.lit(True)})))
        if held <= read:
            gone = removed(rows, cfg).select("id", F.lit(True).alias("out"))
            fate = rows.select("id").join(gone, "id", "left").select("id", F.coalesce("out", F.lit(False)).alias("now"))
            break
        fate = cut(decisions(rows, cfg))
        own = fate.join(rows.where("fresh").select("id"), "id").select("root").distinct()
        fate = fate.join(own, "root").select("id", F.col("gone").alias("now"), "low", "high")
        ends = fate.select(F.explode(F.array(zone_of(F.col("low") - tol, height), zone_of(F.col("high") + tol, height))).alias("zone")).distinct()
        more = {r.zone for r in ends.collect()} - read
        if not more:
            break
        read |= more
    decided = rows.join(fate.select("id", "now"), "id", "left").withColumn("change", F.col("fresh") | (F.coalesce("now", "gone") != F.col("gone")))
    decided = cut(decided.withColumn("gone", F.coalesce("now", "gone")).select(*batch.columns, "gone", "zone", "change"))
    changed = sorted(r.zone for r in decided.where("change").select("zone").distinct().collect())
    if changed:
        # rows of one zone may go to several files: Spark splits what is large
        decided.where(F.col("zone").isin(changed)).drop("change").hint("rebalance", "zone").write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("zone").parquet(f"{path}/batch={number}")
    told = {"new": rows.where("fresh").count(), "zones_read": sorted(read), "zones_written": changed}
    log.info("batch %d: %d new sources; read %d zones, wrote %d", number, told["new"], len(read), len(changed))
    return told


def follow(arriving: DataFrame, path: str, checkpoint: str, cfg: DedupConfig = DedupConfig(), height: float = HEIGHT) -> StreamingQuery:
    """Merge a stream of sources, batch by batch, up to what there is now."""
    create(arriving.sparkSession, path, arriving.schema)

    def write(batch: DataFrame, number: int) -> None:
        merge(batch, path, number, cfg, height)

    return arriving.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
