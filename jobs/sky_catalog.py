"""Keeps a de-duplicated sky catalog as observations arrive (incremental).

Reads new files of an orders table as sources on the sky, merges them batch by batch into a
catalog kept by declination zone, and remembers in a stream checkpoint which files it has taken.
A second run takes only files that are new; without any it changes nothing.

    python -m jobs.sky_catalog --orders DIR --out DIR --checkpoint DIR [--config FILE] [--shared DIR]

Output: ``OUT/batch=N/zone=Z`` in Parquet, each batch with the whole new version of the zones that it
changed; ``stored`` and ``skyframe.streaming.zones.catalog`` read what counts.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import beside, command, new_folder, settings
from skyframe.config import DedupConfig
from skyframe.functions.scalar import q
from skyframe.sources import views
from skyframe.streaming import zones

DEFAULTS = {"tolerance_arcsec": 1.0, "same_brick": False, "zone_degrees": zones.HEIGHT, "files_per_batch": 64}
log = logging.getLogger("jobs.sky_catalog")


def run(spark: SparkSession, orders: str, out: str, checkpoint: str, config: str | None = None) -> int:
    """Take what is new under ``orders`` into the catalog at ``out``; the number of rows that this run read."""
    c = settings(DEFAULTS, config)
    table = spark.read.parquet(orders)
    path = orders.rstrip("/")
    # as a pattern that only this path meets: a file stream takes a plain path for a folder, and the table may be one file
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", c["files_per_batch"]).parquet(f"{path[:-1]}[{path[-1]}]")
    work = zones.follow(views.sky_of(stream), out, checkpoint, DedupConfig(c["tolerance_arcsec"], c["same_brick"]), c["zone_degrees"])
    work.awaitTermination()
    read = sum(p["numInputRows"] for p in work.recentProgress)
    log.info("read %s: %d new rows in %d batches", orders, read, sum(p["numInputRows"] > 0 for p in work.recentProgress))
    held = stored(spark, out).groupBy("gone").count().collect()
    log.info("wrote %s: %s", out, ", ".join(f"{r['count']} {'removed' if r.gone else 'kept'}" for r in held) or "nothing")
    return read


def stored(spark: SparkSession, out: str) -> DataFrame:
    """Every source that was taken, with ``zone`` and whether it is ``gone``."""
    schema = views.sky_of(spark.createDataFrame([], "o_orderkey long, o_custkey long, o_orderpriority string, o_totalprice double")).schema
    return zones.newest(zones.versions(spark, out, schema)).drop("batch")


def job2_sky_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over the whole table into one new folder."""
    d = new_folder(spark, "sky_catalog")
    for _ in range(2):
        run(spark, f"{sf_dir}/orders.parquet", f"{d}/catalog", f"{d}/checkpoint", beside(__file__))
    s = stored(spark, f"{d}/catalog")
    return s.select("id", "brick", q(F.col("ra"), 7).alias("ra"), q(F.col("dec"), 7).alias("dec"), "npix", "zone", "gone")


if __name__ == "__main__":
    command("sky_catalog", __doc__, ("orders", "out", "checkpoint"), beside(__file__), run)
