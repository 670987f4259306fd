"""Cuts of the lineage as tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}  # by application, where no folder is named

CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"  # shuffle files go when their query has ended
ARROW_ROWS = 500  # rows in an Arrow batch: a few MB of ordinary texts
ARROW_BYTES = 8 << 20  # and bytes: one image, or a few long texts or packed values


def tune(spark: SparkSession) -> None:
    """Bound an Arrow batch, so that memory in Python does not follow the length of values.

    Every operator that hands large values to Python sets the same two bounds.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Only where the whole application is one process (``local``, as in tests) does a temporary
    folder stand in for it, which goes when that process ends.
    """
    d, sc = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if d:
        return d
    if sc.master != "local" and not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if sc.applicationId not in _own:
        _own[sc.applicationId] = tempfile.mkdtemp(prefix="skyframe-")
        atexit.register(shutil.rmtree, _own[sc.applicationId], ignore_errors=True)
    return _own[sc.applicationId]


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting for the time of an action."""
    old = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    The lineage ends there, so a lost executor costs one task and not the whole plan; the shuffle
    files of the finished plan go at once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/skyframe/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    with setting(spark, CLEAN, "true"):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
