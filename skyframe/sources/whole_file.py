"""One file written by many tasks: a sink of Spark's data source interface for pieces at known places.

Every partition of the sorted pieces has a base offset in the file, known before the write from one row
a partition.  Tasks write their pieces there, so a task that runs again writes the same bytes to
the same place; the driver writes nothing but the header, and renames the file when all tasks are done.
Nothing under the final name is ever half written.

The folder must be one that driver and executors mount; other file systems can't write at an offset.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..plans.durable import cut, tune


def mounted(path: str) -> str:
    """The absolute path without ``file:``; other schemes raise."""
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return os.path.abspath(path)
    if scheme != "file":
        raise ValueError(f"{path}: one file can only be written to a folder that driver and executors mount; write part files instead")
    return "/" + rest.lstrip("/")


@dataclass
class Written(WriterCommitMessage):
    size: int


class PieceWriter(DataSourceArrowWriter):
    def __init__(self, path: str, head: bytes, size: int):
        self.path, self.head, self.size = path, head, size

    @property
    def draft(self) -> str:
        return f"{self.path}.draft"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        done, now = 0, None
        with os.fdopen(os.open(self.draft, os.O_WRONLY | os.O_CREAT, 0o644), "wb") as f:
            for batch in iterator:
                for base, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if base != now:
                        f.seek(base)
                        now = base
                    f.write(content)
                    done += len(content)
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        done = sum(m.size for m in messages if m)
        if len(self.head) + done > self.size:
            raise OSError(f"{self.path}: {done} bytes in pieces do not fit {self.size}")
        with os.fdopen(os.open(self.draft, os.O_WRONLY | os.O_CREAT, 0o644), "wb") as f:
            f.write(self.head)
            f.truncate(self.size)  # what is beyond the pieces is zero
        os.replace(self.draft, self.path)

    def abort(self, messages: list[Written | None]) -> None:
        if os.path.exists(self.draft):
            os.remove(self.draft)


class WholeFileSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "whole_file"

    def schema(self) -> str:
        return "base long, content binary"

    def writer(self, schema, overwrite: bool) -> PieceWriter:
        return PieceWriter(self.options["path"], bytes.fromhex(self.options["head"]), int(self.options["size"]))


def placed(pieces: DataFrame, head: int) -> tuple[DataFrame, int, int]:
    """``base, content`` of ``pieces(content)`` in their present order behind ``head`` bytes, the end of the last one, and their number."""
    spark = pieces.sparkSession
    tune(spark)
    rows = cut(pieces.select("content", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("i")))
    sizes = {r.part: r for r in rows.groupBy("part").agg(F.sum(F.length("content")).alias("size"), F.count("*").alias("n")).collect()}  # one row for each partition
    bases, at = [], head
    for part in sorted(sizes):
        bases.append((part, at))
        at += sizes[part].size
    base = spark.createDataFrame(bases, "part int, base long")
    n = max(1, min(len(bases), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return rows.join(base, "part").repartition(n, "part").sortWithinPartitions("part", "i").select("base", "content"), at, sum(r.n for r in sizes.values())


def save(pieces: DataFrame, path: str, head: bytes, size: int) -> None:
    """Write placed pieces as the file ``path`` of ``size`` bytes."""
    spark = pieces.sparkSession
    spark.dataSource.register(WholeFileSink)
    pieces.write.format("whole_file").mode("append").option("path", mounted(path)).option("head", head.hex()).option("size", str(size)).save()
