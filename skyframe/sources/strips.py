"""Parts of image files: headers without pixels, and strips of one image decoded by several tasks.

``fits_header`` reads the header blocks of each file and nothing behind them.  ``fits_strips``
gives each file to ``splits`` tasks; a task reads the header, the descriptors of its own rows of
tiles, and the one stretch of the heap (or of plain pixels) that they name.

Both know what a file name tells: a filter on ``brick`` or ``band`` leaves out files before any is
opened.  With the option ``pushdown`` Spark passes such filters down; that needs
``spark.sql.python.filterPushdown.enabled``.  The folder must be one that driver and executors mount.
"""

from __future__ import annotations

import fnmatch
import os
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, FloatType, IntegerType, LongType, StringType, StructField, StructType

from ..functions.scalar import finite
from . import fits
from .images import WCS_TYPE
from .whole_file import mounted

HEADER = StructType([
    StructField("path", StringType()), StructField("brick", StringType()), StructField("band", StringType()), StructField("nrows", IntegerType()), StructField("ncols", IntegerType()), StructField("wcs", WCS_TYPE),
    StructField("error_kind", StringType()), StructField("error", StringType()), StructField("bytes_read", LongType()),
])
STRIP = StructType([*HEADER.fields, StructField("row0", IntegerType()), StructField("data", ArrayType(FloatType()))])
NAMED = ("brick", "band")


def named(path: str) -> dict[str, str]:
    """What a file's name tells: ``survey-BRICK-image-BAND.*``."""
    parts = os.path.basename(path).partition(".")[0].split("-")
    return {"brick": parts[1] if len(parts) > 1 else "unknown", "band": parts[3] if len(parts) > 3 else ""}


class Counted:
    """A file that counts the bytes read from it."""

    def __init__(self, f: BinaryIO):
        self.f, self.n = f, 0

    def read(self, at: int, size: int) -> bytes:
        self.f.seek(at)
        data = self.f.read(size)
        self.n += len(data)
        return data


@dataclass
class Layout:
    """Where the first usable image of a file lies."""

    cards: dict
    start: int
    nrows: int
    ncols: int
    tiled: bool


def layout(f: Counted) -> Layout:
    """From header blocks alone: the file is walked unit by unit, data are passed over."""
    at, first = 0, True
    while block := f.read(at, fits.BLOCK):
        if first and not block.startswith(b"SIMPLE"):
            raise fits.FitsError("fits", "not a FITS file")
        first, data = False, block
        while not any(data[i : i + 8].rstrip() == b"END" for i in range(len(data) - fits.BLOCK, len(data), fits.CARD)):
            more = f.read(at + len(data), fits.BLOCK)
            if len(more) < fits.BLOCK:
                raise fits.FitsError("fits", "header without END")
            data += more
        h, size = fits.header(data, 0)[0], 0
        n = [h.get(f"NAXIS{k}", 0) for k in range(1, h.get("NAXIS", 0) + 1)]
        kind = h.get("XTENSION", "IMAGE")
        if kind == "IMAGE" and len(n) >= 2 and n[0] and n[1]:
            return Layout(h, at + len(data), n[1], n[0], False)
        nc, nr = h.get("ZNAXIS1"), h.get("ZNAXIS2")
        if kind == "BINTABLE" and isinstance(nc, int) and isinstance(nr, int) and nc > 0 and nr > 0:
            return Layout(h, at + len(data), nr, nc, True)
        if n:
            size = abs(h.get("BITPIX", 8)) // 8 * h.get("GCOUNT", 1) * (h.get("PCOUNT", 0) + int(np.prod(n)))
        at += len(data) + -(-size // fits.BLOCK) * fits.BLOCK
    raise fits.FitsError("no_image" if not first else "fits", "no image in the file" if not first else "not a FITS file")


def strip(f: Counted, at: Layout, part: int, parts: int) -> tuple[int, np.ndarray]:
    """First row and pixels of one of ``parts`` equal shares of an image's rows of tiles (or rows)."""
    h, nr, nc = at.cards, at.nrows, at.ncols
    deep = h.get("ZTILE2", 1) if at.tiled else 1
    across = -(-nc // h.get("ZTILE1", nc)) if at.tiled else 1
    lines = -(-nr // deep)
    a, b = lines * part // parts, lines * (part + 1) // parts
    row0, rows = a * deep, min(b * deep, nr) - a * deep
    if rows <= 0:
        return row0, np.empty((0, nc), np.float32)
    if not at.tiled:
        width = abs(h.get("BITPIX", 8)) // 8 * nc
        return row0, fits._plain(h, f.read(at.start + row0 * width, rows * width), [nc, rows])
    if h["NAXIS2"] != across * lines:
        raise fits.FitsError("bad_shape", f"{h['NAXIS2']} tiles for {nr} x {nc}")
    width, tiles = h["NAXIS1"], (b - a) * across
    table = np.frombuffer(f.read(at.start + a * across * width, tiles * width), np.uint8).reshape(tiles, width).copy()
    # the stretch of the heap that this share's descriptors name, which then count from its start
    places = [(offset, ">i4" if letter == "P" else ">i8") for offset, letter, _ in fits.columns(h).values() if letter in "PQ"]
    pairs = [np.ascontiguousarray(table[:, o : o + 2 * np.dtype(t).itemsize]).view(t).astype(np.int64) for o, t in places]
    some = np.concatenate([p[p[:, 0] > 0] for p in pairs])
    low, high = (int(some[:, 1].min()), int((some[:, 0] + some[:, 1]).max())) if len(some) else (0, 0)
    for (o, t), p in zip(places, pairs):
        p[:, 1] = np.where(p[:, 0] > 0, p[:, 1] - low, 0)
        table[:, o : o + 2 * np.dtype(t).itemsize] = p.astype(t).view(np.uint8)
    heap = at.start + h.get("THEAP", width * h["NAXIS2"])
    own = h | {"NAXIS2": tiles, "ZNAXIS2": rows, "THEAP": tiles * width, "ZDITHER0": h.get("ZDITHER0", 1) + a * across}
    return row0, fits._tiles(own, table.tobytes() + f.read(heap + low, high - low), rows, nc)


class _Part(InputPartition):
    def __init__(self, paths: list[str], part: int = 0):
        self.paths, self.part = paths, part


class _Reader(DataSourceReader):
    fields = HEADER

    def __init__(self, options):
        self.folder, self.glob, self.splits = mounted(options["path"]), options.get("glob", "*.fits*"), int(options.get("splits", "4"))
        self.asked: dict[str, set] = {}

    def files(self) -> list[str]:
        found = [self.folder] if os.path.isfile(self.folder) else sorted(os.path.join(self.folder, x) for x in os.listdir(self.folder) if fnmatch.fnmatch(x, self.glob))
        return [p for p in found if all(named(p)[c] in v for c, v in self.asked.items())]

    def partitions(self) -> list[_Part]:
        paths = self.files()
        return [_Part(paths[i : i + 64]) for i in range(0, len(paths), 64)]

    def rows(self, path: str, part: int) -> Iterator[dict]:
        with open(path, "rb") as raw:
            f = Counted(raw)
            out = {"path": path, **named(path)}
            try:
                at = layout(f)
                yield out | {"nrows": at.nrows, "ncols": at.ncols, "wcs": fits.wcs(at.cards), **self.more(f, at, part), "bytes_read": f.n}
            except fits.FitsError as e:
                if not part:
                    yield out | {"error_kind": e.kind, "error": str(e), "bytes_read": f.n}

    def more(self, f: Counted, at: Layout, part: int) -> dict:
        return {}

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(self.fields)
        for path in partition.paths:
            for r in self.rows(path, partition.part):
                yield pa.RecordBatch.from_pylist([r], schema=schema)


class _Strips(_Reader):
    fields = STRIP

    def partitions(self) -> list[_Part]:
        return [_Part([p], k) for p in self.files() for k in range(self.splits)]

    def more(self, f: Counted, at: Layout, part: int) -> dict:
        row0, x = strip(f, at, part, self.splits)
        return {"row0": row0, "data": x.ravel()}


class _Pushed:
    """Takes filters on what a file's name tells."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for x in filters:
            name = x.attribute[0] if len(getattr(x, "attribute", ())) == 1 else None
            if name in NAMED and isinstance(x, (EqualTo, In)):
                values = set(x.value) if isinstance(x, In) else {x.value}
                self.asked[name] = self.asked.get(name, values) & values
            else:
                yield x


class _PushedReader(_Pushed, _Reader):
    pass


class _PushedStrips(_Pushed, _Strips):
    pass


class FitsHeaderSource(DataSource):
    readers = (_Reader, _PushedReader)

    @classmethod
    def name(cls) -> str:
        return "fits_header"

    def schema(self) -> StructType:
        return self.readers[0].fields

    def reader(self, schema):
        return self.readers[self.options.get("pushdown", "false").lower() == "true"](self.options)


class FitsStripSource(FitsHeaderSource):
    readers = (_Strips, _PushedStrips)

    @classmethod
    def name(cls) -> str:
        return "fits_strips"


def headers(spark: SparkSession, folder: str, glob: str = "*.fits*") -> DataFrame:
    spark.dataSource.register(FitsHeaderSource)
    return spark.read.format("fits_header").option("glob", glob).load(folder)


def read_strips(spark: SparkSession, folder: str, splits: int = 4, glob: str = "*.fits*") -> DataFrame:
    spark.dataSource.register(FitsStripSource)
    return spark.read.format("fits_strips").option("glob", glob).option("splits", str(splits)).load(folder)


def pixels(strips: DataFrame) -> DataFrame:
    """``brick, row, col, v`` of good strips; non-finite values are NULL."""
    p = strips.where("error is null").select("brick", "ncols", "row0", F.posexplode("data").alias("i", "x"))
    return p.select("brick", F.expr("cast(row0 + i div ncols as int)").alias("row"), F.expr("cast(i % ncols as int)").alias("col"), finite(F.col("x")).alias("v"))
