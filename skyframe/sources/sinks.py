"""Catalog sinks: CSV with fixed decimals and FITS binary tables."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fits, whole_file

#: Fixed values of the CSV format: column, catalog field, decimals (None: as it is).
CSV = (
    ("ra", "ra", 7), ("dec", "dec", 7), ("x_image", "x", 4), ("y_image", "y", 4), ("flux_iso", "flux_iso", 6), ("flux_auto", "flux_auto", 6), ("a_image", "a", 3),
    ("b_image", "b", 3), ("theta", "theta", 2), ("ellip", "ellipticity", 4), ("kron_rad", "kron_radius", 3), ("npix", "npix", None), ("flags", "flags", None),
)


def csv_lines(catalog: DataFrame, multi: bool) -> DataFrame:
    """``catalog`` with ``line``: the row as text, missing coordinates as ``nan``."""
    parts = [F.col("brick")] if multi else []
    for _, field, digits in CSV:
        x = F.col(field).cast("string") if digits is None else F.format_string(f"%.{digits}f", F.bround(F.col(field).cast("double"), digits))  # ties to even
        parts.append(F.when(F.col(field).isNull(), "nan").otherwise(x))
    return catalog.withColumn("line", F.concat_ws(",", *parts))


def csv_header(multi: bool, band: str, brick: str = "") -> list[str]:
    names = (["brick"] if multi else []) + [c[0] for c in CSV]
    about = f"band={band}" if multi else f"brick={brick} band={band}"
    return ["# Source catalog", f"# {about}", "# written by skyframe", ",".join(names)]


def write_csv(catalog: DataFrame, path: str, band: str = "r", brick: str | None = None) -> int:
    """One CSV file, rows in the catalog's order, written by the tasks; the number of rows."""
    multi = brick is None
    head = ("\n".join(csv_header(multi, band, brick or "")) + "\n").encode()
    lines = csv_lines(catalog, multi).select(F.encode(F.concat("line", F.lit("\n")), "utf-8").alias("content"))
    pieces, end, n = whole_file.placed(lines, len(head))
    whole_file.save(pieces, path, head, end)
    return n


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """``value``: the lines of a catalog without its head."""
    names = [",".join((["brick"] if multi else []) + [c[0] for c in CSV]) for multi in (False, True)]
    return spark.read.text(path).where(~F.col("value").startswith("#") & ~F.col("value").isin(names))


def table_pieces(catalog: DataFrame, multi: bool) -> DataFrame:
    """``content``: each row of the catalog as the bytes of a table row, in its order."""
    fields = (["brick"] if multi else []) + [c[3] for c in fits.CATALOG]
    width = fits.table_dtype(multi).itemsize

    def run(batches):
        for b in batches:
            data = fits.table_rows(b.to_pylist(), multi)
            yield pa.RecordBatch.from_arrays([pa.array([data[i : i + width] for i in range(0, len(data), width)], pa.binary())], ["content"])

    return catalog.select(*fields).mapInArrow(run, "content binary")


def write_fits(catalog: DataFrame, path: str, band: str = "r", brick: str | None = None) -> int:
    """One FITS table, rows in the catalog's order, written by the tasks; the number of rows."""
    multi = brick is None
    start = len(fits.table_header(0, multi, band, brick or ""))
    pieces, end, n = whole_file.placed(table_pieces(catalog, multi), start)
    whole_file.save(pieces, path, fits.table_header(n, multi, band, brick or ""), start - (start - end) // fits.BLOCK * fits.BLOCK)
    return n


def read_fits(spark: SparkSession, path: str) -> DataFrame:
    """``place`` (from 1) and the columns of a written FITS table, by their catalog names."""
    folder, _, name = path.rpartition("/")
    numbers = {"f": "double", "i": "int"}
    schema = "place long, brick string, " + ", ".join(f"{c[3]} {numbers[c[4][1]]}" for c in fits.CATALOG)

    def run(batches):
        for b in batches:
            for content in b.column(0).to_pylist():
                t = fits.read_table(content)
                for at in range(0, len(t), 10_000):
                    x = t[at : at + 10_000]
                    brick = [v.decode("utf-8", "replace").strip() for v in x["BRICK"]] if "BRICK" in t.dtype.names else [None] * len(x)
                    cols = [pa.array(np.arange(at + 1, at + 1 + len(x)), pa.int64()), pa.array(brick, pa.string())]
                    for name, _, _, _, kind in fits.CATALOG:
                        v = x[name].astype(float if kind[1] == "f" else np.int32)
                        cols.append(pa.array(v, from_pandas=True))  # NaN is a missing value
                    yield pa.RecordBatch.from_arrays(cols, ["place", "brick", *(c[3] for c in fits.CATALOG)])

    files = spark.read.format("binaryFile").option("pathGlobFilter", name).load(folder)
    return files.select("content").mapInArrow(run, schema)


def write_csv_parts(catalog: DataFrame, path: str, multi: bool = True) -> None:
    """Part files written by the executors, for catalogs too large for one file."""
    csv_lines(catalog, multi).select("line").write.text(path)


def read_catalog(path: str):
    return fits.read_table(Path(path).read_bytes())


def write_files(files: DataFrame, folder: str) -> int:
    """Each row's ``content`` as the file ``folder/name``, written where the row is; the number of files.

    A file appears under its name when it is whole, so a task that runs again changes nothing.
    """
    target = whole_file.mounted(folder)

    def run(batches):
        os.makedirs(target, exist_ok=True)
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                draft = os.path.join(target, f".{name}.{uuid.uuid4().hex}")
                with open(draft, "wb") as f:
                    f.write(content)
                os.replace(draft, os.path.join(target, name))
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    return files.select("name", "content").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
