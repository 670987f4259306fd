"""Surveys a text collection as an image and catalogs the stretches that stand out.

For each source the spectrogram of word lengths is an image: a row is a block of consecutive
documents, a column a word length, a pixel the number of such words.  The library's background
mesh, filter and threshold by strips, and labelling in sub-tiles, so that no task holds an image, find islands:
stretches of documents whose mix of word lengths departs from what surrounds them (encoded blobs,
boilerplate, crawls that changed).

    python -m jobs.text_survey --documents DIR --out DIR [--config FILE] [--shared DIR]

Output: one row an island in Parquet, partitioned by source.  A run overwrites the whole output, so
it can be repeated; the result depends on the table alone.

Rows without doc_id or with a negative one have no place in the image; they are counted in the log.
A null or empty source is ``(none)``; a null text has no words.
"""

from __future__ import annotations

import logging

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import beside, command, new_folder, settings
from skyframe.config import BackgroundConfig, DetectConfig
from skyframe.functions.scalar import q
from skyframe.operators import detect
from skyframe.plans import pipeline
from skyframe.plans.durable import ARROW_BYTES, ARROW_ROWS, cut, setting

DEFAULTS = {"block": 16, "longest": 32, "mesh": 8, "kappa": 3.0, "sigma": 1.0, "thresh": 3.0, "minarea": 3, "tile": 256}
log = logging.getLogger("jobs.text_survey")


def word_counts(batch: pa.RecordBatch, longest: int) -> pa.RecordBatch:
    """``brick, row, col, v`` of the documents ``brick, row, text`` of a batch, from the bytes of all its texts at once."""
    text = pc.fill_null(batch.column("text").cast(pa.large_string()), "")
    at = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    inside = np.r_[(data != 32) & (data - np.uint8(9) > 4), False]
    start = np.zeros(len(data) + 1, bool)  # of texts, where words end too
    start[at - at[0]] = True
    begin = np.flatnonzero(inside & (start | ~np.r_[False, inside[:-1]]))
    end = np.flatnonzero(inside[:-1] & (start[1:] | ~inside[1:])) + 1
    points = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
    col = np.minimum(points[end] - points[begin], longest) - 1
    brick = pc.dictionary_encode(batch.column("brick"))
    row = batch.column("row").to_numpy(zero_copy_only=False).astype(np.int64)
    places, place = np.unique(np.c_[brick.indices.to_numpy(zero_copy_only=False), row], axis=0, return_inverse=True)
    key = place.ravel()[np.searchsorted(at - at[0], begin, "right") - 1] * longest + col
    if len(places) * longest <= 1 << 20:
        v = np.bincount(key)
        key = np.flatnonzero(v)
        v = v[key]
    else:
        key, v = np.unique(key, return_counts=True)
    p = places[key // longest]
    return pa.record_batch([brick.dictionary.take(pa.array(p[:, 0])), pa.array(p[:, 1], pa.int32()), pa.array(key % longest, pa.int32()), pa.array(v, pa.int64())], ["brick", "row", "col", "v"])


def spectrogram(docs: DataFrame, block: int, longest: int) -> DataFrame:
    """``brick, row, col, v``: words by source, block of documents and length; sums are made before the shuffle."""
    source = F.coalesce(F.expr("nullif(source, '')"), F.lit("(none)")).alias("brick")
    texts = docs.where("doc_id >= 0").select(source, F.expr(f"cast(doc_id div {block} as int)").alias("row"), "text")
    words = texts.mapInArrow(lambda batches: (word_counts(b, longest) for b in batches if b.num_rows), "brick string, row int, col int, v long")
    return words.groupBy("brick", "row", "col").agg(F.sum("v").cast("double").alias("v"))


def run(spark: SparkSession, documents: str, out: str, config: str | None = None) -> int:
    """Survey the table at ``documents`` into ``out``; the number of islands."""
    c = settings(DEFAULTS, config)
    docs = spark.read.parquet(documents).select("doc_id", "source", "text")
    told = docs.agg(F.count("*").alias("n"), F.count_if(F.expr("doc_id is null or doc_id < 0")).alias("placeless")).first()
    log.info("read %s: %d documents, %d of them without a place", documents, told.n, told.placeless)
    cfg = DetectConfig(c["sigma"], c["thresh"], c["minarea"])
    with setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS)), setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES)):
        sparse = cut(spectrogram(docs, c["block"], c["longest"]))
    rows = (sparse.agg(F.max("row")).first()[0] or 0) + 1
    px = cut(pipeline.masked_strips(sparse, rows, c["longest"], BackgroundConfig(c["mesh"], c["kappa"]), cfg, c["tile"]))
    found = detect.detections(cut(pipeline.labelled(px, cfg, c["tile"])), cfg)
    islands = found.select(
        F.col("brick").alias("source"), "label", "npix", (F.col("rmin").cast("long") * c["block"]).alias("first_doc"), ((F.col("rmax").cast("long") + 1) * c["block"] - 1).alias("last_doc"),
        (F.col("cmin") + 1).alias("shortest"), (F.col("cmax") + 1).alias("longest"), (F.col("peak_row").cast("long") * c["block"]).alias("peak_doc"), (F.col("peak_col") + 1).alias("peak_length"), "peak_snr",
    )
    # rows of one source may go to several files
    islands.hint("rebalance", "source").write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("source").parquet(out)
    n = written(spark, out).count()
    log.info("wrote %s: %d islands", out, n)
    return n


def written(spark: SparkSession, out: str) -> DataFrame:
    schema = "label int, npix int, first_doc long, last_doc long, shortest int, longest int, peak_doc long, peak_length int, peak_snr double, source string"
    return spark.read.schema(schema).parquet(out)


def job1_text_survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over the whole table into one new folder."""
    d = new_folder(spark, "text_survey")
    for _ in range(2):
        run(spark, f"{sf_dir}/documents.parquet", f"{d}/islands", beside(__file__))
    return written(spark, f"{d}/islands").withColumn("peak_snr", q(F.col("peak_snr")))


if __name__ == "__main__":
    command("text_survey", __doc__, ("documents", "out"), beside(__file__), run)
