"""Substring dedup by difference-cover anchors.

A window is ``WINDOW`` consecutive words.  ``COVER`` is a perfect difference set modulo
``PERIOD``: for any two positions i and j there is a shift s < PERIOD that puts both i + s and
j + s on cover positions.  With ``ANCHOR + PERIOD - 1 <= WINDOW`` two equal windows therefore
share an anchor (``ANCHOR`` words that start at a cover position), whatever their offsets, and
only 6 of 31 positions are hashed.

1. Every anchor goes, packed, to the partition of its hash; hashes of two different documents are
   shared.  The places of shared anchors return to their documents in a second packed exchange.
2. Documents with shared anchors extend them to the windows that contain them, and those windows
   are hashed whole and sent to the partition of their hash, where windows with a smaller document
   are found exactly.
3. Starts of repeated windows return to their documents in another packed exchange, one row for
   each document, and its words are marked and removed.

Senders judge what they can: of equal anchors or windows in one flush they mark all but those of
the least document themselves and pass on only that one.  A passage in a third of all documents
so reaches its partition once for each flush of a sender.  No pair of documents is ever formed,
and nothing is broadcast.  Windows are equal when their 128-bit hashes are (two independent 64-bit
hashes of 64-bit word hashes).

Edge cases: null text has no words; a null doc_id is never smaller than another and loses
nothing; repeated doc_ids do not remove each other; fewer than WINDOW words lose nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

WINDOW, PERIOD, ANCHOR = 50, 31, 20
COVER = (1, 5, 11, 24, 25, 27)  # perfect difference set modulo 31


def _inside(at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts (in the batch) of all windows that stay in one document, and their documents."""
    n = np.maximum(np.diff(at) - size + 1, 0)
    return C.ragged(at[:-1], n), np.repeat(np.arange(len(n)), n)


def _anchors(at: np.ndarray, h: np.ndarray, period: int, anchor: int, cover: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, document and hash of the anchors; positions count from the document's first word."""
    start, doc = _inside(at, anchor)
    on = np.zeros(period, bool)
    on[list(cover)] = True
    keep = on[(start - at[doc]) % period]
    start, doc = start[keep], doc[keep]
    return start, doc, C.window_hashes(h, anchor)[start] if len(start) else np.empty(0, np.uint64)


SHARED = np.uint64(1)  # lowest bit of an anchor's hash: its sender has met two documents with it
PLACES = ["u8", "i8", "i4"]  # fp, document, word


def _gather(packed: DataFrame, n: int, name: str) -> DataFrame:
    """``(doc_id, fp, name)``: the distinct places of each document as packed int32."""

    def by_document(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        fp, who, pos = C.unpack(blobs, PLACES)
        order = np.lexsort((pos, fp, who))
        fp, who, pos = fp[order], who[order], pos[order]
        if len(who):
            cuts = np.flatnonzero(np.r_[True, (who[1:] != who[:-1]) | (fp[1:] != fp[:-1]), True])
            blob = [np.unique(pos[i:j]).tobytes() for i, j in zip(cuts[:-1], cuts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(who[cuts[:-1]], pa.int64()), pa.array(fp[cuts[:-1]].view(np.int64), pa.int64()), pa.array(blob, pa.binary())], ["doc_id", "fp", name])

    return C.exchange(packed, n, by_document, f"doc_id long, fp long, {name} binary")


def _to_document(out: C.Packer, fp: np.ndarray, who: np.ndarray, pos: np.ndarray) -> None:
    out.add(C.mix(who.view(np.uint64) ^ fp), fp, who, pos)


def _on(blobs: list[bytes], n: int) -> Iterator[pa.RecordBatch]:
    """Places that a sender has found go on as they are."""
    out = C.Packer(n, PLACES)
    _to_document(out, *C.unpack(blobs, PLACES))
    yield from out.flush()


def shared_anchors(rows: DataFrame, n: int, period: int = PERIOD, anchor: int = ANCHOR, cover: tuple = COVER) -> DataFrame:
    """``(doc_id, fp, anchors)``: starts of anchors that another doc_id holds too; ``rows`` are ``doc_id, fp, text``."""
    types = ["u8", "u8", "i8", "i4"]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, known, part, size = C.Packer(n, types), C.Packer(n, PLACES, 1), [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal size
            if part:
                ah, fp, who, pos = (np.concatenate(c) for c in zip(*part))
                part.clear()
                size = 0
                order = np.lexsort((who, ah))
                h, w = ah[order], who[order]
                first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
                count = np.diff(np.r_[first, len(h)])
                two = np.flatnonzero(w[first] != w[first + count - 1])
                stay = np.ones(len(h), bool)
                if len(two):
                    all_ = order[C.ragged(first[two], count[two])]
                    _to_document(known, fp[all_], who[all_], pos[all_])
                    stay[all_] = False
                    stay[order[first[two]]] = True
                    ah[order[first[two]]] |= SHARED
                out.add(ah[stay] >> SHARED, ah[stay], fp[stay], who[stay], pos[stay])
                yield from out.flush()
                yield from known.flush()

        for b in batches:
            ids, fps = (np.array(b.column(k).to_pylist(), np.int64) for k in (0, 1))
            h, at = C.hash_words(b.column(2).to_pylist())
            start, doc, ah = _anchors(at, h, period, anchor, cover)
            if len(ah):
                part.append([ah & ~SHARED, fps.view(np.uint64)[doc], ids[doc], start - at[doc]])
                size += 28 * len(ah)
            if size >= C.PACK_BYTES:
                yield from flush()
        yield from flush()

    def find(blobs: list[bytes], kind: int) -> Iterator[pa.RecordBatch]:
        if kind:
            yield from _on(blobs, n)
            return
        ah, fp, who, pos = C.unpack(blobs, types)
        if len(ah):
            order = np.argsort(ah >> SHARED, kind="stable")
            ah, fp, who, pos = ah[order], fp[order], who[order], pos[order]
            first = np.flatnonzero(np.r_[True, ah[1:] >> SHARED != ah[:-1] >> SHARED])
            count = np.diff(np.r_[first, len(ah)])
            two = (count > 1) & ((np.minimum.reduceat(who, first) != np.maximum.reduceat(who, first)) | (np.bitwise_or.reduceat(ah, first) & SHARED == SHARED))
            hit = np.repeat(two, count)
            out = C.Packer(n, PLACES)
            _to_document(out, fp[hit], who[hit], pos[hit])
            yield from out.flush()

    return _gather(C.exchange(rows.mapInArrow(send, C.Packer.schema), n, find, C.Packer.schema, kinds=2), n, "anchors")


def repeated_windows(docs: DataFrame, window: int = WINDOW, period: int = PERIOD, anchor: int = ANCHOR, cover: tuple = COVER) -> DataFrame:
    """``(doc_id, fp, starts)``: starts (packed int32) of windows that also start in a smaller doc_id.

    ``fp`` is a hash of the text, so rows that repeat a doc_id with another text stay apart.
    """
    assert anchor + period - 1 <= window
    spark = docs.sparkSession
    C.tune(spark)
    n = C.partitions(spark)
    rows = fingerprinted(docs).where("doc_id is not null")
    marked = C.cut(shared_anchors(rows, n, period, anchor, cover))
    types = ["u8", "u8", "i8", "i4", "u8"]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, known, part, size = C.Packer(n, types), C.Packer(n, PLACES, 1), [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal size
            if part:
                w1, w2, who, pos, fp = (np.concatenate(c) for c in zip(*part))
                part.clear()
                size = 0
                order = np.lexsort((who, w2, w1))
                new = np.r_[True, (np.diff(w1[order]) != 0) | (np.diff(w2[order]) != 0)]
                gone = np.empty(len(order), bool)
                gone[order] = who[order] > who[order][np.flatnonzero(new)][np.cumsum(new) - 1]
                _to_document(known, fp[gone], who[gone], pos[gone])
                out.add(w1[~gone], *(x[~gone] for x in (w1, w2, who, pos, fp)))
                yield from out.flush()
                yield from known.flush()

        for b in batches:
            ids, fps = (np.array(b.column(k).to_pylist(), np.int64) for k in (0, 1))
            h, at = C.hash_words(b.column(2).to_pylist())
            places = [np.frombuffer(x, "i4") for x in b.column(3).to_pylist()]
            doc = np.repeat(np.arange(len(places)), [len(x) for x in places])
            if len(doc):
                start = np.concatenate(places) + at[doc]
                # windows that hold a shared anchor: starts from anchor end - window to anchor start
                lo, hi = np.maximum(start + anchor - window, at[doc]), np.minimum(start, at[doc + 1] - window)
                ok = hi >= lo
                mark = np.zeros(len(h) + 1, np.int32)
                np.add.at(mark, lo[ok], 1)
                np.add.at(mark, hi[ok] + 1, -1)
                w = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
                if len(w):
                    d = np.searchsorted(at, w, side="right") - 1
                    part.append([C.window_hashes(h, window)[w], C.window_hashes(C.mix(h, 3), window)[w], ids[d], w - at[d], fps.view(np.uint64)[d]])
                    size += 36 * len(w)
            if size >= C.PACK_BYTES:
                yield from flush()
        yield from flush()

    def judge(blobs: list[bytes], kind: int) -> Iterator[pa.RecordBatch]:
        if kind:
            yield from _on(blobs, n)
            return
        w1, w2, who, pos, fp = C.unpack(blobs, types)
        if len(w1):
            order = np.lexsort((who, w2, w1))
            w1, w2, who, pos, fp = (x[order] for x in (w1, w2, who, pos, fp))
            new = np.r_[True, (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])]
            gone = who > who[np.flatnonzero(new)][np.cumsum(new) - 1]
            out = C.Packer(n, PLACES)
            _to_document(out, fp[gone], who[gone], pos[gone])
            yield from out.flush()

    held = rows.join(marked, ["doc_id", "fp"]).select("doc_id", "fp", "text", "anchors")
    dup = C.exchange(held.mapInArrow(send, C.Packer.schema), n, judge, C.Packer.schema, kinds=2)
    return C.cut(_gather(dup, n, "starts"))


def fingerprinted(docs: DataFrame) -> DataFrame:
    return C.text_bytes(docs, C.doc_id_col()).select("doc_id", F.xxhash64("text").alias("fp"), "text")


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_removed, text`` with ``text`` the kept words joined by one space."""
    starts = repeated_windows(docs, window)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], []]
            for i, t, at in zip(*(c.to_pylist() for c in b.columns)):
                words = (t or b"").split()
                total = len(words)
                if at:
                    at = np.frombuffer(at, "i4")
                    mark = np.zeros(total + 1, np.int32)
                    np.add.at(mark, at, 1)
                    np.add.at(mark, at + window, -1)
                    words = [words[k] for k in np.flatnonzero(np.cumsum(mark[:-1]) == 0)]
                for c, v in zip(out, (i, total, total - len(words), b" ".join(words))):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.binary())], ["doc_id", "n_words", "n_removed", "text"])

    full = fingerprinted(docs).join(starts, ["doc_id", "fp"], "left").select("doc_id", "text", "starts")
    return full.mapInArrow(apply, "doc_id long, n_words long, n_removed long, text binary")


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, s, sha256(array_to_string(list_slice(w, s, s + 49), ' ')) AS h
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM d WHERE len(w) >= 50)),
lo AS (SELECT h, min(doc_id) AS m FROM win GROUP BY h),
gone AS (SELECT DISTINCT win.doc_id, unnest(range(s, s + 50)) AS p FROM win JOIN lo USING (h) WHERE lo.m < win.doc_id),
words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT words.doc_id, string_agg(x, ' ' ORDER BY words.p) AS t, count(*) AS n
         FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.p = gone.p WHERE gone.p IS NULL GROUP BY words.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
