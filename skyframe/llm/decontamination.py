"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Texts are lower-case words without ASCII marks.  Every ``SEED`` consecutive words of an item are
a seed (a shorter item is one seed).  One pass counts in how many documents each seed occurs; an
item keeps its rare seeds, those not far above its rarest one, so an item that leaked everywhere
keeps some too.  A second pass finds the kept seeds, gathers hits of an item on nearby diagonals
into windows, and aligns each window with the item word by word (local alignment, linear gaps).
A score of ``LEAST`` or more of the item's greatest one is a leak: exact, edited and partly
paraphrased copies.

The benchmark is the query set: it is taken in blocks of ``BLOCK_SEEDS`` seeds, each with its own
two passes, so what is broadcast is bounded however large the benchmark.  Documents are never
shuffled; only matches leave the passes.

Edge cases: null or empty texts match nothing; items without words match nothing; repeated rows
of documents give repeated matches, repeated item rows with one id and text count once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

SEED = 4
BLOCK_SEEDS = 200_000
LEAST = 0.55
MATCH, MISMATCH, GAP = 2, -1, -1
RARE_FACTOR, RARE_FLOOR = 8, 100  # a seed is rare up to RARE_FACTOR times the item's rarest plus RARE_FLOOR documents


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Best local alignment score of two word sequences and the end of it in ``b``."""
    best, end = 0, 0
    row = np.zeros(len(b) + 1, np.int64)
    slope = GAP * np.arange(len(b) + 1)
    for x in a:
        t = np.maximum(0, row + GAP)
        t[1:] = np.maximum(t[1:], row[:-1] + np.where(b == x, MATCH, MISMATCH))
        row = np.maximum.accumulate(t - slope) + slope  # gaps along the row
        top = int(row.max())
        if top > best:
            best, end = top, int(row.argmax())
    return best, end


class Items:
    """A block of benchmark items with their seeds."""

    def __init__(self, rows: list[tuple[int, bytes]]):
        self.ids = [r[0] for r in rows]
        h, at = C.hash_words([r[1] for r in rows], lower=True, marks=True)
        self.words = [h[at[i] : at[i + 1]] for i in range(len(rows))]
        seed, item, place = [], [], []
        for i, w in enumerate(self.words):
            n = min(SEED, len(w))
            if n:
                g = C.window_hashes(w, n) if n > 1 else w
                seed.append(C.mix(g, 100 + n))
                item.append(np.full(len(g), i))
                place.append(np.arange(len(g)))
        cat = lambda x, t: np.concatenate(x).astype(t) if x else np.empty(0, t)
        self.seed, self.item, self.place = cat(seed, np.uint64), cat(item, np.int64), cat(place, np.int64)
        self.sizes = sorted({min(SEED, len(w)) for w in self.words if len(w)})
        self.keep(np.ones(len(self.seed), bool))

    def keep(self, rare: np.ndarray) -> None:
        order = np.argsort(self.seed, kind="stable")
        order = order[rare[order]]
        self.order = order
        s = self.seed[order]
        first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.empty(0, np.int64)
        self.distinct, self.first, self.count = s[first], first, np.diff(np.r_[first, len(s)])
        self.bits = np.zeros(1 << 21, bool)  # answers most lookups at once
        self.bits[(self.distinct & np.uint64((1 << 21) - 1)).astype(np.int64)] = True

    def hits(self, h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Batch positions and indices into ``distinct`` of all seed occurrences inside a document."""
        pos, idx = [], []
        for n in self.sizes:
            g = C.mix(C.window_hashes(h, n) if n > 1 else h, 100 + n)
            p = np.flatnonzero(self.bits[(g & np.uint64((1 << 21) - 1)).astype(np.int64)])
            if len(p) and len(self.distinct):
                i = np.minimum(np.searchsorted(self.distinct, g[p]), len(self.distinct) - 1)
                ok = self.distinct[i] == g[p]
                p, i = p[ok], i[ok]
                doc = np.searchsorted(at, p, side="right") - 1
                ok = p + n <= at[doc + 1]
                pos.append(p[ok])
                idx.append(i[ok])
        if not pos:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(pos), np.concatenate(idx)

    def rare(self, df: np.ndarray) -> np.ndarray:
        """Which seeds stay, given the document count of each distinct seed."""
        own = df[np.searchsorted(self.distinct, self.seed)]
        least = np.full(len(self.ids), np.iinfo(np.int64).max)
        np.minimum.at(least, self.item, own)
        return own <= RARE_FACTOR * least[self.item] + RARE_FLOOR


def matches_of(items: Items, h: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, float, int, int]]:
    """``(document, item, score, first word, words)`` of a batch."""
    pos, idx = items.hits(h, at)
    if not len(pos):
        return
    n = items.count[idx]
    entry = items.order[C.ragged(items.first[idx], n)]
    pos = np.repeat(pos, n)
    doc = np.searchsorted(at, pos, side="right") - 1
    item, diagonal = items.item[entry], pos - items.place[entry]
    order = np.lexsort((diagonal, item, doc))
    doc, item, diagonal = doc[order], item[order], diagonal[order]
    size = np.array([len(w) for w in items.words])[item]
    slack = size // 2 + 2  # insertions and deletions that a window allows for
    new = np.r_[True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (diagonal[1:] - diagonal[:-1] > slack[1:])]
    cuts = np.r_[np.flatnonzero(new), len(doc)]
    best: dict[tuple[int, int], tuple[float, int, int]] = {}
    for a, b in zip(cuts[:-1], cuts[1:]):
        d, it = int(doc[a]), int(item[a])
        if best.get((d, it), (0,))[0] >= 1:
            continue
        w, lo = items.words[it], int(at[d])
        # a chain of diagonals longer than the slack is cut so that a window stays near the item's length
        for s in range(int(diagonal[a]), int(diagonal[b - 1]) + 1, int(slack[a]) + 1):
            i, j = np.searchsorted(diagonal[a:b], s), np.searchsorted(diagonal[a:b], s + slack[a], side="right")
            near = diagonal[a + i : a + j]
            if len(near):
                x = max(lo, int(near[0]) - int(slack[a]))
                y = min(int(at[d + 1]), int(near[-1]) + len(w) + int(slack[a]))
                score, end = align(w, h[x:y])
                if score / (MATCH * len(w)) > best.get((d, it), (0,))[0]:
                    best[d, it] = (score / (MATCH * len(w)), x - lo, end)
    for (d, i), (score, start, length) in best.items():
        if score >= LEAST:
            yield d, i, score, start, length


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, text_md5, item_id, score, window_start, window_words``: one row per document and item that it holds."""
    spark = docs.sparkSession
    C.tune(spark)
    rows = C.text_bytes(docs, C.doc_id_col())
    items = C.cut(benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text")).where("text is not null").distinct())
    words = items.select(F.sum(F.octet_length("text")).alias("b")).first().b or 0
    blocks = max(1, -(-int(words) // (2 * BLOCK_SEEDS)))  # a seed takes two bytes at least
    out = None
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        block = Items([(r.item_id, bytes(r.text)) for r in part.orderBy("item_id", "text").collect()])  # about BLOCK_SEEDS seeds
        shared = spark.sparkContext.broadcast(block)

        def count(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block, df = shared.value, None
            for b in batches:
                h, at = C.hash_words(b.column(1).to_pylist(), lower=True, marks=True)
                pos, idx = block.hits(h, at)
                if df is None:
                    df = np.zeros(len(block.distinct), np.int64)
                if len(pos):
                    doc = np.searchsorted(at, pos, side="right") - 1
                    once = np.unique(doc * len(df) + idx)
                    np.add.at(df, once % len(df), 1)
            if df is not None:
                i = np.flatnonzero(df)
                yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(df[i], pa.int64())], ["i", "n"])

        df = np.zeros(len(block.distinct), np.int64)
        for r in rows.mapInArrow(count, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect():
            df[r.i] = r.n
        block.keep(block.rare(df))
        kept = spark.sparkContext.broadcast(block)

        def match(batches: Iterator[pa.RecordBatch], kept=kept) -> Iterator[pa.RecordBatch]:
            block = kept.value
            for b in batches:
                ids, texts = (c.to_pylist() for c in b.columns)
                h, at = C.hash_words(texts, lower=True, marks=True)
                got = list(matches_of(block, h, at))
                md5 = [hashlib.md5(texts[g[0]], usedforsecurity=False).hexdigest() for g in got]
                yield pa.RecordBatch.from_arrays([pa.array([ids[g[0]] for g in got], pa.int64()), pa.array(md5, pa.string()), pa.array([block.ids[g[1]] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.float64()), pa.array([g[3] for g in got], pa.int64()), pa.array([g[4] for g in got], pa.int64())], ["doc_id", "text_md5", "item_id", "score", "window_start", "window_words"])

        found = rows.mapInArrow(match, "doc_id long, text_md5 string, item_id long, score double, window_start long, window_words long")
        out = found if out is None else out.unionByName(found)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item.

    Rows go by doc_id and text together, so another text under the same or no doc_id stays; null
    texts always stay.
    """
    bad_id, bad_text = C.fresh(docs, "bad_id", "bad_text")
    bad = C.cut(leaks(docs, benchmark)).select(F.col("doc_id").alias(bad_id), F.col("text_md5").alias(bad_text)).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(bad_id)) & (F.md5(F.col("text").cast("binary")) == F.col(bad_text))
    return docs.join(bad, same, "left_anti")


def op3_decontamination(spark, sf_dir: str) -> DataFrame:
    found = leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.drop("text_md5").withColumn("contaminated", F.lit(True))
