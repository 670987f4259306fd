"""Document fingerprints by consistent weighted sampling.

Terms are the words ``[^\\x20\\x09-\\x0D]+`` of a text, weighted by how often they stand in it.  For
every term and sample, seeded hashes give two gamma(2, 1) variates ``r`` and ``c`` and a uniform
``beta``; a term of weight w takes ``t = floor(ln w / r + beta)`` and ``ln a = ln c - r (t - beta) - r``.
The term with the least ``a`` and its ``t`` are the sample.  Two texts share a sample with the
probability of their generalised Jaccard similarity, sum of least over sum of greatest weights, so
the share of equal samples estimates it (standard error 0.0625 at most with 64 samples).

A sample is kept in 16 bits, so unlike texts agree on one in 65,536 samples by chance.  Nothing is
collected: fingerprints need no shuffle, and neighbours in the order of doc_id meet by one range
sort, whose partitions hand only their first and last rows on.

Edge cases: null text counts as empty; a text without words has the empty fingerprint, which is
equal to itself (likeness 1) and unlike all others (0); equal texts have equal fingerprints; null
doc_ids come last in descending order; rows of equal doc_id follow the order of a hash of the text,
then of the text; a table of one row is its own neighbour; other columns are never read.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

SAMPLES = 64
CHUNK = 16_384  # terms whose variates are in memory at once
GROUP_BYTES = 320_000  # texts that are sampled together, as they share many terms

_LOG = (-np.log((np.arange(1 << 16) + 0.5) / (1 << 16))).astype(np.float32)  # exponential variates by 16-bit hashes; two of them sum to a gamma(2, 1) variate
_GRID = np.linspace(0, 20, 1 << 18)
_GAMMA = np.interp((np.arange(1 << 16) + 0.5) / (1 << 16), 1 - (1 + _GRID) * np.exp(-_GRID), _GRID).astype(np.float32)  # gamma(2, 1) quantiles


class Terms(dict):
    """Words of the texts that are sampled together, numbered as they come."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n

    def weights(self, text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the distinct words and how often each stands in ``text``."""
        n = Counter((text or b"").split())
        return np.fromiter(map(self.__getitem__, n), np.int64, len(n)), np.fromiter(n.values(), np.int64, len(n))


def variates(terms: np.ndarray, samples: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``r, beta, ln c`` of each term (row) and sample (column), from the four parts of one 64-bit hash."""
    with np.errstate(over="ignore"):
        seeds = C.mix(np.arange(samples, dtype=np.uint64), 11)
        x = C.mix(terms[:, None] ^ seeds, 12).view(np.uint16).reshape(len(terms), samples, 4)
    part = lambda k: np.ascontiguousarray(x[..., k])
    beta = part(0).astype(np.float32)
    beta *= np.float32(1 / 65536)
    c = _LOG.take(part(1))
    c += _LOG.take(part(2))
    return _GAMMA.take(part(3)), beta, np.log(c, out=c)


def signatures(texts: list[bytes | None], samples: int = SAMPLES) -> list[bytes]:
    """The fingerprint of each text; variates of a word are made once for all of them."""
    known = Terms()
    counted = [known.weights(t) for t in texts]
    if not known:
        return [b""] * len(texts)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, known), np.uint64, len(known))
    order = np.argsort(hashes)  # by hash, so that ties don't depend on the texts around
    terms, rank = hashes[order], np.argsort(order)
    places = []
    for k, (i, n) in enumerate(counted):
        place = rank[i]
        own = np.argsort(place)
        places.append((place[own], n[own]))
    least = np.full((len(texts), samples), np.inf, np.float32)
    taken, step = np.zeros((len(texts), samples), np.int64), np.zeros((len(texts), samples), np.float32)
    every = np.arange(samples)
    for at in range(0, len(terms), CHUNK):
        r, beta, lnc = variates(terms[at : at + CHUNK], samples)
        once = lnc + r * beta - r  # a weight of 1 has t = 0
        for k, (place, n) in enumerate(places):
            lo, hi = np.searchsorted(place, (at, at + CHUNK))
            if lo == hi:
                continue
            rows, w = place[lo:hi] - at, n[lo:hi]
            more = w > 1
            one, many = rows[~more], rows[more]
            if len(one):
                a = once.take(one, 0)
                best = a.argmin(0)
                _keep(least[k], taken[k], step[k], a[best, every], at + one[best], 0)
            if len(many):
                x = r.take(many, 0)
                t = np.log(w[more]).astype(np.float32)[:, None] / x
                t += beta.take(many, 0)
                np.floor(t, out=t)
                a = once.take(many, 0)
                a -= x * t
                best = a.argmin(0)
                _keep(least[k], taken[k], step[k], a[best, every], at + many[best], t[best, every])
    name = C.mix(terms[taken] ^ C.mix(step.astype(np.uint64), 14), 15)
    short = (name >> np.uint64(48)).astype(">u2")
    return [short[k].tobytes() if len(h) else b"" for k, (h, _) in enumerate(places)]


def _keep(least: np.ndarray, taken: np.ndarray, step: np.ndarray, value: np.ndarray, term: np.ndarray, t) -> None:
    """Note lesser values; equal ones of different terms go by the hash of the term, so that chunks don't matter."""
    better = (value < least) | ((value == least) & (term < taken))
    np.copyto(least, value, where=better)
    np.copyto(taken, term, where=better)
    np.copyto(step, t, where=better)


def likeness_of(a: bytes, b: bytes) -> float:
    """Share of equal samples: an estimate of the generalised Jaccard similarity."""
    if not a or not b:
        return float(a == b)
    return float((np.frombuffer(a, np.uint16) == np.frombuffer(b, np.uint16)).mean())


def likeness(a: str, b: str) -> Column:
    """``likeness_of`` for two columns of hexadecimal fingerprints, in SQL functions."""
    same = f"size(filter(sequence(0, length({a}) div 4 - 1), i -> substr({a}, 4 * i + 1, 4) = substr({b}, 4 * i + 1, 4))) / (length({a}) div 4)"
    return F.expr(f"if(length({a}) = 0 or length({a}) <> length({b}), if({a} = {b}, 1D, 0D), cast({same} as double))")


def fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """``doc_id, n_chars, fingerprint`` (hexadecimal) of every row; no shuffle."""
    C.tune(docs.sparkSession)
    schema = "doc_id long, n_chars long, fingerprint string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            at = 0
            while at < len(texts):
                first, size = at, 0
                while at < len(texts) and size < GROUP_BYTES:
                    size += len(texts[at] or b"")
                    at += 1
                signs = [s.hex() for s in signatures(texts[first:at], samples)]
                chars = [len(t.decode("utf-8", "replace")) if t else 0 for t in texts[first:at]]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, at - first), pa.array(chars, pa.int64()), pa.array(signs, pa.string())], ["doc_id", "n_chars", "fingerprint"])

    return C.text_bytes(docs, C.doc_id_col()).mapInArrow(run, schema)


def edited(text: str, following: str) -> str:
    """``text`` whose last third (rounded down) is replaced by as many first characters of ``following``, or all."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


PAIR = "doc_id long, n_chars long, edited_sha256 string, mark binary, edited_mark binary, near_edited double, near_next double, part int, edge int, text binary"
_COLUMNS = [c.split()[0] for c in PAIR.split(", ")]
INSIDE, FIRST, LAST = 0, 1, 2


def _judged(rows: list[tuple], samples: int) -> list[tuple]:
    """Results of consecutive ``(doc_id, text)`` but the last, which only follows."""
    plain = [(t or b"").decode("utf-8", "replace") for _, t in rows]
    changed = [edited(a, b).encode() for a, b in zip(plain, plain[1:])]
    signs = signatures([t for _, t in rows] + changed, samples)
    marks, new = signs[: len(rows)], signs[len(rows) :]
    return [(rows[i][0], len(plain[i]), hashlib.sha256(changed[i]).hexdigest(), marks[i], new[i], likeness_of(marks[i], new[i]), likeness_of(marks[i], marks[i + 1])) for i in range(len(changed))]


def _batch(rows: list[tuple], part: int, edge: int) -> pa.RecordBatch:
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("mark", pa.binary()), ("edited_mark", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("part", pa.int32()), ("edge", pa.int32()), ("text", pa.binary())])
    full = [r + (part, edge, None) if edge == INSIDE else (r[0], None, None, None, None, None, None, part, edge, r[1]) for r in rows]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*full), schema)], schema=schema)


def _along(samples: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, first, part = [], 0, None, TaskContext.get().partitionId()
        for b in batches:
            for row in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if first is None:
                    first = row
                    yield _batch([row], part, FIRST)
                held.append(row)
                size += len(row[1] or b"")
                if len(held) > 1 and size >= GROUP_BYTES:
                    yield _batch(_judged(held, samples), part, INSIDE)
                    held, size = held[-1:], len(row[1] or b"")
        if len(held) > 1:
            yield _batch(_judged(held, samples), part, INSIDE)
        if held:
            yield _batch(held[-1:], part, LAST)

    return run


def with_following(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Every row against its edited text and against the next row in descending order of doc_id.

    The texts are sorted by range once.  A partition keeps the rows whose follower it holds itself;
    the last row of each meets the first of the next one that has rows by a join on its number.
    """
    spark = docs.sparkSession
    C.tune(spark)
    rows = C.text_bytes(docs, C.doc_id_col()).withColumn("h", F.xxhash64("text"))
    order = [F.desc_nulls_last("doc_id"), F.asc("h"), F.asc_nulls_first("text")]
    dealt = rows.repartitionByRange(C.partitions(spark), *order[:2]).sortWithinPartitions(*order).select("doc_id", "text")
    done = C.cut(dealt.mapInArrow(_along(samples), PAIR))
    parts = sorted(r.part for r in done.where(F.col("edge") == FIRST).select("part").collect())  # one number for each partition
    ring = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, following int")
    starts = done.where(F.col("edge") == FIRST).select(F.col("part").alias("following"), F.col("text").alias("next_text"))
    ends = done.where(F.col("edge") == LAST).select("doc_id", "text", "part").join(ring, "part").join(starts, "following").select("doc_id", "text", "next_text")

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, t, n in zip(*(b.column(k).to_pylist() for k in range(3))):
                yield _batch(_judged([(d, t), (None, n)], samples), 0, INSIDE)

    joined = done.where(F.col("edge") == INSIDE).unionByName(ends.mapInArrow(across, PAIR))
    return joined.select("doc_id", "n_chars", "edited_sha256", F.lower(F.hex("mark")).alias("fingerprint"), F.lower(F.hex("edited_mark")).alias("edited_fingerprint"), "near_edited", "near_next")


def op11_weighted_fingerprint(spark, sf_dir: str) -> DataFrame:
    return with_following(spark.read.parquet(f"{sf_dir}/documents.parquet"))
