"""Shared helpers: durable cuts, word hashing, packed exchanges, Bloom filters and components.

Texts travel to Python as UTF-8 bytes in Arrow batches.  ``bytes.split()`` splits at exactly
the six ASCII white-space bytes, so it yields the words ``[^\\x20\\x09-\\x0D]+``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.durable import cut, tune  # noqa: F401  operators use them from here

WS = b" \t\n\r\x0b\x0c"
MEMO_LIMIT = 300_000  # distinct words remembered by one Python worker before the memo restarts
PACK_BYTES = 12 << 20  # payload that a map task gathers before it sends packed blocks
BLOOM_MAX_BITS = 1 << 28  # 32 MB: the largest filter that is ever broadcast


# ---------------------------------------------------------------- samples


def sampled(docs: DataFrame, bound: int, total: int | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, text`` and ``more`` of about ``bound`` rows by a 64-bit hash of both, all where there are fewer; equal rows count once.

    Never empty unless ``docs`` is.
    """
    n = docs.count() if total is None else total
    rows = docs.select(doc_id_col(), "text", *more)
    if n <= bound:
        return rows
    h = F.xxhash64(F.lit("fit"), "doc_id", "text")
    some = rows.where(h < F.lit(min((1 << 63) - 1, -(1 << 63) + (bound << 64) // n))).distinct()
    return some if some.limit(1).count() else rows.orderBy(h).limit(1)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(docs: DataFrame, *cols: str | Column) -> DataFrame:
    """The named columns and ``text`` as UTF-8 bytes; other columns are never read."""
    return docs.select(*cols, F.col("text").cast("binary").alias("text"))


def within(rows: DataFrame, size: str, bound: int) -> DataFrame:
    """Of a sample's ``rows`` in the order of a hash, those up to which the column ``size`` (1 or more) sums to ``bound``."""
    cols = rows.columns
    (h, upto) = fresh(rows, "h", "upto")
    first = rows.where(F.col(size) <= bound).withColumn(h, F.xxhash64(*cols)).orderBy(h, *cols).limit(bound)
    return first.withColumn(upto, F.sum(size).over(Window.orderBy(h, *cols).rowsBetween(Window.unboundedPreceding, 0))).where(F.col(upto) <= bound).orderBy(upto).select(*cols)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that no column of ``df`` has, in whatever case."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
        taken.add(n.lower())
    return out


def doc_id_col() -> Column:
    return F.col("doc_id").cast("long").alias("doc_id")


# ---------------------------------------------------------------- words and hashes


_SPAN = 1 << 18  # bytes hashed together; a longer word extends its span
_LONG_SPAN = 1 << 22  # from here on, products are reduced before they are summed
_PRIMES = (2_147_483_647, 2_147_483_629)  # the two greatest below 2^31
_BASES = tuple(xxhash.xxh64_intdigest(f"base {k}") % (p - 2) + 2 for k, p in enumerate(_PRIMES))
_LETTERS = np.arange(1, 257, dtype=np.uint64)
_LETTERS_LOWER = _LETTERS[[i + 32 if 65 <= i <= 90 else i for i in range(256)]]
_IS_WS = np.isin(np.arange(256), list(WS))
_IS_MARK = _IS_WS | ((np.arange(256) < 128) & ~np.array([chr(i).isalnum() for i in range(256)]))  # ASCII marks as well
_powers: list[list[np.ndarray]] = []


def _power_tables(n: int) -> list[list[np.ndarray]]:
    """For each prime the powers of its base and of the base's inverse, kept at the greatest length asked for."""
    if not _powers or len(_powers[0][0]) < n:

        def table(x: int, p: int) -> np.ndarray:
            out = np.ones(1, np.uint64)
            while len(out) < n:
                out = np.r_[out, out * np.uint64(pow(x, len(out), p)) % np.uint64(p)]
            return out

        _powers[:] = [[table(b, p), table(pow(b, -1, p), p)] for b, p in zip(_BASES, _PRIMES)]
    return _powers


def _hash_span(span: bytes, lower: bool, blanks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, 62-bit hash, length, first and last byte of every word of a span.

    The hash joins polynomials in two bases modulo two primes, from prefix sums of 40-bit products.
    A prime modulus matters: modulo a power of two, words after the Thue-Morse sequence agree in any base.
    """
    x = np.frombuffer(span, np.uint8)
    blank = blanks[x]
    edge = np.flatnonzero(np.diff(np.r_[True, blank, True].astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    letters = (_LETTERS_LOWER if lower else _LETTERS)[x]
    sums, both = np.zeros(len(x) + 1, np.uint64), np.zeros(len(start), np.uint64)
    for (up, down), p in zip(_power_tables(max(len(x), _SPAN)), map(np.uint64, _PRIMES)):
        product = letters * up[: len(x)]
        if len(x) > _LONG_SPAN:
            product %= p
        np.cumsum(product, out=sums[1:])
        both = (both << np.uint64(31)) + (sums[end] - sums[start]) % p * down[start] % p
    with np.errstate(over="ignore"):
        return start, mix(both + ((end - start).astype(np.uint64) << np.uint64(40)), 5), end - start, x[start], x[end - 1]


def hash_words(texts: list[bytes | None], lower: bool = False, marks: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """As ``scan_words``, hashes and offsets only."""
    h, at, *_ = scan_words(texts, lower, marks)
    return h, at


def scan_words(texts: list[bytes | None], lower: bool = False, marks: bool = False) -> tuple[np.ndarray, ...]:
    """Hashes of all words of ``texts`` and the word offsets of each text, then their lengths in bytes and
    first and last bytes; ``lower`` folds A-Z, ``marks`` cuts words at ASCII marks too.

    Works on spans of whole words, so memory follows the span and not the text.
    """
    counts, hashes = np.zeros(len(texts), np.int64), []
    part: list[bytes] = []
    who: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if part:
            start, *cols = _hash_span(b" ".join(part), lower, _IS_MARK if marks else _IS_WS)
            at = offsets([len(t) + 1 for t in part])
            np.add.at(counts, who, np.diff(np.searchsorted(start, at)))
            hashes.append(cols)
            part.clear()
            who.clear()
            size = 0

    for i, t in enumerate(texts):
        at = 0
        while t and at < len(t):
            end = len(t)
            if end - at > 2 * _SPAN:
                end = next((k for k in range(at + _SPAN, len(t)) if _IS_WS[t[k]]), len(t))
            part.append(t[at:end] if at or end < len(t) else t)
            who.append(i)
            size += end - at
            at = end
            if size >= _SPAN:
                flush()
    flush()
    h, size_, first, last = (np.concatenate(c) for c in zip(*hashes)) if hashes else (np.empty(0, t) for t in (np.uint64, np.int64, np.uint8, np.uint8))
    return h, offsets(counts), size_, first, last


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct entries."""
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finalizer (splitmix)."""
    with np.errstate(over="ignore"):
        z = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of every ``size`` consecutive entries, by doubling: about 2 log2(size) vector steps."""
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, done, level, step = None, 0, mix(h), 1
    with np.errstate(over="ignore"):
        while step <= size:
            if size & step:
                part = level[done : done + n]
                out = part if out is None else mix(out * np.uint64(0x9FB21C651E98DF25) + part, step)
                done += step
            if step * 2 <= size:
                level = mix(level[:-step] * np.uint64(0xD6E8FEB86659FD93) + level[step:], 64 + step)
            step *= 2
    return out


def offsets(lengths: list[int] | np.ndarray) -> np.ndarray:
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenated ``arange(start, start + count)``."""
    total = int(counts.sum())
    ends = np.cumsum(counts)
    return np.arange(total) - np.repeat(ends - counts, counts) + np.repeat(starts, counts)


# ---------------------------------------------------------------- packed exchanges


class Packer:
    """Gathers fixed-width rows by target partition; each flush makes one blob for a target.

    A blob holds the columns one after another.  Millions of small rows cross the shuffle as a
    few binary values, so neither row conversion nor row headers cost anything.
    """

    schema = "pid int, payload binary"

    def __init__(self, targets: int, dtypes: list, kind: int = 0):
        self.n, self.dtypes, self.parts, self.size, self.first = targets, [np.dtype(d) for d in dtypes], [], 0, kind * targets

    def add(self, key: np.ndarray, *cols: np.ndarray) -> None:
        if len(key):
            self.parts.append([(key % np.uint64(self.n)).astype(np.int32) + np.int32(self.first), *(c.astype(d, copy=False) for c, d in zip(cols, self.dtypes))])
            self.size += len(key) * (4 + sum(d.itemsize for d in self.dtypes))

    def full(self) -> bool:
        return self.size >= PACK_BYTES

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.parts:
            return
        pid, *cols = (np.concatenate(c) for c in zip(*self.parts))
        self.parts, self.size = [], 0
        order = np.argsort(pid, kind="stable")
        pid, cols = pid[order], [c[order] for c in cols]
        cuts = np.flatnonzero(np.r_[True, pid[1:] != pid[:-1], True])
        blobs = [b"".join(c[a:b].tobytes() for c in cols) for a, b in zip(cuts[:-1], cuts[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(pid[cuts[:-1]], pa.int32()), pa.array(blobs, pa.binary())], ["pid", "payload"])


def unpack(blobs: list[bytes], dtypes: list) -> list[np.ndarray]:
    dtypes = [np.dtype(d) for d in dtypes]
    width, cols = sum(d.itemsize for d in dtypes), [[] for _ in dtypes]
    for b in blobs:
        n, at = len(b) // width, 0
        for d, c in zip(dtypes, cols):
            c.append(np.frombuffer(b, d, n, at))
            at += n * d.itemsize
    out = []
    for k, d in enumerate(dtypes):
        out.append(np.concatenate(cols[k]) if cols[k] else np.empty(0, d))
        cols[k] = []
    blobs.clear()  # the columns are copies
    return out


def exchange(packed: DataFrame, targets: int, reduce: Callable[..., Iterator[pa.RecordBatch]], schema: str, kinds: int = 1) -> DataFrame:
    """Send each blob to the partition that its ``pid`` names; ``reduce`` sees a whole partition.

    A partition's payload is the input over ``spark.sql.shuffle.partitions``, however often a key
    repeats: senders fold equal keys of a flush first.  With more than one kind of payload, kind k
    has the pids from ``k * targets`` on and ``reduce`` is told the kind.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[int, list[bytes]] = {}
        for b in batches:
            for p, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                groups.setdefault(p, []).append(x)
        while groups:
            p, blobs = groups.popitem()
            yield from reduce(blobs, p // targets) if kinds > 1 else reduce(blobs)

    return packed.repartitionById(targets * kinds, F.col("pid")).mapInArrow(run, schema)


# ---------------------------------------------------------------- Bloom filters


def bloom_bits(count: int) -> int:
    """About 16 bits for each entry, never above ``BLOOM_MAX_BITS``."""
    return min(BLOOM_MAX_BITS, max(1 << 16, 1 << int(16 * max(count, 1) - 1).bit_length()))


def bloom_probe(h: np.ndarray, bits: np.ndarray) -> np.ndarray:
    m = np.uint64(len(bits) * 8 - 1)
    hit = np.ones(len(h), bool)
    for s in (0, 21, 40):
        at = (h >> np.uint64(s)) & m if s < 40 else mix(h, 7) & m
        hit &= (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return hit


def bloom_build(hashes: DataFrame, count: int):
    """A broadcast filter over the packed hashes in column ``payload``.

    Its size is bounded by ``BLOOM_MAX_BITS`` whatever the input.  A full filter only lets more
    candidates pass; every use is followed by an exact step, so results never depend on it.
    """
    spark, nbits, seg = hashes.sparkSession, bloom_bits(count), 1 << 15

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = np.zeros(nbits >> 3, np.uint8)
        for b in batches:
            for x in b.column(0).to_pylist():
                h, m = np.frombuffer(x, np.uint64), np.uint64(nbits - 1)
                for at in (h & m, (h >> np.uint64(21)) & m, mix(h, 7) & m):
                    np.bitwise_or.at(mine, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        for i in range(0, len(mine), seg):
            part = mine[i : i + seg]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([i // seg], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["seg", "part"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, np.ndarray] = {}
        for b in batches:
            for s, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                part = np.frombuffer(x, np.uint8)
                got[s] = got[s] | part if s in got else part
        if got:
            yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.int32()), pa.array([v.tobytes() for v in got.values()], pa.binary())], ["seg", "part"])

    parts = hashes.select("payload").coalesce(partitions(spark)).mapInArrow(fill, "seg int, part binary")
    merged = parts.repartition(min(partitions(spark), max(1, (nbits >> 3) // seg)), "seg").mapInArrow(merge, "seg int, part binary")
    bits = np.zeros(nbits >> 3, np.uint8)
    for s, x in merged.collect():  # at most BLOOM_MAX_BITS / 8 bytes
        bits[s * seg : (s + 1) * seg] = np.frombuffer(bytes(x), np.uint8)
    return spark.sparkContext.broadcast(bits)


# ---------------------------------------------------------------- components


def find_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index of each component of the graph with edges (a, b) on 0..n-1."""
    lab = np.arange(n)
    while len(a):
        la, lb = lab[a], lab[b]
        lo, hi = np.minimum(la, lb), np.maximum(la, lb)
        keep = lo != hi
        if not keep.any():
            break
        a, b = a[keep], b[keep]
        np.minimum.at(lab, hi[keep], lo[keep])
        while True:
            nxt = lab[lab]
            if np.array_equal(nxt, lab):
                break
            lab = nxt
    return lab


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)``: one row ``(id, root)`` per node, root the least id.

    Each round first solves whole partitions at once (a forest of every partition's edges, by
    union-find over that partition only), then deals the forests out anew; what is left shrinks to
    stars.  Rounds end in a written table, so nothing depends on one executor.
    """
    spark = edges.sparkSession
    schema = "a string, b string"

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [x for x in batches if x.num_rows]
        if got:
            m = sum(x.num_rows for x in got)
            coded = pa.chunked_array([x.column(k) for k in (0, 1) for x in got]).combine_chunks().dictionary_encode()
            names, at = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
            order = pc.sort_indices(names).to_numpy()
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            lab = find_roots(len(names), rank[at[:m]], rank[at[m:]])
            own = np.flatnonzero(lab != np.arange(len(names)))
            yield pa.RecordBatch.from_arrays([names.take(pa.array(order[own])), names.take(pa.array(order[lab[own]]))], ["a", "b"])

    n = partitions(spark)
    e = cut(edges.select("a", "b").where("a <> b").mapInArrow(local, schema))
    for _ in range(max_rounds):
        # large star: every node points its larger neighbours at the least one that it knows;
        # the forests of the next deal then do the same for smaller neighbours
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # written, so that the join below reads plain exchanges, of which Spark can split a hub's partition
        least = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m")))
        nxt = both.join(least, both.a == least.k).where("b > a").select(F.col("b").alias("x"), F.col("m").alias("y"))
        nxt = nxt.where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()
        nxt = cut(nxt.repartition(n, "a").mapInArrow(local, schema).distinct())
        # done when every node points at one root that points nowhere
        bad = nxt.groupBy("a").agg(F.countDistinct("b").alias("c")).where("c > 1").limit(1).count() or nxt.alias("l").join(nxt.alias("r"), F.col("l.b") == F.col("r.a"), "left_semi").limit(1).count()
        e = nxt
        if not bad:
            break
    else:
        raise RuntimeError("components did not converge")
    return e.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
