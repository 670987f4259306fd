"""N-gram Jaccard join by universe-partition pigeonhole.

A document's set holds its distinct 5-word shingles; two sets of sizes a and b reach the
similarity 0.75 exactly when they differ in at most ``(a + b) / 7`` tokens.  The token universe
is hashed into segments, their number fixed by size band: if two sets differ in at most d tokens,
at most d segments differ.

*Bands.*  Bounds grow by 4/3, so partners lie in the same or in adjacent bands.  A plan belongs
to the band of the larger set; a set takes part in its own band's plan and in the next one.

*Allocation by cost.*  With m segments, a set of n tokens whose partners differ in at most
``d(n)`` tokens has at least m - d(n) segments in common with any of them.  It therefore needs
to index only its d(n) + 1 cheapest ones and may leave out the rest.  A segment costs less the
more unpopular tokens it holds (one of popular tokens alone matches wherever a common passage
stands), ties by hash.  Which tokens are popular steers costs only.  As equal segments cost the
same in both sets, whatever the costs, the stricter of two partners finds a common segment that
the other has kept as well, so nothing is lost.  Bands with d <= 3 use one-deletion neighbourhoods
instead: ceil((d + 1) / 2) segments, each with itself and itself less one token, of which one
differs in at most one token.

*Rounds.*  Buckets (packed exchange, see ``common``) give candidates; each is verified exactly, and
every round skips pairs whose ends are linked already:

1. the pairs of every bucket with its least set: most groups of copies are whole after these;
2. the other pairs of buckets of up to ``SMALL_BUCKET`` sets whose ends are still apart;
3. sets of larger (hot) buckets, if any of their pairs of round 1 is no link, are indexed once
   more, by their rarest tokens: sets of sizes n and m that are linked share ``3 (n + m) / 7``
   tokens, so they share one of the ``n - 3 (n + m) / 7 + 1`` rarest of the one and of the like
   number of the other (``prefixes``), whatever order stands for rarity (tokens that are popular
   among these sets, counted exactly, come last).  Sizes go by narrow classes, so that this is a
   seventh of a set for partners of its size: pages of one template, each with more than a
   seventh of its own, never meet, nor do sets that merely share a passage;
4. what is hot even then is compared in blocks of bounded size, only across components and
   never inside the largest component of a group.

A sender folds a signature that it meets more than ``FOLD`` times to one member and pairs with it,
so no task receives a hot signature whole.  A 128-cell count sketch bounds the difference from
below and drops hopeless pairs without loss.

Equal sets are one node whatever their number of copies, so exact copies cost one row each.
Tokens are 64-bit hashes of shingles and node ids 128-bit hashes of sets.

Edge cases: no words or null text: empty set, linked with nothing, component its own doc_id;
fewer than five words: the whole sequence is one shingle; a null doc_id never is the least one;
repeated doc_ids are separate rows, linked only by their texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

SHINGLE = 5
NUM, DEN = 1, 7  # at most (a + b) * NUM / DEN tokens may differ (similarity 0.75)
SMALL_BUCKET = 32  # larger buckets are hot
FOLD = 64  # equal signatures that a sender passes on unfolded
BLOCK_TOKENS = 1_500_000  # tokens in one block of the last round
CELLS = 128
SAMPLE_DOCS = 20_000  # documents whose tokens are counted to find popular ones at first
POPULAR_DOCS = 4  # a token in so many sampled sets is popular
SIDE, LOW_BITS = np.uint64(3), np.uint64(7)  # a signature's three lowest bits are flags: folded by its sender, side of a prefix


@lru_cache(maxsize=None)
def band_bounds(limit: int = 1 << 40) -> np.ndarray:
    out = [1]
    while out[-1] < limit:
        out.append(out[-1] * 4 // 3 + 1)
    return np.array(out)


def band(n: int) -> int:
    return int(np.searchsorted(band_bounds(), n, side="right")) - 1


@lru_cache(maxsize=None)
def plan(b: int) -> tuple[str, int, int]:
    """Kind, number of segments and greatest difference for pairs whose larger set is in band ``b``."""
    top = int(band_bounds()[b + 1]) - 1
    d = 2 * top * NUM // DEN
    if d <= 3:
        return "delete", (d + 2) // 2, d
    return "whole", int(1.6 * (d + 1)) + 1, d


def signatures(tokens: np.ndarray, rare: np.ndarray) -> np.ndarray:
    """Signatures of one set (sorted distinct token hashes) under its band's plan and the next one's.

    ``rare``: which tokens are not popular.
    """
    n, out = len(tokens), []
    own = band(n)
    m = C.mix(tokens, 21)
    for b in (own, own + 1):
        lo, hi = int(band_bounds()[b]), int(band_bounds()[b + 1]) - 1
        if b > own and 4 * n < 3 * lo:
            continue
        kind, segs, _ = plan(b)
        at = ((tokens >> np.uint64(20)) % np.uint64(segs)).astype(np.int64)
        acc = np.zeros(segs, np.uint64)
        with np.errstate(over="ignore"):
            np.add.at(acc, at, m)
            slot = C.mix(np.arange(segs, dtype=np.uint64) + np.uint64(b << 32), 22)
            full = C.mix(acc + slot, 23)
            if kind == "delete":
                out += [full, C.mix(acc[at] - m + slot[at], 23)]
            else:
                keep = (n + min(4 * n // 3, hi)) * NUM // DEN + 1
                count = np.minimum(np.bincount(at[rare], minlength=segs), 15).astype(np.uint64)
                cost = (count << np.uint64(60)) | (full >> np.uint64(4))
                out.append(full[np.argpartition(cost, segs - keep)[segs - keep :]] if keep < segs else full)
    return np.concatenate(out)


@lru_cache(maxsize=1)
def size_classes() -> np.ndarray:
    """Least size of each class of sizes: bounds grow by a twentieth, by one at least."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, out[-1] * 21 // 20))
    return np.array(out)


def prefixes(tokens: np.ndarray, rare: np.ndarray) -> np.ndarray:
    """The rarest tokens of one set for partners of each class of sizes, hashed with both classes.

    Any order of tokens that is the same for all sets will do: popular ones come last, ties by hash.
    ``SIDE`` tells whether the set is of the lesser (1) or greater (2) class, or both are one (0).
    """
    n, low = len(tokens), size_classes()
    order = tokens[np.lexsort((tokens, ~rare))]
    least, most = -(-3 * n // 4), 4 * n // 3
    own, first, last = (int(np.searchsorted(low, x, side="right")) - 1 for x in (n, least, most))
    out = []
    for c in range(first, last + 1):
        shared = -(-3 * (n + max(least, int(low[c]))) // 7)
        name = np.array([(min(own, c) << 32) + max(own, c)], np.uint64)
        side = np.uint64(0 if c == own else 2 if c < own else 4)  # bits 1 and 2
        out.append(C.mix(order[: n - shared + 1] ^ C.mix(name, 24), 25) & ~LOW_BITS | side)
    return np.concatenate(out)


def shingle_sets(texts: list[bytes | None]) -> list[np.ndarray]:
    """Sorted distinct token hashes of each text."""
    h, at = C.hash_words(texts, lower=True)
    g, out = C.window_hashes(h, SHINGLE), []
    for i, t in enumerate(texts):
        a, b = int(at[i]), int(at[i + 1])
        if b - a >= SHINGLE:
            out.append(C.distinct(g[a : b - SHINGLE + 1]))
        elif b > a:
            out.append(np.array([xxhash.xxh64_intdigest(b"\0" + b" ".join(t.split()).lower())], np.uint64))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def node_id(tokens: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        return int(C.mix(tokens, 31).sum(dtype=np.uint64)), int(C.mix(tokens, 32).sum(dtype=np.uint64))


def sketch(tokens: np.ndarray) -> bytes:
    return np.minimum(np.bincount((tokens >> np.uint64(12)).astype(np.int64) % CELLS, minlength=CELLS), 255).astype(np.uint8).tobytes()


def _hex(hi: np.ndarray, lo: np.ndarray) -> list[str]:
    return [f"{a:016x}{b:016x}" for a, b in zip(hi.tolist(), lo.tolist())]


def _popular(sets: DataFrame, n: int, least: int):
    """A broadcast filter of the tokens of ``least`` or more different sets among the texts of ``sets``."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = C.Packer(n, ["u8", "u8"])
        for b in batches:
            for s in shingle_sets(b.column(0).to_pylist()):
                if len(s):
                    out.add(s, s, np.full(len(s), node_id(s)[1], np.uint64))
            if out.full():
                yield from out.flush()
        yield from out.flush()

    def often(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        t, who = C.unpack(blobs, ["u8", "u8"])
        order = np.lexsort((who, t))
        t, who = t[order], who[order]
        if len(t):
            new = np.r_[True, (t[1:] != t[:-1]) | (who[1:] != who[:-1])]
            t = t[new]
            first = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
            t = t[first][np.diff(np.r_[first, len(t)]) >= least]
            if len(t):
                yield pa.RecordBatch.from_arrays([pa.array([len(t)], pa.int64()), pa.array([t.tobytes()], pa.binary())], ["n", "payload"])

    got = C.cut(C.exchange(sets.select("text").mapInArrow(send, C.Packer.schema), n, often, "n long, payload binary"))
    return C.bloom_build(got, got.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])


PAIRS = "a string, b string, star boolean, hot boolean"
HOT_BIT = np.uint64(1)  # the lowest bit of a signature: its sender has folded it


def _shared_prefixes(sets: DataFrame, n: int, popular):
    """A broadcast filter of the prefix keys that sets of both classes hold, or two sets where that is one class.

    Senders fold a key to the sides and the least and greatest set that they met, so a token of a
    whole template costs a row a sender.
    """
    types = ["u8", "u1", "u8", "u8"]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, part, size = C.Packer(n, types), [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal size
            if part:
                out.add(*(lambda k, *x: (k, k, *x))(*fold(*(np.concatenate(c) for c in zip(*part)))))
                part.clear()
                size = 0
                yield from out.flush()

        for b in batches:
            sets_ = shingle_sets(b.column(0).to_pylist())
            rare = ~C.bloom_probe(np.concatenate([*sets_, np.empty(0, np.uint64)]), popular.value)
            at = C.offsets([len(s) for s in sets_])
            for i, s in enumerate(sets_):
                if len(s):
                    sig, lo = prefixes(s, rare[at[i] : at[i + 1]]), node_id(s)[1]
                    who = np.full(len(sig), lo, np.uint64)
                    part.append((sig >> SIDE, (np.uint64(1) << ((sig >> HOT_BIT) & np.uint64(3))).astype(np.uint8), who, who))
                    size += len(sig) * 25
                if size >= C.PACK_BYTES:
                    yield from flush()
        yield from flush()

    def fold(key: np.ndarray, sides: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        return key[first], np.bitwise_or.reduceat(sides[order], first), np.minimum.reduceat(low[order], first), np.maximum.reduceat(high[order], first)

    def both(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        cols = C.unpack(blobs, types)
        if len(cols[0]):
            key, sides, low, high = fold(*cols)
            key = C.mix(key[(sides == 6) | ((sides == 1) & (low != high))], 26)
            if len(key):
                yield pa.RecordBatch.from_arrays([pa.array([len(key)], pa.int64()), pa.array([key.tobytes()], pa.binary())], ["n", "payload"])

    got = C.cut(C.exchange(sets.select("text").mapInArrow(send, C.Packer.schema), n, both, "n long, payload binary"))
    return C.bloom_build(got, got.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])


def _candidates(sets: DataFrame, n: int, popular, rarest: bool = False) -> DataFrame:
    """``(a, b, star, hot)``: pairs of node ids that share a signature.

    ``sets`` has texts and, from the second indexing on, the component (``root``) of each; a bucket
    of one component gives nothing then.  ``star``: the pair of a bucket's least set with another;
    hot buckets give no other pairs.
    """
    rooted = "root" in sets.columns
    types, star_types = ["u8"] * (4 if rooted else 3), ["u8"] * 4
    met = _shared_prefixes(sets, n, popular) if rarest else None

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, stars, part, size = C.Packer(n, types), C.Packer(n, star_types, 1), [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal size
            if part:
                cols = [np.concatenate(c) for c in zip(*part)]
                part.clear()
                size = 0
                order = np.argsort(cols[0], kind="stable")
                s = cols[0][order]
                first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
                count = np.diff(np.r_[first, len(s)])
                over = np.flatnonzero(count > FOLD)
                if len(over):
                    head, away = np.repeat(order[first[over]], count[over] - 1), order[C.ragged(first[over] + 1, count[over] - 1)]
                    code = np.unique(np.stack([cols[1][head], cols[2][head], cols[1][away], cols[2][away]], 1), axis=0)
                    stars.add(code[:, 3], *code.T)
                    cols[0][head] |= HOT_BIT
                    stay = np.ones(len(s), bool)
                    stay[away] = False
                    cols = [c[stay] for c in cols]  # in the order of sets, whose ids then compress
                out.add(cols[0] >> SIDE, *cols)
                yield from out.flush()
                yield from stars.flush()

        for b in batches:
            seen = set()
            roots = [int(r[16:], 16) for r in b.column(1).to_pylist()] if rooted else None
            sets_ = shingle_sets(b.column(0).to_pylist())
            rare = ~C.bloom_probe(np.concatenate([*sets_, np.empty(0, np.uint64)]), popular.value)
            at = C.offsets([len(s) for s in sets_])
            for i, s in enumerate(sets_):
                if len(s):
                    hi, lo = node_id(s)
                    if (hi, lo) not in seen:
                        seen.add((hi, lo))
                        if rarest:
                            sig = prefixes(s, rare[at[i] : at[i + 1]])
                            sig = sig[C.bloom_probe(C.mix(sig >> SIDE, 26), met.value)]
                        else:
                            sig = signatures(s, rare[at[i] : at[i + 1]]) & ~LOW_BITS
                        part.append([sig, *(np.full(len(sig), x, np.uint64) for x in ((hi, lo, roots[i]) if rooted else (hi, lo)))])
                        size += len(sig) * 8 * len(types)
                if size >= C.PACK_BYTES:
                    yield from flush()
        yield from flush()

    def named(pairs: np.ndarray, star: np.ndarray, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Rows of id pairs (four columns), the least id first."""
        swap = (pairs[:, 0] > pairs[:, 2]) | ((pairs[:, 0] == pairs[:, 2]) & (pairs[:, 1] > pairs[:, 3]))
        pairs[swap] = pairs[swap][:, [2, 3, 0, 1]]
        for i in range(0, len(pairs), 50_000):
            x = slice(i, i + 50_000)
            yield pa.RecordBatch.from_arrays([pa.array(_hex(pairs[x, 0], pairs[x, 1]), pa.string()), pa.array(_hex(pairs[x, 2], pairs[x, 3]), pa.string()), pa.array(star[x]), pa.array(hot[x])], ["a", "b", "star", "hot"])

    def pair(blobs: list[bytes], kind: int) -> Iterator[pa.RecordBatch]:
        if kind:
            pairs = np.unique(np.stack(C.unpack(blobs, star_types), 1), axis=0)
            yield from named(pairs, np.ones(len(pairs), bool), np.ones(len(pairs), bool))
            return
        cols = C.unpack(blobs, types)
        order = np.argsort(cols[0] >> SIDE, kind="stable")
        sig = cols[0][order] >> SIDE
        twin = np.zeros(len(sig), bool)  # only rows whose signature repeats go on
        same = sig[1:] == sig[:-1]
        twin[1:] |= same
        twin[:-1] |= same
        order, sig = order[twin], sig[twin]
        flag, hi, lo = cols[0][order] & HOT_BIT == HOT_BIT, cols[1][order], cols[2][order]
        side = (cols[0][order] & LOW_BITS) >> HOT_BIT
        root = cols[3][order] if rooted else None
        del cols
        order = np.lexsort((~flag, lo, hi, sig))  # of equal rows the flagged one comes first
        sig, hi, lo, flag, side = sig[order], hi[order], lo[order], flag[order], side[order]
        root = root[order] if rooted else lo
        if len(sig):
            new = np.r_[True, (sig[1:] != sig[:-1]) | (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])]
            sig, hi, lo, flag, root, side = (x[new] for x in (sig, hi, lo, flag, root, side))
            first = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
            count = np.diff(np.r_[first, len(sig)])
            apart = np.minimum.reduceat(root, first) != np.maximum.reduceat(root, first)
            hot = np.maximum.reduceat(flag, first) | (count > SMALL_BUCKET)
            keep = np.repeat((count > 1) & (apart | (hot & np.maximum.reduceat(flag, first))), count)
            sig, hi, lo, root, side, hot = sig[keep], hi[keep], lo[keep], root[keep], side[keep], np.repeat(hot, count)[keep]
        if len(sig) < 2:
            return
        order = np.lexsort((lo, hi))
        new = np.r_[True, (hi[order][1:] != hi[order][:-1]) | (lo[order][1:] != lo[order][:-1])]
        ids, node = np.stack([hi, lo], 1)[order[new]], np.empty(len(order), np.int64)
        node[order] = np.cumsum(new) - 1
        first = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
        count = np.diff(np.r_[first, len(sig)])
        k, head = np.int64(len(ids)), np.repeat(node[first], count)
        del hi, lo, order
        big = np.unique((head * k + node)[hot & (head != node)])
        star = np.unique((head * k + node)[~hot & (head != node) & (np.repeat(root[first], count) != root) & ((side == 0) | (np.repeat(side[first], count) != side))])
        codes = [np.empty(0, np.int64)]
        for d in range(1, SMALL_BUCKET):  # node ids rise inside a bucket
            i = np.flatnonzero(~hot[:-d] & (sig[:-d] == sig[d:]))
            if not len(i):
                break
            i = i[(root[i] != root[i + d]) & ((side[i] == 0) | (side[i] != side[i + d]))]
            codes.append(np.unique(node[i] * k + node[i + d]))
        code = np.unique(np.concatenate(codes))
        code = np.setdiff1d(np.setdiff1d(code, big, assume_unique=True), star, assume_unique=True)
        star = np.setdiff1d(star, big, assume_unique=True)
        both = np.concatenate([big, star, code])
        yield from named(np.concatenate([ids[both // k], ids[both % k]], 1), np.arange(len(both)) < len(big) + len(star), np.arange(len(both)) < len(big))

    found = C.exchange(sets.select("text", *["root"] * rooted).mapInArrow(send, C.Packer.schema), n, pair, PAIRS, kinds=2)
    return C.cut(found.groupBy("a", "b").agg(F.max("star").alias("star"), F.max("hot").alias("hot")))


def _documents(docs: DataFrame, bits) -> DataFrame:
    """``(doc_id, n, id, sketch, text, uid)``; sketch and text only where a task first meets a set that the filter lets pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for b in batches:
            size, name, sk, tx = [], [], [], []
            if len(seen) > C.MEMO_LIMIT // 4:
                seen.clear()
            texts = b.column(1).to_pylist()
            sets = shingle_sets(texts)
            ids = [node_id(s) for s in sets]
            hit = C.bloom_probe(np.array([i[1] for i in ids], np.uint64), bits.value) if ids else []
            for t, s, (hi, lo), h in zip(texts, sets, ids, hit):
                size.append(len(s))
                name.append(f"{hi:016x}{lo:016x}" if len(s) else None)
                h = bool(h) and len(s) > 0 and lo not in seen
                if h:
                    seen.add(lo)
                sk.append(sketch(s) if h else None)
                tx.append(t if h else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(name, pa.string()), pa.array(sk, pa.binary()), pa.array(tx, pa.binary())], ["doc_id", "n", "id", "sketch", "text"])

    found = C.text_bytes(docs, C.doc_id_col()).mapInArrow(run, "doc_id long, n long, id string, sketch binary, text binary")
    return C.cut(found.withColumn("uid", F.monotonically_increasing_id()))


def _close(pairs: DataFrame, sets: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """Pairs ``(ua, ub)``, as rows that hold their texts, whose sizes and sketches do not rule a link out
    and whose ends have different ``roots``."""
    cols = sets.select("id", "uid", "n", "sketch")
    if roots is not None:
        cols = cols.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    for side in "ab":
        pairs = pairs.join(cols.select(F.col("id").alias(side), *[F.col(c).alias(c + side) for c in cols.columns[1:]]), side)
    pairs = pairs.where("4 * least(na, nb) >= 3 * greatest(na, nb)")
    if roots is not None:
        pairs = pairs.where("roota <> rootb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8).reshape(-1, CELLS).astype(np.int16) for i in (4, 5))
                n = b.column(2).to_numpy(zero_copy_only=False) + b.column(3).to_numpy(zero_copy_only=False)
                yield b.filter(pa.array(DEN * np.abs(x - y).sum(1, dtype=np.int64) <= NUM * n)).select(["ua", "ub"])

    return pairs.select(F.col("uida").alias("ua"), F.col("uidb").alias("ub"), "na", "nb", "sketcha", "sketchb").mapInArrow(run, "ua long, ub long")


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets are linked."""
    if len(a) > len(b):
        a, b = b, a
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return DEN * int((b[at] == a).sum()) >= (DEN - 1) // 2 * (len(a) + len(b))


def _linked(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """Exact links ``(a, b)`` among the pairs ``(ua, ub)``.

    Two plain joins fetch the texts, so that Spark may split the rows of a set with many partners;
    pairs come sorted by ``ua`` and its set is built once.
    """
    texts = table.where("text is not null").select("uid", "text")
    for side in "ba":
        pairs = pairs.join(texts.select(F.col("uid").alias("u" + side), F.col("text").alias("t" + side)), "u" + side)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, mine = None, None
        for b in batches:
            out: list[list[str]] = [[], []]
            ua, ta = b.column(0).to_pylist(), b.column(2)
            for i, theirs in enumerate(shingle_sets(b.column(3).to_pylist())):
                if ua[i] != last:
                    last, mine = ua[i], shingle_sets([ta[i].as_py()])[0]
                if alike(mine, theirs):
                    for o, s in zip(out, (mine, theirs)):
                        o.append("%016x%016x" % node_id(s))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in out], ["a", "b"])

    return C.cut(pairs.select("ua", "ub", "ta", "tb").mapInArrow(run, "a string, b string"))


def _merged(*links: DataFrame) -> DataFrame:
    """``(id, root)`` of the components of all ``links``, which may be earlier components."""
    edges = None
    for x in links:
        x = x.toDF("a", "b")
        edges = x if edges is None else edges.unionByName(x)
    return C.cut(C.components(edges))


def links_in_block(ids: list[str], part: np.ndarray, root: np.ndarray, tokens: list[np.ndarray], sk: np.ndarray) -> list[tuple[str, str]]:
    """A forest of the links among the sets of a block that have different roots; pairs inside one part are skipped where there are two."""
    size = np.array([len(t) for t in tokens])
    root, two, out = np.unique(root, return_inverse=True)[1], len(np.unique(part)) > 1, []
    sk, rest = sk.astype(np.int16), np.arange(len(ids))
    for i in range(len(ids) - 1):
        if i % 64 == 0 and (root[i:] == root[i]).all():
            break
        j = rest[i + 1 :]
        ok = (root[j] != root[i]) & (4 * np.minimum(size[j], size[i]) >= 3 * np.maximum(size[j], size[i]))
        if two:
            ok &= part[j] != part[i]
        j = j[ok]
        if len(j):
            j = j[DEN * np.abs(sk[j] - sk[i]).sum(1, dtype=np.int64) <= NUM * (size[j] + size[i])]
        for k in j:
            if root[k] != root[i] and alike(tokens[i], tokens[k]):
                out.append((ids[i], ids[int(k)]))
                root[root == root[k]] = root[i]
    return out


def _blocks(sets: DataFrame, groups: DataFrame, roots: DataFrame, table: DataFrame) -> DataFrame:
    """Exact links (a forest) across the components of each candidate group, in blocks of bounded size.

    The largest component of a group is never compared with itself.  Only ids are dealt to blocks;
    the texts of sets follow once for each of their tasks.
    """
    spark = sets.sparkSession
    bounds = ",".join(f"{x}L" for x in band_bounds(1 << 32))
    s = sets.select("id", "uid", "n").join(groups.select("id", F.col("root").alias("k")), "id").join(roots, "id", "left")
    s = C.cut(s.select("k", "id", "uid", "n", F.coalesce("root", "id").alias("root"), F.expr(f"size(filter(array({bounds}), x -> x <= n))").alias("band")))
    by_root = s.groupBy("k", "root").agg(F.sum("n").alias("t"))
    whole = by_root.groupBy("k").agg(F.count("*").alias("roots"), F.sum("t").alias("kt"), F.max(F.struct("t", "root")).alias("m")).where("roots > 1").select("k", "kt", F.col("m.root").alias("main"))
    s = s.join(whole, "k").withColumn("large", (F.col("root") == F.col("main")).cast("int"))
    one = s.where(f"kt <= {BLOCK_TOKENS}").select("k", F.lit("").alias("task"), F.col("large").cast("string").alias("part"), "root", "uid")
    many = C.cut(s.where(f"kt > {BLOCK_TOKENS}").select("k", "id", "uid", "n", "root", "band", "large"))
    cells = many.groupBy("k", "band", "large").agg(F.ceil(F.sum("n") / BLOCK_TOKENS).cast("int").alias("nb"))
    mine = many.join(cells, ["k", "band", "large"])
    mine = mine.withColumn("part", F.expr("concat_ws(':', band, large, pmod(xxhash64(id), nb))")).withColumn("near", F.explode(F.expr("array(band - 1, band, band + 1)")))
    other = cells.select("k", F.col("band").alias("near"), F.col("large").alias("large2"), F.col("nb").alias("nb2"))
    mine = mine.join(other, ["k", "near"]).where("large + large2 < 2").withColumn("j", F.explode(F.expr("sequence(0, nb2 - 1)")))
    mine = mine.withColumn("theirs", F.expr("concat_ws(':', near, large2, j)"))
    deal = C.cut(one.unionByName(mine.select("k", F.expr("concat_ws('|', least(part, theirs), greatest(part, theirs))").alias("task"), "part", "root", "uid")))
    dealt = table.where("text is not null").select("uid", "sketch", "text").join(deal, "uid").select("k", "task", "part", "root", "sketch", "text")
    dealt = dealt.repartition(C.partitions(spark), "k", "task").sortWithinPartitions("k", "task", "part")  # the largest component comes last

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, []

        def done():
            if len(group) > 1:
                part, root, sk, tokens = zip(*group)
                ids = ["%016x%016x" % node_id(t) for t in tokens]
                e = links_in_block(ids, np.unique(part, return_inverse=True)[1] if key[1] else np.zeros(len(ids)), np.array(root), list(tokens), np.frombuffer(b"".join(sk), np.uint8).reshape(-1, CELLS))
                if e:
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in e], pa.string()), pa.array([x[1] for x in e], pa.string())], ["a", "b"])

        for b in batches:
            tokens = shingle_sets(b.column(5).to_pylist())
            for k, task, part, root, sk, t in zip(*(c.to_pylist() for c in b.columns[:5]), tokens):
                if (k, task) != key:
                    yield from done()
                    key, group = (k, task), []
                group.append((part, root, sk, t))
        yield from done()

    return C.cut(dealt.mapInArrow(run, "a string, b string"))


def _index_again(hot: DataFrame, sets: DataFrame, roots: DataFrame, table: DataFrame, n: int) -> DataFrame:
    """Components after hot buckets have been indexed anew by rarest tokens."""
    nodes = hot.select(F.col("a").alias("id")).unionByName(hot.select(F.col("b").alias("id"))).distinct()
    who = sets.select("id", "uid").join(nodes, "id", "left_semi").join(roots, "id", "left").select("uid", F.coalesce("root", "id").alias("root"))
    again = C.cut(table.where("text is not null").select("uid", "text").join(who, "uid").select("text", "root"))
    pairs = _candidates(again, n, _popular(again, n, SMALL_BUCKET + 1), rarest=True)
    links = _linked(_close(pairs.where("not hot"), sets, roots), table)
    if links.limit(1).count():
        roots = _merged(roots, links)
    still = pairs.where("hot").select("a", "b")
    if still.limit(1).count():
        roots = _merged(roots, _blocks(sets, C.components(still), roots, table))
    return roots


def similarity_components(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, set_id, group_id, component_id``.

    ``group_id`` is the least set id of the component (null for empty sets).
    """
    spark = docs.sparkSession
    C.tune(spark)
    n = 2 * C.partitions(spark)  # the payload of signatures is the largest of all exchanges
    pairs = _candidates(C.text_bytes(docs), n, _popular(C.text_bytes(C.sampled(docs, SAMPLE_DOCS)), n, POPULAR_DOCS))
    nodes = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = np.array([int(x[16:], 16) for x in b.column(0).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array([len(h)], pa.int64()), pa.array([h.tobytes()], pa.binary())], ["n", "payload"])

    packed = C.cut(nodes.distinct().mapInArrow(pack, "n long, payload binary"))
    count = packed.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    table = _documents(docs, C.bloom_build(packed, count))
    sets = C.cut(table.where("text is not null").groupBy("id").agg(F.min("uid").alias("uid"), F.first("n").alias("n"), F.first("sketch").alias("sketch")))
    roots = _merged(_linked(_close(pairs.where("star"), sets), table))
    rest = _linked(_close(pairs.where("not star"), sets, roots), table)
    if rest.limit(1).count():
        roots = _merged(roots, rest)
    hot = pairs.where("hot").select("a", "b")
    ends = hot
    for side in "ab":
        ends = ends.join(roots.select(F.col("id").alias(side), F.col("root").alias("r" + side)), side, "left")
    if ends.where("coalesce(ra, a) <> coalesce(rb, b)").limit(1).count():
        roots = _index_again(hot, sets, roots, table, C.partitions(spark))
    slim = table.select("doc_id", "n", "id")
    least = C.cut(slim.where("id is not null").groupBy("id").agg(F.min("doc_id").alias("m")).join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")))
    first = C.cut(least.groupBy("root").agg(F.min("m").alias("component_id")))  # written, so that Spark may split a large component's rows in the join
    comp = least.join(first, "root").select("id", F.col("root").alias("group_id"), "component_id")
    out = slim.join(comp, "id", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("id").alias("set_id"), "group_id", F.when(F.col("id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_per_component(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: the least doc_id (nulls last), then the least set; empty sets all stay.

    Rows that repeat doc_id and set count as one; which of them stays is open where other columns differ.
    """
    comp = similarity_components(docs)
    own, doc, kept_set = C.fresh(docs, "set_id", "kept_doc", "kept_set")
    order = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "set_id")
    keep = C.cut(comp.where("group_id is not null").groupBy("group_id").agg(F.min(order).alias("x")).select(F.col("x.doc_id").alias(doc), F.col("x.set_id").alias(kept_set)))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = ["%016x%016x" % node_id(s) if len(s) else None for s in shingle_sets(b.column(at).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.string())], [*b.schema.names, own])

    rows = docs.withColumn("text", F.col("text").cast("binary"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    rows = rows.mapInArrow(run, f"{schema}, `{own}` string").withColumn("text", F.col("text").cast("string"))
    kept = rows.where(F.col(own).isNotNull()).join(keep, (F.col(own) == F.col(kept_set)) & F.col("doc_id").cast("long").eqNullSafe(F.col(doc)), "left_semi")
    return kept.dropDuplicates([own]).unionByName(rows.where(F.col(own).isNull())).select(*docs.columns)


def op4_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return similarity_components(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, s, s + 4), ' ') AS g
       FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS s FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r AS (SELECT doc_id AS id, doc_id AS reach FROM n UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.reach)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(m.c, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT id AS doc_id, min(reach) AS c FROM r GROUP BY id) m USING (doc_id)
"""
