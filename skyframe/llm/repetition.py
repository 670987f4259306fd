"""Quality rules: repetition inside a text by suffix arrays.

The words of a slice of documents form one sequence in which each document's words are symbols
of its own and end in a terminator, so no repeat spans documents.  Prefix doubling sorts the
suffixes; each round touches only those that still tie.  The ranks of every round give the
longest common prefix of neighbours in the suffix array.

A suffix lies in the longest-common-prefix interval of depth max(prefix with the suffix before,
prefix with the one after); these intervals are the maximal repeated substrings, and the union of
their spans over all suffixes of depth ``min_words`` or more is the covered part.  A text fails if
more than ``max_covered`` of its words are covered, or if its longest repeat is over
``max_longest`` words and over ``max_longest_part`` of its words.

Edge cases: null or blank texts have no words and fail the base rule; every text is whole.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common as C

SLICE_WORDS = 1_000_000  # words sorted together; one longer text is sorted alone
SYMBOLS = b"#*$%&|<>"  # the characters counted as symbols


@dataclass(frozen=True)
class Rules:
    min_words: int = 12  # shortest repeat that counts as covered
    max_covered: float = 0.18
    max_longest: int = 50
    max_longest_part: float = 0.10
    base_window: int = 5
    base_min_words: int = 10
    base_percent: int = 20


def longest_repeats(symbols: np.ndarray) -> np.ndarray:
    """For each position, the length of the longest substring there that also starts elsewhere.

    ``symbols`` are non-negative; a symbol that occurs once ends every match.  Memory: a rank (4
    bytes up to 2^31 symbols) for each symbol and each doubling up to the longest repeat.
    """
    n = len(symbols)
    if n == 0:
        return np.empty(0, np.int64)
    kind = np.int32 if n < 1 << 31 else np.int64
    sa = np.argsort(symbols, kind="stable")
    s = symbols[sa]
    new = np.r_[True, s[1:] != s[:-1]]
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n + 1, np.int64)  # rank: place of the group's first suffix; the end sorts first
    rank[sa], rank[n] = start, -1
    levels, h = [rank.astype(kind)], 1
    tied = ~new
    tied[:-1] |= ~new[1:]
    places = np.flatnonzero(tied)
    while len(places):
        pos = sa[places]
        a, b = rank[pos], rank[np.minimum(pos + h, n)]
        order = np.lexsort((b, a))
        pos, a, b = pos[order], a[order], b[order]
        sa[places] = pos  # groups keep their places
        new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
        rank[pos] = np.maximum.accumulate(np.where(new, places, 0))
        levels.append(rank.astype(kind))
        h *= 2
        tied = ~new
        tied[:-1] |= ~new[1:]
        places = places[tied]
    i, j = sa[:-1], sa[1:]
    lcp = np.zeros(n - 1, np.int64)
    live = np.flatnonzero(levels[0][i] == levels[0][j])
    for k in range(len(levels) - 1, -1, -1):
        x, y = np.minimum(i[live] + lcp[live], n), np.minimum(j[live] + lcp[live], n)
        same = (levels[k][x] == levels[k][y]) & (x < n) & (y < n)
        lcp[live[same]] += 1 << k
    out = np.zeros(n, np.int64)
    out[sa[1:]] = lcp
    np.maximum.at(out, sa[:-1], lcp)
    return out


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    mark = np.zeros(n + 1, np.int64)
    np.add.at(mark, starts, 1)
    np.add.at(mark, starts + lengths, -1)
    return np.cumsum(mark[:-1]) > 0


def measure(texts: list[bytes], rules: Rules) -> list[tuple[int, int, int, int]]:
    """Words, words in repeated base windows, covered words and longest repeat of each text."""
    words = [t.split() for t in texts]
    at = C.offsets([len(w) + 1 for w in words])
    total = int(at[-1])
    code: dict = defaultdict(count(1).__next__)
    sym = np.zeros(total, np.int64)
    for i, w in enumerate(words):
        sym[at[i] : at[i + 1] - 1] = np.fromiter(map(code.__getitem__, w), np.int64, len(w))
    doc = np.repeat(np.arange(len(words)), np.diff(at))
    rep = longest_repeats(doc * (len(code) + 1) + sym)
    short = np.flatnonzero(rep >= rules.base_window)
    base = covered(short, np.full(len(short), rules.base_window), total)
    long = np.flatnonzero(rep >= rules.min_words)
    cov = covered(long, rep[long], total)
    add = lambda x: np.add.reduceat(x.astype(np.int64), at[:-1]).tolist() if len(words) else []
    top = np.maximum.reduceat(rep, at[:-1]).tolist() if len(words) else []
    return list(zip([len(w) for w in words], add(base), add(cov), top))


def lines_repeated(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip(C.WS)]
    return len(lines) - len(set(lines))


def quality_rules(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row per document with the base counts, the repetition measures and both verdicts; no shuffle."""
    C.tune(docs.sparkSession)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_covered", "longest_repeat"]
    kinds = [pa.int64()] * 6 + [pa.bool_()] * 2 + [pa.int64()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or b"" for t in b.column(1).to_pylist()]
            got: list[tuple[int, int, int, int]] = []
            part: list[bytes] = []
            size = 0
            for t in texts:
                if part and size + len(t) > 6 * SLICE_WORDS:
                    got += measure(part, rules)
                    part, size = [], 0
                part.append(t)
                size += len(t)
            got += measure(part, rules) if part else []
            cols: list[list] = [[] for _ in names]
            for i, t, (n, rep, cov, top) in zip(b.column(0).to_pylist(), texts, got):
                ascii_rest = len(t.translate(None, bytes(range(128, 192))))  # without continuation bytes: code points
                chars = ascii_rest - (len(t) - len(t.translate(None, C.WS)))
                bad = n < rules.base_min_words or 100 * rep > rules.base_percent * n
                keep = not bad and cov <= rules.max_covered * n and not (top > rules.max_longest and top > rules.max_longest_part * n)
                for c, v in zip(cols, (i, n, chars, len(t) - len(t.translate(None, SYMBOLS)), lines_repeated(t), rep, bad, keep, cov, top)):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    return C.text_bytes(docs, C.doc_id_col()).mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_covered long, longest_repeat long")


def op5_repetition_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
