"""Quality classifier from weak labels.

Overlapping heuristic labellers vote low, good or nothing on every document.  Documents are
counted by vote pattern (at most 3 to the number of labellers, whatever the input), and
expectation-maximisation over these counts estimates each labeller's accuracy and the share of
good documents, without any true label.  The posterior of its pattern labels a document, and a
linear scorer over hashed words and word shapes is fitted to such posteriors.  The scorer, not the
votes, gives the score, so it also ranks documents on which all labellers abstain.

Bounds of the fit of the scorer (parameters): about ``FIT_DOCS`` documents by hash, ``FIT_FEATURES``
features in whole documents.  Votes,
expectation-maximisation and scores cover all texts.

Edge cases: null or blank text has no words, gets the lowest score and is not kept; an empty table
gives an empty result; ties and repeated rows have equal scores.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

FIT_DOCS, FIT_FEATURES = 6_000, 4_000_000
BUCKETS = 1 << 16
SYMBOLS = b"#*$%&|<>{}[]\\^~=_@!"
LOW, GOOD, NONE = 0, 1, 2
#: Before the data speak: the share of a labeller's votes that are low on low and on good documents.
#: A labeller sees one kind of fault, so most low documents pass most labellers.
PRIOR_LOW_ON_LOW, PRIOR_LOW_ON_GOOD, PRIOR_WEIGHT, PRIOR_GOOD = 0.3, 0.01, 50.0, 0.85
PORTION = 1 << 20
LABELLERS = ("symbols", "repeated_words", "repeated_lines", "capitals", "word_length", "variety", "sentences", "length", "marked_words")


_ENDS = np.isin(np.arange(256), list(b".!?"))
_MARKED = np.isin(np.arange(256), list(b"#$%&*|!~^"))
_KIND = np.array([1 if 65 <= i <= 90 else 2 if 48 <= i <= 57 else 3 if i >= 128 or 97 <= i <= 122 else 4 if chr(i) in ".,;:?'\"()-" else 5 for i in range(256)])
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"


class Measured:
    """Word measures of a batch of texts, all at once."""

    def __init__(self, texts: list[bytes]):
        self.h, self.at, self.length, self.first, self.last = C.scan_words(texts, lower=True)
        self.n = np.diff(self.at)
        self.doc = np.repeat(np.arange(len(texts)), self.n)
        add = lambda x: np.bincount(self.doc, x, len(texts))
        self.chars = add(self.length)
        self.ends, self.marked = add(_ENDS[self.last]), add(_MARKED[self.last])
        same = np.zeros(len(self.h), bool)
        same[1:] = (self.h[1:] == self.h[:-1]) & (self.doc[1:] == self.doc[:-1])
        self.pairs = add(same)
        order = np.lexsort((self.h, self.doc))
        hs, ds = self.h[order], self.doc[order]
        cuts = np.flatnonzero(np.r_[True, (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1])]) if len(hs) else np.empty(0, np.int64)
        count, owner = np.diff(np.r_[cuts, len(hs)]), ds[cuts]
        self.kinds = np.bincount(owner, minlength=len(texts))
        self.top = np.zeros(len(texts), np.int64)
        np.maximum.at(self.top, owner, count)
        self.symbols = np.array([len(t) - len(t.translate(None, SYMBOLS)) for t in texts], np.int64)
        self.upper = np.array([len(t) - len(t.translate(None, _UPPER)) for t in texts], np.int64)
        lines = [[x for x in t.split(b"\n") if x.strip(C.WS)] for t in texts]
        self.lines, self.own_lines = np.array([len(x) for x in lines], np.int64), np.array([len(set(x)) for x in lines], np.int64)


def portions(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ends of consecutive texts of about ``PORTION`` bytes: what is measured at once, so that memory does not follow the batch."""
    start = size = 0
    for k, t in enumerate(texts, 1):
        size += len(t)
        if size >= PORTION or k == len(texts):
            yield start, k
            start, size = k, 0


def votes(m: Measured) -> np.ndarray:
    """A row of votes (one for each of ``LABELLERS``) for each text."""
    n, chars = np.maximum(m.n, 1), np.maximum(m.chars, 1)
    pick = lambda low, good, say=True: np.where(say & (m.n > 0), np.where(low, LOW, np.where(good, GOOD, NONE)), NONE)
    pairs, top, ends, marked, mean = m.pairs / n, m.top / n, m.ends / n, m.marked / n, chars / n
    out = np.stack([
        pick(m.symbols > 0.05 * chars, m.symbols <= 0.005 * chars),
        pick((pairs > 0.1) | ((m.n >= 20) & (top > 0.3)), pairs < 0.05),
        pick(m.own_lines < 0.7 * m.lines, (m.lines >= 3) & (m.own_lines == m.lines), m.lines > 1),
        pick(m.upper > 0.3 * chars, m.upper < 0.1 * chars),
        pick((mean < 2.5) | (mean > 15), (mean >= 3.5) & (mean <= 9)),
        pick(m.kinds < 2 * np.sqrt(n), m.kinds > 4 * np.sqrt(n), m.n >= 20),  # kinds grow about as the root of the length
        pick((ends > 0.4) | (m.ends == 0), (ends >= 0.03) & (ends <= 0.2), m.n >= 20),
        np.where(m.n < 3, LOW, np.where(m.n >= 40, GOOD, NONE)),
        pick(marked > 0.2, marked < 0.02),
    ], 1).astype(np.int64)
    return out.reshape(-1, len(LABELLERS))


class LabelModel:
    """Accuracies of the labellers by expectation-maximisation over pattern counts."""

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, steps: int = 200):
        k = patterns.shape[1]
        # low[class, labeller]: share of low votes among its votes; saying nothing tells nothing
        start = np.repeat(np.array([[PRIOR_LOW_ON_LOW], [PRIOR_LOW_ON_GOOD]]), k, axis=1)
        self.low, self.good = start.copy(), PRIOR_GOOD
        is_low, spoke = (patterns == LOW).astype(float), (patterns != NONE).astype(float)
        for _ in range(steps if counts.sum() else 0):
            q = self.posterior(patterns)
            good = (counts @ q + PRIOR_WEIGHT * PRIOR_GOOD) / (counts.sum() + PRIOR_WEIGHT)
            new = np.stack([(w @ is_low + PRIOR_WEIGHT * start[c]) / (w @ spoke + PRIOR_WEIGHT) for c, w in ((LOW, counts * (1 - q)), (GOOD, counts * q))])
            done = max(abs(good - self.good), np.abs(new - self.low).max()) < 1e-9
            self.low, self.good = new, good
            if done:
                break

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability of good for each pattern."""
        lo, ok = (patterns == LOW).astype(float), (patterns == GOOD).astype(float)
        low = np.log(1 - self.good) + lo @ np.log(self.low[LOW]) + ok @ np.log(1 - self.low[LOW])
        good = np.log(self.good) + lo @ np.log(self.low[GOOD]) + ok @ np.log(1 - self.low[GOOD])
        return 1 / (1 + np.exp(np.clip(low - good, -50, 50)))


def features(m: Measured) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets, distinct buckets and weights of each text: hashed words, word shapes, and document measures.

    Weights are square roots of shares, so length does not count.
    """
    docs = len(m.n)
    shape = (_KIND[m.first] * 8 + _KIND[m.last]) * 16 + np.minimum(m.length, 15)
    word = (m.h >> np.uint64(13)).astype(np.int64) % (BUCKETS - 4096) + 4096
    key, count = np.unique(np.concatenate([m.doc, m.doc]) * BUCKETS + np.concatenate([word, 1024 + shape]), return_counts=True)
    n = np.maximum(m.n, 1)
    d, i, v = key // BUCKETS, key % BUCKETS, np.sqrt(count / n[key // BUCKETS])
    whole = np.stack([m.pairs / n, 1 - m.own_lines / np.maximum(m.lines, 1), m.kinds / n, np.ones(docs)], 1)
    size = 8 + np.log2(n + 1).astype(np.int64)
    own = np.concatenate([np.repeat(np.arange(docs), 4), d])
    i = np.concatenate([np.stack([np.full(docs, 0), np.full(docs, 1), np.full(docs, 2), size], 1).ravel(), i])
    v = np.concatenate([np.sqrt(whole).ravel(), v])
    order = np.argsort(own, kind="stable")
    return C.offsets(np.bincount(own, minlength=docs)), i[order], v[order]


class LinearScorer:
    """Logistic regression over hashed features, fitted to soft labels by Adagrad."""

    def __init__(self) -> None:
        self.w, self.b = np.zeros(BUCKETS), 0.0

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = 12, rate: float = 0.3, decay: float = 1e-6) -> None:
        seen, sb, rng = np.full(BUCKETS, 1e-3), 1e-3, np.random.default_rng(5)
        for _ in range(epochs):
            for k in rng.permutation(len(rows)):
                i, v = rows[k]
                g = 1 / (1 + np.exp(-np.clip(self.w[i] @ v + self.b, -30, 30))) - y[k]
                d = g * v + decay * self.w[i]
                seen[i] += d * d
                self.w[i] -= rate * d / np.sqrt(seen[i])
                sb += g * g
                self.b -= rate * g / np.sqrt(sb)

    def score(self, at: np.ndarray, i: np.ndarray, v: np.ndarray) -> np.ndarray:
        sums = np.add.reduceat(self.w[i] * v, at[:-1]) if len(at) > 1 else np.empty(0)
        return 1 / (1 + np.exp(-np.clip(sums + self.b, -30, 30)))


def _pattern(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Votes as a string of digits, counted over the task."""
    count: Counter = Counter()
    for b in batches:
        texts = [t or b"" for t in b.column(0).to_pylist()]
        for start, end in portions(texts):
            count.update(map(tuple, votes(Measured(texts[start:end])).tolist()))
    yield pa.RecordBatch.from_arrays([pa.array(["".join(map(str, k)) for k in count], pa.string()), pa.array(list(count.values()), pa.int64())], ["pattern", "n"])


def fit(docs: DataFrame) -> tuple[LabelModel, LinearScorer]:
    C.tune(docs.sparkSession)
    rows = C.text_bytes(docs).mapInArrow(_pattern, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").collect()  # 19683 rows at most
    patterns = np.array([[int(c) for c in r.pattern] for r in rows], np.int64).reshape(-1, len(LABELLERS))
    model = LabelModel(patterns, np.array([r.n for r in rows], float))

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t for t in b.column(0).to_pylist() if t and t.split()]
            for start, end in portions(texts):
                m = Measured(texts[start:end])
                at, i, v = features(m)
                part = lambda x, t: pa.array([x[a:z].astype(t).tobytes() for a, z in zip(at[:-1], at[1:])], pa.binary())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([part(i, "i4"), part(v, "f4"), pa.array(model.posterior(votes(m)), pa.float64())], ["i", "v", "q"])

    scorer = LinearScorer()
    seen = C.cut(C.text_bytes(C.sampled(docs, FIT_DOCS)).mapInArrow(examples, "i binary, v binary, q double").withColumn("n", F.expr("octet_length(i) div 4")))
    got = C.within(seen, "n", FIT_FEATURES).collect()
    scorer.fit([(np.frombuffer(bytes(r.i), "i4"), np.frombuffer(bytes(r.v), "f4").astype(float)) for r in got], np.array([r.q for r in got]))
    return model, scorer


def quality_scores(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """``doc_id, weak_label, score, kept``: one row per document; no shuffle."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(fit(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, scorer = shared.value
        for b in batches:
            texts = [t or b"" for t in b.column(1).to_pylist()]
            for start, end in portions(texts):
                m = Measured(texts[start:end])
                q = model.posterior(votes(m))
                s = np.where(m.n > 0, scorer.score(*features(m)), 0.0)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, end - start), pa.array(q, pa.float64()), pa.array(s, pa.float64()), pa.array(s >= least)], ["doc_id", "weak_label", "score", "kept"])

    return C.text_bytes(docs, C.doc_id_col()).mapInArrow(run, "doc_id long, weak_label double, score double, kept boolean")


def op1_quality_classifier(spark, sf_dir: str) -> DataFrame:
    return quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
