"""Toxicity by noisy-channel deobfuscation.

A suspicious string (digits or marks among letters, letters repeated three times or more) becomes
a lattice: each character may stand for itself, for a letter that it imitates, or for nothing;
runs may shrink.  Letters set apart by blanks or by marks between blanks become one lattice too,
in which each gap is nothing or the end of a word.  A Viterbi search under a character trigram
model restores the likeliest words; it is exact and linear in the length.  The trigram counts come
from the words of all documents, in tables of fixed size (trigrams share ``2 ** TABLE`` hashed
places).

The restored text is scored in two steps, both learned from labelled rows only:

* evidence of hashed features (the word, its beginnings) as log odds of documents with the
  feature among toxic and other rows;
* a logistic model on few document measures: the three strongest words, how many words carry
  evidence and how that compares with what the text's length would bring by chance.  The measures
  of a training row use the evidence of the other half of the rows.

Rows whose crc32(doc_id) is divisible by ``FOLDS`` are held out.  Bound of the fit (a parameter):
``FIT_ROWS`` labelled doc_ids and about as many rows, by hash.  Language-model counts and scoring cover all texts.

Edge cases: null or empty text is scored from the intercept; without training rows of both labels
every score is the share of toxic ones (0 without any); repeated labels of a doc_id count once,
toxic if any is; a null doc_id is never held out.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

FOLDS = 5
FIT_ROWS = 20_000
BUCKETS = 1 << 20
SEGMENT = 1 << 14
RISK = 1.2  # log odds from which a word carries evidence
MEMO = 120_000  # strings that each memo of a worker remembers
TABLE = 20
GAP_ENDS_WORD = -2.0  # log-probability that a blank between single letters ends a word

#: What a character may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "*": "aeiou", "#": "h",
}
MARKS = frozenset(".,-_~'`^*\"!|#$%&;:/\\")  # may stand for nothing
EDGE = "".join(MARKS) + "?()[]{}<>=…«»“”’"
SINGLES = re.compile(b"\x02[\x01\x02]+\x02")  # over the kinds of a text's strings
TRIPLE = re.compile(r"(.)\1\1")
ELSE = "ɐ"


def fold(c: str) -> str:
    """Letters up to U+024F keep their place in the model; all other characters share one."""
    return c if c.isalpha() and c < ELSE else ELSE


class Counts:
    """Trigram counts of folded words in tables of fixed size: trigrams hashed, pairs and single characters exact."""

    def __init__(self) -> None:
        self.tri, self.bi, self.context = np.zeros(1 << TABLE), np.zeros(1 << 20), np.zeros(1 << 20)

    def add(self, code: np.ndarray, n: np.ndarray) -> None:
        """``code``: three characters of 10 bits each."""
        for table, at in ((self.tri, place(code)), (self.bi, code & 0xFFFFF), (self.context, code >> 10)):
            np.add.at(table, at, n)


def place(code: np.ndarray) -> np.ndarray:
    return (C.mix(code.astype(np.uint64), 41) >> np.uint64(64 - TABLE)).astype(np.int64)


class CharModel:
    """Interpolated trigram model of words."""

    def __init__(self, counts: Counts):
        self.counts = counts
        self.single, self.before = counts.bi.reshape(1024, 1024).sum(0), counts.bi.reshape(1024, 1024).sum(1)
        self.total = max(1.0, float(self.single.sum()))
        self.memo: dict[str, float] = {}

    def log(self, a: str, b: str, c: str) -> float:
        g = a + b + c
        if (p := self.memo.get(g)) is None:
            if len(self.memo) > MEMO:
                self.memo.clear()
            x, y, z = map(ord, g)
            n2, n1 = self.counts.context[x << 10 | y], self.before[y]
            p = 0.7 * min(1.0, self.counts.tri[place(np.array([x << 20 | y << 10 | z]))[0]] / n2) if n2 else 0.0
            p += 0.2 * self.counts.bi[y << 10 | z] / n1 if n1 else 0.0
            p = self.memo[g] = math.log(p + 0.09 * self.single[z] / self.total + 1e-6)
        return p


def lattice(s: str) -> list[list[tuple[str, float]]]:
    """For each run of a character, what it may be and at which log-probability."""
    out, i = [], 0
    while i < len(s):
        j, c = i, s[i]
        while j < len(s) and s[j] == c:
            j += 1
        r, arcs = j - i, []
        copies = {1: 0.0} if r == 1 else {2: -0.05, 1: -6.0} if r == 2 else {1: -0.5, 2: -0.9}
        for letter in [c] if c.isalpha() else LEET.get(c, ""):
            cost = 0.0 if c.isalpha() else -0.7 - math.log(len(LEET[c]))
            arcs += [(letter * k, cost * k + x) for k, x in copies.items()]
        if c in MARKS:
            arcs.append(("", -3.5 if c in LEET and any(x.isalpha() for x in s[j:]) else -1.2))  # noise gathers at the end
        if not arcs:
            arcs.append((c * min(r, 2), 0.0))
        out.append(arcs)
        i = j
    return out


def paths(arcs: list[list[tuple[str, float]]], model: CharModel) -> tuple[float, str]:
    """Score and text of the best path through ``arcs``; a blank on it ends a word and starts the next."""
    best: dict[tuple[str, str], tuple[float, tuple | None]] = {("^", "^"): (0.0, None)}
    for step in arcs:
        nxt: dict[tuple[str, str], tuple[float, tuple | None]] = {}
        for (a, b), (score, back) in best.items():
            for text, cost in step:
                x, p, q = score + cost, a, b
                for c in text:
                    if c == " ":
                        x += model.log(p, q, "$")
                        p = q = "^"
                    else:
                        f = fold(c)
                        x += model.log(p, q, f)
                        p, q = q, f
                if (p, q) not in nxt or nxt[p, q][0] < x:
                    nxt[p, q] = (x, (back, text) if text else back)
        best = nxt
    score, back = max(((score + model.log(a, b, "$"), back) for (a, b), (score, back) in best.items()), key=lambda x: x[0])
    out = []
    while back:
        back, text = back
        out.append(text)
    return score, "".join(reversed(out))


def decode(s: str, model: CharModel) -> str:
    """Likeliest word behind ``s``."""
    return paths(lattice(s), model)[1]


def spaced_lattice(tokens: list[str]) -> list[list[tuple[str, float]]]:
    """The lattice of single letters and marks with gaps between them."""
    out: list[list[tuple[str, float]]] = []
    for t in tokens:
        if out:
            out.append([("", 0.0), (" ", GAP_ENDS_WORD)])
        out += lattice(t)
    return out


class Kinds(dict):
    """Of a string of up to three characters: 2 a single letter or digit with or without marks (``d``, ``d.``, ``dd``), 1 marks alone, 0 others."""

    def __missing__(self, s: str) -> int:
        letters = {c for c in s if c.isalnum() or (c in LEET and c not in MARKS)}
        rest = all(c in MARKS or c in EDGE for c in s if c not in letters)
        if len(self) > MEMO:
            self.clear()
        kind = self[s] = 0 if not rest or len(letters) > 1 else 2 if letters else 1
        return kind


class Restorer(dict):
    """White-space delimited string to its restored lower-case word, remembered.

    A string whose edge marks may or may not be letters restores to both readings, blank between.
    """

    def __init__(self, model: CharModel):
        super().__init__()
        self.model, self.kinds, self.spaced = model, Kinds(), {}

    def __missing__(self, s: str) -> str:
        x = s.lower()
        core = x.strip(EDGE)
        if not core.isalpha() or TRIPLE.search(core):
            # marks at the edge may imitate letters ("$tupid", "a$$")
            full = x.strip(".,;:?\"'()[]{}…«»“”’")
            if len(full) > 1 and any(c.isalpha() for c in full):
                core = " ".join(sorted({decode(o, self.model) for o in (full, core) if any(c.isalpha() for c in o)}))
        if len(self) > MEMO:
            self.clear()
        if len(s) <= 64:
            self[s] = core
        return core

    def parts(self, text: str) -> tuple[list[str], list[str]]:
        """White-space delimited strings, and words hidden by blanks between letters.

        Blanks hide where words end, so a run of single letters gives its decoded words and the
        parts of them all in one.
        """
        raw, more, kinds = text.split(), [], self.kinds
        kind = bytes([kinds[w] if len(w) < 4 else 0 for w in raw])
        if kind.count(2) > 2:
            for m in SINGLES.finditer(kind):
                if m.group().count(2) > 2:
                    more += self.hidden(raw[m.start() : m.end()])
        return raw, more

    def hidden(self, run: list[str]) -> list[str]:
        """Words that a run of single letters hides, and all parts of them together."""
        s = " ".join(run).lower()
        if not any(map(str.isalpha, s)):
            return []
        if (out := self.spaced.get(s)) is None:
            out = paths(spaced_lattice(s.split(" ")), self.model)[1].split()
            whole = "".join(out)
            out += [whole[i:j] for i in range(len(whole)) for j in range(i + 4, min(len(whole), i + 15) + 1)]
            if len(self.spaced) > MEMO // 10:
                self.spaced.clear()
            if len(s) <= 64:
                self.spaced[s] = out
        return out

    def words(self, text: str) -> list[str]:
        raw, more = self.parts(text)
        return " ".join(map(self.__getitem__, raw)).split() + more


# ---------------------------------------------------------------- language model over all texts


def trigrams(words: Counter) -> tuple[np.ndarray, np.ndarray]:
    """Codes of folded trigrams of plain words, ``^^`` before and ``$`` after, and their counts."""
    plain = [(w, n) for w, n in words.items() if w.isalpha() and not TRIPLE.search(w)]
    codes, counts = [np.empty(0, np.int64)], [np.empty(0)]
    for i in range(0, len(plain), 20_000):
        part = plain[i : i + 20_000]
        x = np.frombuffer("".join(f"^^{w}$" for w, _ in part).encode("utf-32-le"), np.uint32).astype(np.int64)
        x = np.minimum(x, ord(ELSE))
        weight = np.repeat(np.array([n for _, n in part], np.float64), np.array([len(w) + 3 for w, _ in part], np.int64))
        ok = (x[:-2] != ord("$")) & (x[1:-1] != ord("$"))
        code, at = np.unique((x[:-2] << 20 | x[1:-1] << 10 | x[2:])[ok], return_inverse=True)
        codes.append(code)
        counts.append(np.bincount(at, weight[:-2][ok]))
    return np.concatenate(codes), np.concatenate(counts)


def character_counts(docs: DataFrame) -> Counts:
    """Trigram counts over the words of all documents.

    Tasks send distinct trigrams; four tasks fold them to tables, so the driver gets four times the
    tables' fixed size at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()

        def out() -> pa.RecordBatch:
            cores: Counter = Counter()
            for w, n in words.items():
                cores[w.lower().strip(EDGE)] += n
            words.clear()
            code, n = trigrams(cores)
            return pa.RecordBatch.from_arrays([pa.array(code, pa.int64()), pa.array(n, pa.float64())], ["g", "n"])

        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    words.update(t.decode("utf-8", "replace").split())
                    if len(words) > MEMO:
                        yield out()
        yield out()

    def fold_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = Counts()
        for b in batches:
            mine.add(b.column(0).to_numpy(), b.column(1).to_numpy())
        for k, table in enumerate((mine.tri, mine.bi, mine.context)):
            at = np.flatnonzero(table)
            for i in range(0, len(at), 100_000):
                some = at[i : i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([some.astype("i4").tobytes()], pa.binary()), pa.array([table[some].tobytes()], pa.binary())], ["k", "at", "n"])

    by_code = C.cut(C.text_bytes(docs).mapInArrow(run, "g long, n double").groupBy("g").agg(F.sum("n").alias("n")))
    counts = Counts()
    for r in by_code.coalesce(4).mapInArrow(fold_up, "k int, at binary, n binary").collect():
        (counts.tri, counts.bi, counts.context)[r.k][np.frombuffer(bytes(r.at), "i4")] += np.frombuffer(bytes(r.n), np.float64)
    return counts


# ---------------------------------------------------------------- evidence and measures


def features(word: str) -> list[str]:
    """A word, and its beginnings of 4 to 7 characters."""
    return ["=" + word, *("^" + word[:k] for k in range(4, min(8, len(word))))] if word else []


def bucket(feature: str) -> int:
    return zlib.crc32(feature.encode()) % BUCKETS


def evidence(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Log odds of each bucket from document counts ``[other, toxic]``; zero where too few."""
    odds = np.log((count[1] + 0.5) / (total[1] + 1)) - np.log((count[0] + 0.5) / (total[0] + 1))
    return np.where((count[1] >= 3) & (odds > RISK), odds, 0).astype(np.float32)


class Evidence(dict):
    """White-space delimited string to the strongest evidence of its restored words, remembered.

    ``found`` maps the features that carry evidence to their log odds.
    """

    def __init__(self, restore: Restorer, found: dict[str, float]):
        super().__init__()
        self.restore, self.found = restore, found
        self.starts = {f[1:5] for f in found}  # no word with another start carries any

    def of(self, words: list[str]) -> float:
        best = 0.0
        for w in words:
            if w[:4] in self.starts:
                best = max(best, self.found.get("=" + w, 0.0), *(self.found.get("^" + w[:k], 0.0) for k in range(4, min(8, len(w)))))
        return best

    def __missing__(self, s: str) -> float:
        w = s.lower()
        if not w.isalpha():
            w = w.strip(EDGE)
        if w.isalpha() and not TRIPLE.search(w):
            x = self.of([w]) if w[:4] in self.starts else 0.0
        else:
            x = self.of(self.restore[s].split())
        if len(self) > MEMO:
            self.clear()
        self[s] = x
        return x

    def risks(self, text: str) -> tuple[int, list[float]]:
        """Number of strings, and the evidence of those that carry any, strongest first."""
        raw, more = self.restore.parts(text)
        out = [r for r in map(self.__getitem__, raw) if r]
        if more:
            out.append(self.of(more))
        return len(raw), sorted(filter(None, out), reverse=True)


MEASURES = 8


def measures(n: int, k: int, top: list[float], chance: float) -> list[float]:
    """From the number of strings, of those with evidence, and the three strongest."""
    expect = chance * n
    return [1.0, *(top + [0.0, 0.0, 0.0])[:3], math.log1p(k), math.log1p(n), (k - expect) / math.sqrt(expect + 0.5), sum(r > 3 for r in top[:3]) / 3]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 40) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the intercept comes first and is free."""
    w, pen = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    pen[0, 0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + pen
        d = np.linalg.solve(h, x.T @ (y - p) - pen @ w)
        w += d * min(1.0, 5 / (np.abs(d).max() + 1e-9))
        if np.abs(d).max() < 1e-6:
            break
    return w


class Scorer:
    def __init__(self, counts: Counts | None, found: dict[str, float], chance: float, weights: np.ndarray | None, prior: float):
        self.counts, self.found, self.chance, self.weights, self.prior = counts, found, chance, weights, prior
        self.ev: Evidence | None = None

    def fresh(self) -> Scorer:
        return Scorer(self.counts, self.found, self.chance, self.weights, self.prior)

    def score(self, texts: list[str]) -> list[float]:
        if self.weights is None:
            return [self.prior] * len(texts)
        if self.ev is None:
            self.ev = Evidence(Restorer(CharModel(self.counts)), self.found)
        x = np.array([measures(n, len(r), r[:3], self.chance) for n, r in map(self.ev.risks, texts)]).reshape(-1, MEASURES)
        return (1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))).tolist()


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("long").cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> Scorer:
    """Learn the scorer: character counts from all ``docs``, evidence and weights from labelled rows."""
    spark = docs.sparkSession
    C.tune(spark)
    counts = character_counts(docs)
    y = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("y"))
    y = y.where(~held_out()).withColumn("h", F.xxhash64("doc_id")).orderBy("h").limit(FIT_ROWS).select("doc_id", "y", (F.pmod("h", F.lit(2))).cast("int").alias("half"))
    labelled = C.cut(C.text_bytes(docs, C.doc_id_col()).join(F.broadcast(C.cut(y)), "doc_id").select("doc_id", "text", "y", "half"))
    train = C.sampled(labelled, FIT_ROWS, more=("y", "half")).select("text", "y", "half")  # a doc_id may stand in many rows
    model = spark.sparkContext.broadcast(counts)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore = Restorer(CharModel(model.value))
        mine = np.zeros((4, BUCKETS), np.int32)
        rows = np.zeros(4, np.int32)
        for b in batches:
            for t, label, half in zip(*(c.to_pylist() for c in b.columns)):
                seen = {bucket(f) for w in set(restore.words(t.decode("utf-8", "replace") if t else "")) for f in features(w)}
                mine[2 * half + label, list(seen)] += 1
                rows[2 * half + label] += 1
        out: list[tuple[int, bytes]] = [(-1, rows.tobytes())] if rows.any() else []
        out += [(i, x.tobytes()) for i in range(BUCKETS // SEGMENT) if (x := mine[:, i * SEGMENT : (i + 1) * SEGMENT]).any()]
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.binary())], ["seg", "part"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, np.ndarray] = {}
        for b in batches:
            for s, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x = np.frombuffer(x, np.int32)
                got[s] = got[s] + x if s in got else x
        if got:
            yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.int32()), pa.array([v.astype(np.int32).tobytes() for v in got.values()], pa.binary())], ["seg", "part"])

    few = max(1, min(C.partitions(spark), 12))
    count, rows = np.zeros((4, BUCKETS), np.int64), np.zeros(4, np.int64)
    for seg, part in train.coalesce(few).mapInArrow(gather, "seg int, part binary").repartition(few, "seg").mapInArrow(merge, "seg int, part binary").collect():  # 16 MB whatever the input
        x = np.frombuffer(bytes(part), np.int32).reshape(4, -1)
        if seg < 0:
            rows += x[:, 0]
        else:
            count[:, seg * SEGMENT : (seg + 1) * SEGMENT] = x
    both, sums = count[:2] + count[2:], rows[:2] + rows[2:]
    prior = float(sums[1] / max(1, sums.sum()))
    if not sums.all():
        return Scorer(None, {}, 0.0, None, prior)
    halves = [evidence(count[2 * (1 - h) : 2 * (1 - h) + 2], rows[2 * (1 - h) : 2 * (1 - h) + 2]) for h in (0, 1)]  # for half h from the other
    odds = [*halves, evidence(both, sums)]
    some = spark.sparkContext.broadcast(np.logical_or.reduce([o > 0 for o in odds]))

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore, seen, out = Restorer(CharModel(model.value)), set(), set()
        for b in batches:
            for t in b.column(0).to_pylist():
                new = set(restore.words(t.decode("utf-8", "replace") if t else "")) - seen
                out |= {f for w in new for f in features(w) if some.value[bucket(f)]}
                seen = seen | new if len(seen) < MEMO else new
        yield pa.RecordBatch.from_arrays([pa.array(sorted(out), pa.string())], ["f"])

    held = [r.f for r in train.select("text").mapInArrow(names, "f string").distinct().collect()]  # those with evidence only
    found = [{f: float(o[bucket(f)]) for f in held if o[bucket(f)] > 0} for o in odds]
    shared = spark.sparkContext.broadcast(found)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore = Restorer(CharModel(model.value))
        ev = [Evidence(restore, o) for o in shared.value]
        for b in batches:
            label, hits, size, risk = [], [], [], []
            for t, y_, half in zip(*(c.to_pylist() for c in b.columns)):
                n, r = ev[half].risks(t.decode("utf-8", "replace") if t else "")
                label.append(y_)
                size.append(n)
                hits.append(len(r))
                risk.append(np.array(r[:3], np.float64).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(size, pa.int64()), pa.array(hits, pa.int64()), pa.array(risk, pa.binary())], ["y", "n", "k", "top"])

    got = train.mapInArrow(measure, "y int, n long, k long, top binary").collect()  # about FIT_ROWS rows
    plain = [(r.k, r.n) for r in got if not r.y]
    chance = sum(k for k, _ in plain) / max(1, sum(n for _, n in plain))
    x = [measures(r.n, r.k, np.frombuffer(bytes(r.top), np.float64).tolist(), chance) for r in got]
    w = logistic(np.array(x), np.array([r.y for r in got], float))
    return Scorer(counts, found[2], chance, w, prior)


def toxic_scores(docs: DataFrame, scorer: Scorer, column: str = "score_") -> DataFrame:
    """All columns of ``docs`` and ``column``; only the text goes to Python and only the score returns."""
    spark = docs.sparkSession
    C.tune(spark)
    shared = spark.sparkContext.broadcast(scorer)

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        mine = shared.value.fresh()  # memos live as long as the task
        for texts in batches:
            yield pa.array(mine.score([t or "" for t in texts.to_pylist()]), pa.float64())

    return docs.withColumn(column, F.arrow_udf(score, "double")("text"))


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(C.doc_id_col(), "text")
    scored = toxic_scores(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", held_out().alias("held_out"), F.col("score_").alias("score"), (F.col("score_") >= 0.5).cast("int").alias("predicted"))
