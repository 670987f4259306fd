"""Secret scans with inferred grammars.

Base patterns (assignments, access keys, long hexadecimal runs) give labelled credentials.  From
those of all documents, one probabilistic automaton is inferred for each kind: a prefix tree over
character classes, whose states are merged while their outgoing frequencies are statistically
compatible (Hoeffding bound, recursively); then all values pass through it, which gives the
frequencies of its states.  Every run of credential characters
in every text, of whatever length, is then scored: its log-likelihood under the best automaton
less that under a class bigram of ordinary runs.  Short runs cannot gather much, so no length is
asked for.  Runs above a threshold fitted on all ordinary runs become ``inferred`` spans; base spans
always stay.

All counts are made by Spark over all texts, distinct shapes counting once.  Only sums reach the driver: the
edges of the tree below prefixes that at least one in ``SHARE`` values of a kind begins with, down to ``DEPTH``
characters, counts by state and by pair of classes, and a histogram of ordinary runs by gain (``BIN`` nats).

Edge cases: null text is empty; without labelled values of a kind there is no automaton for it,
and without any there are only base spans; offsets are code points, end exclusive.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

KINDS = ("assign", "access", "hex")
SHARE, DEPTH = 1024, 64  # prefixes of fewer values, or longer ones, tell no states apart
BIN, LOW, HIGH = 0.01, -100.0, 400.0
ALPHA = 0.05  # of the compatibility test

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
RUN = re.compile(r"[A-Za-z0-9+/_.=-]+")
LEAST = 8.0  # nats that a run must gain at least
ORDINARY = 0.9995  # share of ordinary shapes that the threshold leaves below

#: Character classes: digit, hexadecimal and other letters by case, marks.
_CLASS = {c: "0" for c in "0123456789"} | {c: "a" if c <= "f" else "g" for c in "abcdefghijklmnopqrstuvwxyz"} | {c: "A" if c <= "F" else "G" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"} | {c: "-" for c in "+/_.=-"}
SHAPE = str.maketrans(_CLASS)
SYMBOLS = "0agAG-"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the base patterns, in order."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    for s, run in _long_words(text, 20):
        out += [(s + m.start(), 1, s + m.end()) for m in ACCESS.finditer(run) if m.end() - m.start() >= 20]
        out += [(s + m.start(), 2, s + m.end()) for m in HEX.finditer(run)]
    return sorted(out)


def _long_words(text: str, least: int) -> Iterator[tuple[int, str]]:
    """White-space delimited strings of ``least`` or more characters and where they start."""
    at = 0
    for w in text.split():
        if len(w) >= least:
            at = text.index(w, at)
            yield at, w
            at += len(w)


def _clear(runs: Iterator[re.Match], base: list[tuple[int, int, int]]) -> Iterator[re.Match]:
    """The runs (in order) that touch no base span."""
    spans, k = sorted((s, e) for s, _, e in base), 0
    reach = 0  # greatest end of the spans that start before the run's end
    for m in runs:
        while k < len(spans) and spans[k][0] < m.end():
            reach = max(reach, spans[k][1])
            k += 1
        if reach <= m.start():
            yield m


class Automaton:
    """A probabilistic automaton inferred from strings by merging compatible prefix-tree states."""

    def __init__(self, samples: list[str], alpha: float = ALPHA, edges: list[tuple[str, str, int]] | None = None):
        """From strings, or from ``edges`` of a prefix tree: (prefix, next symbol or "$", strings); what lies below is unknown."""
        self.total, self.final, self.edge = [0], [0], [{}]  # by state: strings through it, ending in it, symbol -> [state, count]
        self.alpha = alpha
        for s in samples:
            q = 0
            self.total[0] += 1
            for c in s:
                if c not in self.edge[q]:
                    self.edge[q][c] = [len(self.total), 0]
                    self.total.append(0)
                    self.final.append(0)
                    self.edge.append({})
                self.edge[q][c][1] += 1
                q = self.edge[q][c][0]
                self.total[q] += 1
            self.final[q] += 1
        at = {"": 0}
        for prefix, c, n in sorted(edges or []):
            q = at[prefix]  # a prefix sorts behind its own prefixes
            self.total[q] += n
            if c == "$":
                self.final[q] += n
            else:
                at[prefix + c] = len(self.total)
                self.edge[q][c] = [len(self.total), n]
                self.total.append(0)
                self.final.append(0)
                self.edge.append({})
        self._merge()
        self._index()

    def _same(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        if not n1 or not n2:
            return True
        return abs(f1 / n1 - f2 / n2) < math.sqrt(0.5 * math.log(2 / self.alpha)) * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _compatible(self, p: int, q: int) -> bool:
        stack = [(p, q)]
        while stack:
            p, q = stack.pop()
            if not self._same(self.final[p], self.total[p], self.final[q], self.total[q]):
                return False
            for c in self.edge[p].keys() | self.edge[q].keys():
                a, b = self.edge[p].get(c), self.edge[q].get(c)
                if not self._same(a[1] if a else 0, self.total[p], b[1] if b else 0, self.total[q]):
                    return False
                if a and b:
                    stack.append((a[0], b[0]))
        return True

    def _fold(self, p: int, q: int) -> None:
        """Add the tree under q to p."""
        stack = [(p, q)]
        while stack:
            p, q = stack.pop()
            self.total[p] += self.total[q]
            self.final[p] += self.final[q]
            for c, (child, n) in self.edge[q].items():
                if c in self.edge[p]:
                    self.edge[p][c][1] += n
                    stack.append((self.edge[p][c][0], child))
                else:
                    self.edge[p][c] = [child, n]

    def _merge(self) -> None:
        kept = [0]
        while True:
            new = next(((p, c) for p in kept for c, (q, _) in sorted(self.edge[p].items()) if q not in kept), None)
            if new is None:
                break
            p, c = new
            q = self.edge[p][c][0]
            for r in kept:
                if self._compatible(r, q):
                    self.edge[p][c][0] = r
                    self._fold(r, q)
                    break
            else:
                kept.append(q)
        self.kept = kept

    def _index(self) -> None:
        """Smoothed log-probabilities; a symbol never seen in a state costs ``floor`` and stays there."""
        self.log = {}
        for q in self.kept:
            n = self.total[q] + len(SYMBOLS) + 1
            self.log[q] = ({c: (math.log((k + 1) / n), t) for c, (t, k) in self.edge[q].items()}, math.log((self.final[q] + 1) / n), math.log(1 / n))

    def passed(self, shapes: list[str]) -> dict[tuple[int, str], int]:
        """How many of ``shapes`` take each symbol in each state, or end there ("$"); an unknown symbol stays."""
        n: dict[tuple[int, str], int] = {}
        for s in shapes:
            q = 0
            for c in s:
                n[q, c] = n.get((q, c), 0) + 1
                q = self.edge[q][c][0] if c in self.edge[q] else q
            n[q, "$"] = n.get((q, "$"), 0) + 1
        return n

    def recount(self, n: dict[tuple[int, str], int]) -> None:
        for q in self.kept:
            to = {c: self.edge[q][c][0] for c in self.edge[q]}
            self.edge[q] = {c: [to.get(c, q), n.get((q, c), 0)] for c in SYMBOLS if c in to or (q, c) in n}
            self.final[q] = n.get((q, "$"), 0)
            self.total[q] = self.final[q] + sum(k for _, k in self.edge[q].values())
        self._index()

    def score(self, s: str) -> float:
        q, total = 0, 0.0
        for c in s:
            steps, _, floor = self.log[q]
            p, q = steps.get(c, (floor, q))
            total += p
        return total + self.log[q][1]


class Bigram:
    """Class bigram of ordinary runs."""

    def __init__(self, counts: dict[str, int]):
        n = {a: {b: 1.0 + counts.get(a + b, 0) for b in SYMBOLS + "$"} for a in "^" + SYMBOLS}
        self.log = {a: {b: math.log(k / sum(r.values())) for b, k in r.items()} for a, r in n.items()}

    @staticmethod
    def pairs(shapes: Iterable[str]) -> dict[str, int]:
        n: Counter[str] = Counter()
        for s in shapes:
            n.update(map("".join, zip("^" + s, s + "$")))
        return n

    def score(self, s: str) -> float:
        return sum(self.log[a][b] for a, b in zip("^" + s, s + "$"))


class Model:
    def __init__(self, values: dict[int, list[str]], ordinary: list[str]):
        self._take({k: Automaton(x) for k, x in values.items() if x}, Bigram(Bigram.pairs(ordinary)))
        # nearly all ordinary runs stay below
        self.least = max(LEAST, float(np.quantile([self.gain(v) for v in ordinary], ORDINARY) + 1.0 if ordinary and self.automata else 0.0))
        self.shapes.clear()

    @classmethod
    def of(cls, automata: dict[int, Automaton], plain: Bigram) -> Model:
        """A model from counts; its threshold is still to be set."""
        m = cls.__new__(cls)
        m._take(automata, plain)
        m.least = LEAST
        return m

    def _take(self, automata: dict[int, Automaton], plain: Bigram) -> None:
        self.automata, self.plain = automata, plain
        self.shapes: dict[str, float] = {}
        self.words: dict[str, bool] = {}

    def gain(self, shape: str) -> float:
        """Log-likelihood under the best automaton less that of an ordinary run."""
        if not self.automata:
            return -math.inf
        if (g := self.shapes.get(shape)) is None:
            g = max(a.score(shape) for a in self.automata.values()) - self.plain.score(shape)
            if len(shape) <= 64:
                if len(self.shapes) > C.MEMO_LIMIT // 4:
                    self.shapes.clear()
                self.shapes[shape] = g
        return g

    def told(self, word: str) -> bool:
        """Whether a white-space delimited string holds a run above the threshold."""
        if (x := self.words.get(word)) is None:
            x = any(self.gain(r.translate(SHAPE)) > self.least for r in RUN.findall(word))
            if len(word) <= 64:
                if len(self.words) > C.MEMO_LIMIT // 2:
                    self.words.clear()
                self.words[word] = x
        return x

    def spans(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
        if not self.automata or not any(map(self.told, set(text.split()))):
            return []
        return [m.span() for m in _clear(RUN.finditer(text), base) if self.gain(m.group().translate(SHAPE)) > self.least]


def fit(docs: DataFrame) -> Model:
    """Infer the automata from the labelled credentials of all ``docs``, and the threshold from all other runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: set[tuple[int, str]] = set()
            for t in b.column(0).to_pylist():
                text = t.decode("utf-8", "replace") if t else ""
                base = base_spans(text)
                for s, k, e in base:
                    if k == 0:
                        s = ASSIGN.match(text, s).start(2)
                    out.add((k, text[s:e].translate(SHAPE)))
                out |= {(-1, x.translate(SHAPE)) for x in {m.group() for m in _clear(RUN.finditer(text), base)}}
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int32()), pa.array([x for _, x in out], pa.string())], ["kind", "shape"])

    by_kind = C.cut(C.text_bytes(docs).mapInArrow(run, "kind int, shape string").distinct())
    known = by_kind.where("kind >= 0")
    total = {r.kind: r["count"] for r in known.groupBy("kind").count().collect()}
    heavy = " or ".join(f"kind = {k} and m >= {max(1, n // SHARE)}" for k, n in total.items()) or "false"
    step = known.select("kind", "shape", F.explode(F.expr(f"sequence(0, least(length(shape), {DEPTH}))")).alias("at"))
    step = step.select("kind", F.expr("substring(shape, 1, at)").alias("prefix"), F.expr("if(at < length(shape), substring(shape, at + 1, 1), '$')").alias("next"))
    edges = C.cut(step.groupBy("kind", "prefix", "next").agg(F.count("*").alias("n")))
    edges = edges.join(edges.groupBy("kind", "prefix").agg(F.sum("n").alias("m")).where(heavy), ["kind", "prefix"]).collect()
    automata = {k: Automaton([], edges=[(r.prefix, r.next, r.n) for r in edges if r.kind == k]) for k in sorted(total)}

    def counted(rows: DataFrame, count: Callable[[int, list[str]], dict]) -> dict:
        """Sums over all ``rows`` of what ``count`` says of a kind's shapes in a batch."""

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                of: dict[int, list[str]] = {}
                for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    of.setdefault(k, []).append(x)
                got = [(k, str(key), n) for k, x in of.items() for key, n in count(k, x).items()]
                yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], t) for i, t in enumerate((pa.int32(), pa.string(), pa.int64()))], ["kind", "key", "n"])

        return {(r.kind, r.key): r.n for r in rows.mapInArrow(part, "kind int, key string, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")).collect()}

    through = counted(known, lambda k, x: {f"{q} {c}": n for (q, c), n in automata[k].passed(x).items()})
    for k, a in automata.items():
        a.recount({(int(key.split()[0]), key.split()[1]): n for (kind, key), n in through.items() if kind == k})
    other = by_kind.where("kind = -1")
    model = Model.of(automata, Bigram({key: n for (_, key), n in counted(other, lambda _, x: Bigram.pairs(x)).items()}))
    if automata:
        gains = counted(other, lambda _, x: Counter(math.ceil(min(max(model.gain(s), LOW), HIGH) / BIN) for s in x))
        bins = sorted((int(key), n) for (_, key), n in gains.items())
        if bins:
            upto = np.cumsum([n for _, n in bins])
            model.least = max(LEAST, bins[int(np.searchsorted(upto, ORDINARY * upto[-1]))][0] * BIN + 1.0)
        model.shapes.clear()
    return model


def find_secrets(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``doc_id, base, inferred``: spans as arrays of (kind, start, end); no shuffle."""
    spark = docs.sparkSession
    C.tune(spark)
    shared = spark.sparkContext.broadcast(model or fit(docs))  # a few thousand states at most
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            base, more = [], []
            for t in b.column(1).to_pylist():
                text = t.decode("utf-8", "replace") if t else ""
                found = base_spans(text)
                base.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in found])
                more.append([{"kind": "inferred", "start": s, "end": e} for s, e in m.spans(text, found)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(base, span), pa.array(more, span)], ["doc_id", "base", "inferred"])

    kind = "array<struct<kind:string,start:long,end:long>>"
    return C.text_bytes(docs, C.doc_id_col()).mapInArrow(run, f"doc_id long, base {kind}, inferred {kind}")


def joined(col: str) -> str:
    return f"array_join(transform({col}, x -> concat_ws(':', x.kind, x.start, x.end)), ',')"


def op6_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = {f"n_{k}": F.expr(f"cast(size(filter(base, x -> x.kind = '{k}')) as bigint)") for k in KINDS}
    rank = "case x.kind when 'assign' then 0 when 'access' then 1 when 'hex' then 2 else 3 end"
    order = f"transform(array_sort(transform(concat(base, inferred), x -> struct(x.start as start, {rank} as rank, x.kind as kind, x.end as end))), x -> struct(x.kind as kind, x.start as start, x.end as end))"
    return found.select("doc_id", *[c.alias(k) for k, c in count.items()], F.sha2(F.expr(joined("base")).cast("binary"), 256).alias("base_sha256"), F.expr(joined(order)).alias("spans"))
