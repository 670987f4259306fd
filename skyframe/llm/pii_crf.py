"""PII with a skip-chain conditional random field.

Base patterns (e-mail, IP, card, phone) give spans that always stay, and weak labels.  The
variables of the field are a text's *mentions*: strings around an ``@`` (not a bare one) and digit
groups with their separators.  All other words are observed as context of the mentions beside them.
Potentials: features of a mention; the labels of neighbouring mentions (chain); and equal labels
of mentions that repeat or resemble each other, however far apart.  These skip edges lead from
every occurrence of a key to one hub of that key, a variable without features of its own, so a
key has as many edges as occurrences and evidence is two hops away.  Loopy sum-product message
passing, vectorised over all texts of a batch, runs until no message changes by ``SETTLED`` and
gives the marginals (``ROUNDS`` stops a field that oscillates in spite of damping).

A mention that its own form leaves open takes the label of its repetitions.  Mentions labelled as
an entity with probability ``least`` or more, and clear of all base spans, are added.

Weights are fitted by gradient ascent on the likelihood of the weak labels, with beliefs from the
same message passing; forms are dropped at random while fitting, so that context and repetition
get weight as well; a hub's label is the commonest of its mentions.  Bounds of the fit
(parameters): ``FIT_DOCS`` documents by hash and ``FIT_MENTIONS`` mentions, in pieces of up to
``PIECE`` consecutive ones.  Scanning covers all texts, each as one field.

Edge cases: null text is empty; without weak labels nothing is added; offsets are code points.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .secret_scan import joined

KINDS = ("email", "ip", "card", "phone")
FIT_DOCS, FIT_MENTIONS = 20_000, 20_000
LEAST = 0.8  # probability from which a mention is added
PIECE = 2_000
SETTLED, ROUNDS = 1e-4, 400  # of message passing
UNDAMPED = 25  # rounds before messages are averaged with their last values
NEAR = 60  # characters between mentions that a chain edge spans at most
HASHED = 64  # context buckets on each side

DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")  # a start inside a run of digits fares as its first digit
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
STOPS = frozenset("@<>()[],;:\"'")
AFTER_AT = re.compile(r"[^\s@<>()\[\],;:\"']*")
GROUP = re.compile(r"\+?\(?[0-9](?:[0-9().-]|\x20(?=[0-9(]))*[0-9]|[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As the pattern finds them, from each ``@`` to the left and right: linear in the text."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(kind, start, end)`` of the base patterns, by kind and start."""
    out = [(0, s, e) for s, e in _emails(text)]
    if DIGIT.search(text):
        if "." in text:
            out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.group().split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 16:
                d = _digits(m.group())
                if 16 <= len(d) <= 19 and luhn(d):
                    out.append((2, m.start(), m.end()))
        if "+" in text:
            out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15]
    return out


# ---------------------------------------------------------------- mentions and features

_NAMES = ("at", "at_one", "dotted_domain", "plus", "dots1", "dots2", "dots3", "dots4", "octets", "luhn", "dash", "space", "paren", "letters")
_SIZES = (3, 6, 7, 9, 12, 15, 16, 19)
OWN = len(_NAMES) + len(_SIZES) + 1
WIDTH = OWN + 2 * HASHED + 1
SLOTS = 12


def around_at(text: str) -> Iterator[tuple[int, int]]:
    """Strings without white space and brackets around each ``@`` that has a neighbour: each character is walked over once."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and (c := text[start - 1]) not in STOPS and not c.isspace():
            start -= 1
        done = AFTER_AT.match(text, at + 1).end()
        if done - start > 1:
            yield start, done
        at = text.find("@", done)


def mentions(text: str) -> list[tuple[int, int]]:
    """In time that is linear in the text."""
    out = list(around_at(text))
    if DIGIT.search(text):
        taken = list(out)
        k = 0
        for m in GROUP.finditer(text):
            while k < len(taken) and taken[k][1] <= m.start():
                k += 1
            if (k == len(taken) or m.end() <= taken[k][0]) and sum("0" <= c <= "9" for c in m.group()) >= 4:
                out.append(m.span())
    return sorted(out)


def features(text: str, s: int, e: int) -> list[int]:
    """Indices of the active features: form first, then context."""
    x = text[s:e]
    d, dots = _digits(x), x.count(".")
    f = [i for i, on in enumerate((
        "@" in x, x.count("@") == 1 and not x.startswith("@") and not x.endswith("@"), "@" in x and "." in x.partition("@")[2].strip("."), x.startswith("+"),
        dots == 1, dots == 2, dots == 3, dots > 3, dots == 3 and "@" not in x and all(p.isdigit() and len(p) < 4 and int(p) < 256 for p in x.split(".")),
        13 <= len(d) <= 19 and luhn(d), "-" in x, " " in x, "(" in x, any(c.isalpha() for c in x))) if on]
    f.append(len(_NAMES) + sum(len(d) > b for b in _SIZES))
    before, after = text[max(0, s - 30) : s].split()[-1:], text[e : e + 30].split()[:1]
    f.append(OWN + zlib.crc32(before[0].lower().strip(".,;:!?\"'").encode()) % HASHED if before else OWN)
    f.append(OWN + HASHED + zlib.crc32(after[0].lower().strip(".,;:!?\"'").encode()) % HASHED if after else OWN + HASHED)
    return (f + [WIDTH - 1] * SLOTS)[:SLOTS]


def key(x: str) -> str:
    """Mentions with one key are repeated or similar: letters folded, or the last nine digits."""
    if "@" in x:
        return x.lower().strip(".")
    d = _digits(x)
    return "#" + d[-9:] if len(d) >= 7 else "=" + x


class Graph:
    """Mentions of several texts as one graph."""

    def __init__(self) -> None:
        self.feature: list[list[int]] = []
        self.label: list[int] = []
        self.place: list[tuple[int, int, int]] = []  # text, start, end
        self.clear: list[bool] = []
        self.chain: list[tuple[int, int]] = []
        self.skip: list[tuple[int, int]] = []  # mention, hub

    def _node(self, feature: list[int], label: int, place: tuple[int, int, int], clear: bool) -> int:
        for x, v in ((self.feature, feature), (self.label, label), (self.place, place), (self.clear, clear)):
            x.append(v)
        return len(self.label) - 1

    def add(self, number: int, text: str, base: list[tuple[int, int, int]], some: list[tuple[int, int]] | None = None) -> None:
        """The mentions of a text, or ``some`` consecutive ones."""
        groups: dict[str, list[int]] = {}
        prior, by_start = None, sorted((s, e, k) for k, s, e in base)
        reach = 0  # base spans that end before the mention are passed
        for s, e in mentions(text) if some is None else some:
            while reach < len(by_start) and by_start[reach][1] <= s:
                reach += 1
            hit, j = [], reach
            while j < len(by_start) and by_start[j][0] < e:
                if s < by_start[j][1]:
                    hit.append(by_start[j])
                j += 1
            label = 1 + max(hit, key=lambda b: min(e, b[1]) - max(s, b[0]))[2] if hit else 0
            i = self._node(features(text, s, e), label, (number, s, e), not hit)
            if prior is not None and s - prior[1] <= NEAR:
                self.chain.append((prior[0], i))
            groups.setdefault(key(text[s:e]), []).append(i)
            prior = (i, e)
        for same in groups.values():
            if len(same) > 1:
                labels = [self.label[i] for i in same]
                hub = self._node([WIDTH - 1] * SLOTS, max(sorted(set(labels)), key=labels.count), (number, 0, 0), False)
                self.skip += [(i, hub) for i in same]


def _edges(x: list[tuple[int, int]]) -> np.ndarray:
    return np.array(x, np.int64).reshape(-1, 2)


class Field:
    LABELS = 1 + len(KINDS)

    def __init__(self) -> None:
        self.node = np.zeros((WIDTH, self.LABELS))
        self.link = np.zeros((self.LABELS, self.LABELS))
        self.same = np.array(0.5)

    def beliefs(self, feats: np.ndarray, chain: np.ndarray, skip: np.ndarray, text: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Marginals of mentions and hubs, chain edges and skip edges by loopy sum-product.

        ``text`` numbers the text of each node: the messages of a text rest once they have settled,
        whatever the texts beside it do.
        """
        unary = self.node[feats].sum(1)
        unary -= unary.max(1, keepdims=True)
        edge, n = np.concatenate([chain, skip]), len(chain)
        link, more = np.exp(self.link), float(np.exp(self.same)) - 1
        a, b = edge[:, 0], edge[:, 1]
        to_b = np.zeros((len(edge), self.LABELS))  # log messages
        to_a = np.zeros_like(to_b)

        def sent(x: np.ndarray, pot: np.ndarray) -> np.ndarray:
            x = np.exp(x - x.max(1, keepdims=True))
            x = np.concatenate([x[:n] @ pot, x[n:] * more + x[n:].sum(1, keepdims=True)])
            return np.log(x / x.sum(1, keepdims=True))

        of = np.zeros(len(edge), np.int64) if text is None else text[a]
        moving = np.ones(len(edge), bool)

        def totals() -> np.ndarray:
            total = unary.copy()
            np.add.at(total, b, to_b)
            np.add.at(total, a, to_a)
            return total

        for k in range(ROUNDS if len(edge) else 0):
            total = totals()
            new_b, new_a = sent(total[a] - to_a, link), sent(total[b] - to_b, link.T)
            moved = np.zeros(of.max() + 1)
            np.maximum.at(moved, of, np.maximum(np.abs(new_b - to_b), np.abs(new_a - to_a)).max(1))
            w = (1.0 if k < UNDAMPED else 0.5) * moving[:, None]
            to_b, to_a = to_b + w * (new_b - to_b), to_a + w * (new_a - to_a)
            moving &= moved[of] >= SETTLED
            if not moving.any():
                break
        total = totals()
        p = np.exp(total - total.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        x, y = total[a] - to_a, total[b] - to_b
        both = np.exp(x - x.max(1, keepdims=True))[:, :, None] * np.exp(y - y.max(1, keepdims=True))[:, None, :]
        both[:n] *= link
        both[n:] *= 1 + more * np.eye(self.LABELS)
        both /= both.sum((1, 2), keepdims=True)
        return p, both[:n], both[n:]

    def fit(self, feats: np.ndarray, label: np.ndarray, chain: np.ndarray, skip: np.ndarray, steps: int = 80, rate: float = 0.3, decay: float = 1e-4, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        gold, n = np.eye(self.LABELS)[label], max(1, len(label))
        seen = [np.full(w.shape, 1e-6) for w in (self.node, self.link, self.same)]
        for _ in range(steps):
            # one mention in seven shows its context alone
            hide = (rng.random((len(feats), 1)) < 1 / 7) & (feats < OWN)
            f = np.where(hide, WIDTH - 1, feats)
            p, pc, ps = self.beliefs(f, chain, skip)
            g = np.zeros_like(self.node)
            for s in range(SLOTS):
                np.add.at(g, f[:, s], gold - p)
            g[WIDTH - 1] = 0
            gl = np.zeros_like(self.link)
            if len(chain):
                np.add.at(gl, (label[chain[:, 0]], label[chain[:, 1]]), 1)
                gl -= pc.sum(0)
            gs = np.array((label[skip[:, 0]] == label[skip[:, 1]]).sum() - np.trace(ps, axis1=1, axis2=2).sum() if len(skip) else 0.0)
            for w, d, h in zip((self.node, self.link, self.same), (g, gl, gs), seen):
                d = d / n - decay * w
                h += d * d
                w += rate * d / np.sqrt(h)
        np.clip(self.same, 0, 6, out=self.same)


def fit(docs: DataFrame) -> Field | None:
    """Fit the field on the weak labels of a bounded sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [t for t in (t.decode("utf-8", "replace") if t else "" for t in b.column(0).to_pylist()) if "@" in t or DIGIT.search(t)]
            rows = []
            for t in keep:
                all_, base = mentions(t), base_spans(t)
                for i in range(0, len(all_), PIECE):
                    x = Graph()
                    x.add(0, t, base, all_[i : i + PIECE])
                    rows.append(x)
            yield pa.RecordBatch.from_arrays([pa.array([len(x.label) for x in rows], pa.int64()), pa.array([np.array(x.feature, "i4").tobytes() for x in rows], pa.binary()), pa.array([np.array(x.label, "i4").tobytes() for x in rows], pa.binary()), pa.array([_edges(x.chain).tobytes() for x in rows], pa.binary()), pa.array([_edges(x.skip).tobytes() for x in rows], pa.binary())], ["n", "f", "y", "c", "s"])

    rows = C.text_bytes(C.sampled(docs, FIT_DOCS)).mapInArrow(run, "n long, f binary, y binary, c binary, s binary")
    got, total, feats, label, chain, skip = C.cut(rows), 0, [], [], [], []
    for r in C.within(got, "n", FIT_MENTIONS).collect():
        feats.append(np.frombuffer(r.f, "i4").reshape(-1, SLOTS))
        label.append(np.frombuffer(r.y, "i4"))
        chain.append(np.frombuffer(r.c, np.int64).reshape(-1, 2) + total)
        skip.append(np.frombuffer(r.s, np.int64).reshape(-1, 2) + total)
        total += r.n
    if not total or not np.concatenate(label).any():
        return None
    field = Field()
    field.fit(np.concatenate(feats), np.concatenate(label), np.concatenate(chain), np.concatenate(skip))
    return field


def label_texts(texts: list[str], field: Field | None, least: float = LEAST) -> tuple[list, list]:
    """Base and added spans ``(kind, start, end)`` of each text."""
    base = [base_spans(t) for t in texts]
    more: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if field is not None:
        g = Graph()
        for i, t in enumerate(texts):
            g.add(i, t, base[i])
        if g.label:
            p, _, _ = field.beliefs(np.array(g.feature), _edges(g.chain), _edges(g.skip), np.array([t for t, _, _ in g.place]))
            best = p[:, 1:].argmax(1)
            for m in np.flatnonzero(p[np.arange(len(p)), best + 1] >= least):
                i, s, e = g.place[m]
                if g.clear[m]:
                    more[i].append((int(best[m]), s, e))
    return base, [sorted(x) for x in more]


def find_pii(docs: DataFrame, *cols, field: Field | None = None) -> DataFrame:
    """``cols`` and ``text`` with ``base, added``: spans as arrays of (kind, start, end); no shuffle."""
    spark = docs.sparkSession
    C.tune(spark)
    shared = spark.sparkContext.broadcast(field or fit(docs))  # a fixed number of weights
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t.decode("utf-8", "replace") if t else "" for t in b.column(b.num_columns - 1).to_pylist()]
            both = label_texts(texts, shared.value)
            spans = [pa.array([[{"kind": KINDS[k], "start": s, "end": e} for k, s, e in x] for x in side], span) for side in both]
            yield pa.RecordBatch.from_arrays([*b.columns, *spans], [*b.schema.names, "base", "added"])

    rows = C.text_bytes(docs, *cols)
    kind = "array<struct<kind:string,start:long,end:long>>"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{schema}, base {kind}, added {kind}")


def redact(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind in brackets; ``n_chars`` follows."""
    spark = docs.sparkSession
    C.tune(spark)
    shared = spark.sparkContext.broadcast(field or fit(docs))
    at = docs.columns.index("text")
    chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            old = b.column(at).to_pylist()
            texts = [t.decode("utf-8", "replace") if t else "" for t in old]
            new: list[str | None] = []
            for t, o, base, more in zip(texts, old, *label_texts(texts, shared.value)):
                parts, done = [], 0
                for s, e, k in sorted((s, e, k) for k, s, e in base + more):
                    if s >= done:
                        parts += [t[done:s], f"[{KINDS[k].upper()}]"]
                    elif e > done:
                        pass  # the overlap's rest goes with the span before
                    done = max(done, e)
                new.append(None if o is None else "".join([*parts, t[done:]]))
            cols = list(b.columns)
            cols[at] = pa.array(new, pa.string())
            if chars is not None:
                cols[chars] = pa.array([None if x is None else len(x) for x in new], b.schema.field(chars).type)
            yield pa.RecordBatch.from_arrays(cols, b.schema.names)

    rows = docs.withColumn("text", F.col("text").cast("binary"))
    return rows.mapInArrow(run, docs.schema)


def op10_pii_crf(spark, sf_dir: str) -> DataFrame:
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"), C.doc_id_col())
    count = [F.expr(f"cast(size(filter(base, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in KINDS]
    rank = "case x.kind when 'email' then 0 when 'ip' then 1 when 'card' then 2 else 3 end"
    order = f"transform(array_sort(transform(concat(base, added), x -> struct({rank} as rank, x.start as start, x.end as end, x.kind as kind))), x -> struct(x.kind as kind, x.start as start, x.end as end))"
    return found.select("doc_id", *count, F.sha2(F.expr(joined("base")).cast("binary"), 256).alias("base_sha256"), F.expr(joined(order)).alias("spans"))
