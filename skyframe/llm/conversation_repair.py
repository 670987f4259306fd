"""Repair of conversations by A* on the edit lattice.

Rows of a conversation are taken by turn (nulls first; rows of one turn by role, then text).  A
node of the lattice is (rows consumed, role state); the states are start, after ``system``, after
``user`` and after ``assistant``.  Edits: Keep 0, Rerole 1, Delete 2 (blank and duplicate rows can
only be deleted), Insert 5; a truncated row that stays adds 5.  The heuristic of a node is the
suffix sum of what no path avoids: 2 for each blank or duplicate row (mandatory deletion) and for each
truncated one (its charge or its deletion, whichever is less).  It is consistent, so the first time a
node leaves the queue, keyed by (cost plus heuristic, audit), its cost is least and its audit the
ASCII-least of that cost: of two paths of one cost to one node neither audit can be a prefix of the
other, as a longer one holds more insertions.

Conversations of any length: rows are sorted by range over (conversation, turn, role, text), so a
long conversation is dealt over many tasks.  A task cuts it into segments of ``SEGMENT`` rows and
searches each from every entry state to every exit state.  Conversations that a task holds whole are
finished there; the segments of others meet in a product of their (state to state) tables, and their
rows stream past the finished audit once, in order, as SHA-256 can only be taken in order.  Equal
rows are folded into one with a count before the sort.

Edge cases: null conv_id is a conversation of its own; null role or text is one space (so the text
is blank); null turns come first and count in no gap; empty roles and other roles can't be kept;
a conversation without rows after damage has zeros, an empty audit and the hash of the empty string;
an empty table gives an empty result; extra columns are never read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import common as C

SEGMENT = 1000
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
TURN = (USER, USER, ASSISTANT, USER)  # where a rerole or an insertion leads to
NAME = {USER: "user", ASSISTANT: "assistant"}
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
CHARGE = (0, 2, 2, 2)  # what a row of each kind costs at least
SPACE = " \t\n\r\x0b\x0c"


# ---------------------------------------------------------------- search


def search(kinds: list[int], roles: list[str], enter: int) -> dict[int, tuple[int, str]]:
    """Least ``(cost, audit)`` from ``enter`` before the first row to each state after the last."""
    n = len(kinds)
    ahead = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        ahead[i] = ahead[i + 1] + CHARGE[kinds[i]]
    queue, done, out = [(ahead[0], "", 0, enter)], set(), {}
    while queue:
        f, audit, i, state = heapq.heappop(queue)
        if (i, state) in done:
            continue
        done.add((i, state))
        cost = f - ahead[i]
        steps = [(i, TURN[state], 5, "I")]
        if i == n:
            out[state] = (cost, audit)
        else:
            steps.append((i + 1, state, 2, "D"))
            if kinds[i] in (FINE, TRUNCATED):
                more = 5 if kinds[i] == TRUNCATED else 0
                steps.append((i + 1, TURN[state], 1 + more, "R"))
                if (kept := NEXT.get((state, roles[i][:1]))) is not None:
                    steps.append((i + 1, kept, more, "K"))
        for j, to, price, letter in steps:
            if (j, to) not in done:
                heapq.heappush(queue, (cost + price + ahead[j], audit + letter, j, to))
    return out


def joined(a: dict, b: dict) -> dict:
    """Product of two tables ``(enter, leave) -> (cost, audit)``."""
    out: dict = {}
    for (x, y), (c, s) in a.items():
        for z in range(4):
            if (y, z) in b:
                d, t = b[y, z]
                if (x, z) not in out or (c + d, s + t) < out[x, z]:
                    out[x, z] = (c + d, s + t)
    return out


def best(table: dict) -> tuple[int, str]:
    return min(table[START, q] for q in (START, ASSISTANT) if (START, q) in table)


class Replay:
    """Applies an audit to rows as they come and hashes what stays."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.hash, self.empty = audit, 0, START, hashlib.sha256(), True

    def _say(self, role: str, text: str) -> None:
        self.hash.update((("" if self.empty else "\n") + f"{role}:{text}").encode())
        self.empty = False

    def _insert(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.state = TURN[self.state]
            self._say(NAME[self.state], "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self._insert()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self.state = NEXT[self.state, role[:1]]
            self._say(role, text)
        elif letter == "R":
            self.state = TURN[self.state]
            self._say(NAME[self.state], text)

    def digest(self) -> str:
        self._insert()
        return self.hash.hexdigest()


# ---------------------------------------------------------------- segments


class Segment:
    """Some consecutive rows of a conversation and what its neighbours need to know of them."""

    def __init__(self, conv):
        self.conv, self.kinds, self.roles, self.texts, self.turns = conv, [], [], [], []

    def counts(self) -> dict:
        t = [x for x in self.turns if x is not None]
        pairs = [(a[:1] + b[:1]) for a, b in zip(self.roles, self.roles[1:])]
        return {
            "n": len(self.kinds), "low": min(t, default=None), "high": max(t, default=None), "turns": len(set(t)), "first_role": self.roles[0][:1], "last_role": self.roles[-1][:1],
            "illegal": sum(p not in ("su", "ua", "au") for p in pairs), **{k: self.kinds.count(v) for k, v in (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", TRUNCATED))},
        }

    def table(self, enters=range(4)) -> dict:
        return {(e, q): v for e in enters for q, v in search(self.kinds, self.roles, e).items()}


def added(a: dict, b: dict) -> dict:
    """Counts of two neighbouring stretches as those of one."""
    same = a["high"] is not None and a["high"] == b["low"]
    odd = a["last_role"] + b["first_role"] not in ("su", "ua", "au")
    sums = {k: a[k] + b[k] for k in ("n", "blank", "duplicate", "truncated")}
    low = b["low"] if a["low"] is None else a["low"]
    return sums | {"low": low, "high": a["high"] if b["high"] is None else b["high"], "turns": a["turns"] + b["turns"] - same, "first_role": a["first_role"], "last_role": b["last_role"], "illegal": a["illegal"] + b["illegal"] + odd}


def gaps(c: dict) -> int:
    return 0 if c["low"] is None else c["high"] - c["low"] + 1 - c["turns"]


RESULT = "conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
COUNTS = "n long, low long, high long, turns long, first_role string, last_role string, illegal long, blank long, duplicate long, truncated long"
COUNT_NAMES = [c.split()[0] for c in COUNTS.split(", ")]
PATHS = "enter array<int>, leave array<int>, costs array<long>, audits array<string>"


def result(conv, counts: dict, cost: int, audit: str, digest: str | None) -> dict:
    return {"conv_id": conv, "gaps": gaps(counts), **{k: counts[k] for k in ("blank", "duplicate", "truncated", "illegal")}, "cost": cost, "audit": audit, "repaired_sha256": digest}


def _segments(kind: str, most: int):
    """Of sorted rows: finished conversations, and segments of those that other tasks may share."""
    schema = RESULT.format(kind=kind) + ", part int, seq int, roles array<string>, texts array<string>, " + COUNTS.replace("illegal long, blank long, duplicate long, truncated long", "n_illegal long, n_blank long, n_duplicate long, n_truncated long") + ", " + PATHS
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        open_: list[Segment] = []  # the latest conversation; nothing but its last segment where it is shared
        shared, rows = True, []  # the first conversation may have begun in another task

        def piece(s: Segment) -> dict:
            nonlocal seq
            seq += 1
            t, c = s.table(), s.counts()
            for k in ("illegal", "blank", "duplicate", "truncated"):
                c[f"n_{k}"] = c.pop(k)
            return {"conv_id": s.conv, "part": part, "seq": seq, "roles": s.roles, "texts": s.texts, **c, "enter": [a for a, _ in t], "leave": [b for _, b in t], "costs": [v[0] for v in t.values()], "audits": [v[1] for v in t.values()]}

        def finish(last: bool) -> None:
            if not open_:
                return
            if shared or last:
                rows.extend(map(piece, open_))
            else:
                (s,) = open_
                cost, audit = best(s.table((START,)))
                play = Replay(audit)
                for r, t in zip(s.roles, s.texts):
                    play.row(r, t)
                rows.append(result(s.conv, s.counts(), cost, audit, play.digest()))
            open_.clear()

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pylist(rows, schema=arrow)
            rows.clear()
            return out

        started = False
        for b in batches:
            for conv, turn, role, text, times, earlier in zip(*(c.to_pylist() for c in b.columns)):
                if not started or conv != now:  # noqa: F821
                    if started:
                        finish(False)
                        shared = False
                    now, started = conv, True
                    open_.append(Segment(conv))
                end = text.rstrip(SPACE)[-1:]
                kind_ = BLANK if not end else DUPLICATE if earlier else FINE if end in ".!?" else TRUNCATED
                for k in range(times):
                    s = open_[-1]
                    if len(s.kinds) == most:
                        rows.append(piece(s))
                        open_[:] = [s := Segment(conv)]
                        shared = True
                        if len(rows) >= 16:
                            yield batch()
                    s.kinds.append(kind_ if k == 0 or kind_ == BLANK else DUPLICATE)
                    s.roles.append(role)
                    s.texts.append(text)
                    s.turns.append(turn)
            if rows:
                yield batch()
        finish(True)
        if rows:
            yield batch()

    return run, schema


def _solved(kind: str):
    """Counts, cost and audit of each conversation from its segments, which come in order."""

    schema = RESULT.format(kind=kind)
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[tuple[int, dict, dict]] = []  # (rank, counts, table): neighbours of one rank are joined, so tables stay few

        def push(rank: int, c: dict, t: dict) -> None:
            while stack and stack[-1][0] == rank:
                _, c0, t0 = stack.pop()
                rank, c, t = rank + 1, added(c0, c), joined(t0, t)
            stack.append((rank, c, t))

        def answer(conv) -> pa.RecordBatch:
            while len(stack) > 1:
                _, c1, t1 = stack.pop()
                r, c0, t0 = stack.pop()
                stack.append((r, added(c0, c1), joined(t0, t1)))
            _, c, t = stack.pop()
            return pa.RecordBatch.from_pylist([result(conv, c, *best(t), None)], schema=arrow)

        started = False
        for b in batches:
            for r in b.to_pylist():
                if started and r["conv_id"] != now:  # noqa: F821
                    yield answer(now)  # noqa: F821
                now, started = r["conv_id"], True
                c = {k: r[f"n_{k}" if k in ("illegal", "blank", "duplicate", "truncated") else k] for k in COUNT_NAMES}
                push(0, c, {(e, q): (x, s) for e, q, x, s in zip(r["enter"], r["leave"], r["costs"], r["audits"])})
        if started:
            yield answer(now)

    return run, schema


def _hashed(kind: str):
    """Each conversation's result row, then its segments in order: the result with its hash."""

    schema = RESULT.format(kind=kind)
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, play = None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([row | {"repaired_sha256": play.digest()}], schema=arrow)

        for b in batches:
            for r in b.to_pylist():
                if r["part"] < 0:
                    if row:
                        yield done()
                    row = {k: r[k] for k in ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")}
                    play = Replay(r["audit"])
                else:
                    for x, t in zip(r["roles"], r["texts"]):
                        play.row(x, t)
        if row:
            yield done()

    return run, schema


# ---------------------------------------------------------------- operator


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` after the damage that crc32 of ``conv_id:turn`` names; a repeated row stands twice."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    d = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("hit"))
    d = d.where("hit <> 0").withColumn("text", F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))).withColumn("role", F.when(F.col("hit") == 4, "user").otherwise(F.col("role")))
    return d.select("conv_id", "turn", "role", "text", F.explode(F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def _marked(rows: DataFrame) -> DataFrame:
    """Equal rows folded into one with ``times``; ``earlier``: its role and text stand at an earlier turn.

    Blank rows are deleted whatever came earlier, so they don't take part in the second step; the
    rest is two sums by key, and a join of which Spark can split a hot key.
    """
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    once = C.cut(rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("times")).withColumn("is_blank", blank))
    solid = once.where("not is_blank")
    # a null turn is the first; least of (0 for null, turn)
    least = solid.groupBy("conv_id", "role", "text").agg(F.count("*").alias("turns_"), F.min(F.struct(F.col("turn").isNotNull().alias("some"), "turn")).alias("first")).where("turns_ > 1")
    least = least.select(F.col("conv_id").alias("c_"), F.col("role").alias("r_"), F.col("text").alias("t_"), "first")
    again = solid.join(least, F.col("conv_id").eqNullSafe(F.col("c_")) & (F.col("role") == F.col("r_")) & (F.col("text") == F.col("t_")), "left")
    earlier = F.coalesce(F.struct(F.col("turn").isNotNull().alias("some"), "turn") > F.col("first"), F.lit(False))
    return again.select("conv_id", "turn", "role", "text", "times", earlier.alias("earlier")).unionByName(once.where("is_blank").select("conv_id", "turn", "role", "text", "times", F.lit(False).alias("earlier")))


def repair(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """``conv_id``, counts of faults, ``cost``, ``audit`` and ``repaired_sha256`` of every conversation of ``rows``."""
    spark, kind = rows.sparkSession, dict(rows.dtypes)["conv_id"]
    C.tune(spark)
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")]
    dealt = _marked(rows).repartitionByRange(C.partitions(spark), *order).sortWithinPartitions(*order)
    done = C.cut(dealt.mapInArrow(*_segments(kind, segment)))
    names = [c.split()[0] for c in RESULT.format(kind=kind).split(", ")]
    pieces = done.where("part is not null")
    n = C.partitions(spark)
    place = [F.asc_nulls_first("conv_id"), "part", "seq"]
    small = pieces.drop("roles", "texts", *names[1:])
    solved = C.cut(small.repartition(n, "conv_id").sortWithinPartitions(*place).mapInArrow(*_solved(kind)))
    head = solved.select(*names[:-1], F.lit(-1).alias("part"), F.lit(0).alias("seq"), F.lit(None).cast("array<string>").alias("roles"), F.lit(None).cast("array<string>").alias("texts"))
    body = pieces.select("conv_id", *[F.lit(None).cast(t).alias(c) for c, t in solved.drop("conv_id", "repaired_sha256").dtypes], "part", "seq", "roles", "texts")
    hashed = head.unionByName(body).repartition(n, "conv_id").sortWithinPartitions(*place).mapInArrow(*_hashed(kind))
    return done.where("part is null").select(*names).unionByName(hashed)


def repaired(conversations: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """``repair`` of the damaged rows, with a row for every conversation of the input."""
    out = repair(damaged(conversations), segment)
    every = conversations.select(F.col("conv_id").alias("every_")).distinct()
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    joined_ = every.join(out, F.col("every_").eqNullSafe(F.col("conv_id")), "left")
    return joined_.select(F.col("every_").alias("conv_id"), *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", empty).alias("repaired_sha256"))


def op12_conversation_repair(spark, sf_dir: str) -> DataFrame:
    return repaired(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


# ---------------------------------------------------------------- DuckDB


def _key(cost: str, audit: str) -> str:
    """Cost and audit as one string whose order is that of the pair."""
    return f"printf('%012d', {cost}) || {audit}"


def _plus(price: str, letter: str, then: str) -> str:
    return f"CASE WHEN {then} IS NOT NULL THEN " + _key(f"CAST(left({then}, 12) AS BIGINT) + {price}", f"'{letter}' || substr({then}, 13)") + " END"


def _oracle() -> str:
    # the best suffix of each state, from the last row backwards; then up to two insertions before it
    def step(q: int) -> str:
        keep = " ".join(f"WHEN r.ini = '{c}' THEN " + _plus("r.extra", "K", f"d.b{to}") for (a, c), to in NEXT.items() if a == q)
        stay = f"CASE WHEN r.kind IN (0, 3) THEN CASE {keep} END END"
        rerole = "CASE WHEN r.kind IN (0, 3) THEN " + _plus("1 + r.extra", "R", f"d.b{TURN[q]}") + " END"
        return f"least({_plus('2', 'D', f'd.b{q}')}, {stay}, {rerole}) AS e{q}"

    def inserted(q: int) -> str:
        one = TURN[q]
        return f"least(e{q}, {_plus('5', 'I', f'e{one}')}, {_plus('10', 'II', f'e{TURN[one]}')}) AS b{q}"

    after = ", ".join(inserted(q) for q in range(4))
    return f"""WITH RECURSIVE tab AS MATERIALIZED (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([CAST(i AS BIGINT)] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) x(i))),
        raw AS MATERIALIZED (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(4294967295, list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ord(x) AS BIGINT)),
            lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 20 AS hit FROM conversations, tab),
        dam AS (SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role, CASE WHEN hit = 1 THEN '' WHEN hit = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN hit = 3 THEN [0, 1] ELSE [0] END) AS copy FROM raw WHERE hit <> 0),
        num AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS again, left(role, 1) AS ini FROM dam),
        kinds AS MATERIALIZED (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 1 WHEN again > 1 THEN 2 WHEN regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 0 ELSE 3 END AS kind, lag(ini) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM num),
        r AS MATERIALIZED (SELECT *, CASE WHEN kind = 3 THEN 5 ELSE 0 END AS extra FROM kinds),
        summ AS MATERIALIZED (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (kind = 1) AS blank, count(*) FILTER (kind = 2) AS duplicate, count(*) FILTER (kind = 3) AS truncated, count(*) FILTER (i > 1 AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id),
        d AS (SELECT conv_id, i, {after} FROM (SELECT conv_id, n + 1 AS i, repeat('0', 12) AS e0, CAST(NULL AS VARCHAR) AS e1, CAST(NULL AS VARCHAR) AS e2, repeat('0', 12) AS e3 FROM summ)
            UNION ALL SELECT conv_id, i, {after} FROM (SELECT r.conv_id, r.i, {", ".join(step(q) for q in range(4))} FROM d JOIN r ON r.conv_id IS NOT DISTINCT FROM d.conv_id AND r.i = d.i - 1)),
        best AS MATERIALIZED (SELECT conv_id, CAST(left(b0, 12) AS BIGINT) AS cost, substr(b0, 13) AS audit FROM d WHERE i = 1),
        letters AS (SELECT conv_id, k, audit[k] AS c, length(replace(left(audit, k), 'I', '')) AS i, length(replace(left(audit, k), 'D', '')) AS place FROM (SELECT *, unnest(range(1, length(audit) + 1)) AS k FROM best)),
        said AS (SELECT l.conv_id, l.k, l.c, l.place, CASE WHEN l.c <> 'I' THEN r.text ELSE '' END AS text, r.role, max(CASE WHEN l.c = 'K' AND l.place = 1 AND r.ini = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.conv_id) AS led
            FROM letters l LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM l.conv_id AND r.i = l.i WHERE l.c <> 'D'),
        text_ AS (SELECT conv_id, string_agg(CASE WHEN c = 'K' THEN role WHEN (place - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY k) AS whole FROM said GROUP BY conv_id)
        SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) e LEFT JOIN summ ON summ.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN text_ ON text_.conv_id IS NOT DISTINCT FROM e.conv_id"""


ORACLE = _oracle()
