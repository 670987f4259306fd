"""Weighted fingerprints against exact similarity, and repairs of conversations against plain dynamic programming."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyframe.llm import conversation_repair as repair
from skyframe.llm import weighted_sampling as ws

from ..conftest import DATA
from .helpers import SCHEMA, awkward, prose, wide

# ---------------------------------------------------------------- fingerprints


def exact(a, b):
    a, b = Counter(a.encode().split()), Counter(b.encode().split())
    most = sum((a | b).values())
    return sum((a & b).values()) / most if most else 1.0


def test_collisions_estimate_generalised_jaccard():
    """Many samples of texts with repeated words: the share of equal ones is near the similarity."""
    rng, errors = random.Random(4), []
    for k in range(30):
        base = prose(k, 60).split()
        a = [w for w in base for _ in range(rng.choice([1, 1, 2, 5]))]
        b = [w for w in base if rng.random() < 0.7 for _ in range(rng.choice([1, 2, 4]))] + prose(100 + k, 10).split()
        x, y = ws.signatures([" ".join(a).encode(), " ".join(b).encode()], 2048)
        errors.append(ws.likeness_of(x, y) - exact(" ".join(a), " ".join(b)))
    assert abs(np.mean(errors)) < 0.006 and np.abs(errors).max() < 0.045


def test_fingerprints_do_not_depend_on_the_texts_around(monkeypatch):
    texts = [prose(k, 1 + 40 * k).encode() for k in range(12)] + [b"", None, b" \n "]
    alone = [ws.signatures([t])[0] for t in texts]
    assert ws.signatures(texts) == alone and ws.signatures(texts[::-1]) == alone[::-1]
    assert ws.signatures([b" ".join(reversed(texts[9].split()))]) == [alone[9]]  # a bag of words
    monkeypatch.setattr(ws, "CHUNK", 7)
    assert ws.signatures(texts) == alone
    assert alone[-3:] == [b""] * 3 and ws.likeness_of(b"", b"") == 1 and ws.likeness_of(b"", alone[0]) == 0


def check_pairs(rows, got):
    """Edited texts, lengths, fingerprints and likeness of rows in descending order of doc_id."""
    for i, (d, t) in enumerate(rows):
        nxt, r = rows[(i + 1) % len(rows)][1], got[i]
        e = ws.edited(t, nxt)
        assert e == t[: len(t) - len(t) // 3] + nxt[: len(t) // 3]
        a, b, c = ws.signatures([t.encode(), e.encode(), nxt.encode()])
        assert (r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (d, len(t), hashlib.sha256(e.encode()).hexdigest(), a.hex(), b.hex())
        assert (r.near_edited, r.near_next) == (ws.likeness_of(a, b), ws.likeness_of(a, c))


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))


def test_every_document_meets_the_next_one(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    got = ws.op11_weighted_fingerprint(spark, DATA).collect()
    check_pairs(in_order([(r.doc_id, r.text or "") for r in rows]), in_order_rows(got))


def in_order_rows(got):
    return sorted(got, key=lambda r: (r.doc_id is None, -(r.doc_id or 0)))


def test_fingerprint_edges(spark):
    docs = awkward(spark)
    got = ws.with_following(docs).collect()
    assert sorted(map(str, got)) == sorted(map(str, ws.with_following(wide(docs)).collect())) and len(got) == docs.count()
    assert ws.with_following(docs.limit(0)).count() == 0
    one = spark.createDataFrame([(5, "a b c d e f", None, None, None)], SCHEMA)
    check_pairs([(5, "a b c d e f")], ws.with_following(one).collect())
    few = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate([None, "", "é" * 10 + " ü", prose(1, 30_000), "x", "😀 y z"])], SCHEMA).repartition(5)
    check_pairs(in_order([(r.doc_id, r.text or "") for r in few.collect()]), in_order_rows(ws.with_following(few).collect()))
    plain = {r.doc_id: r for r in ws.fingerprints(few).collect()}
    assert all(plain[r.doc_id].fingerprint == r.fingerprint and plain[r.doc_id].n_chars == r.n_chars for r in ws.with_following(few).collect())


def test_likeness_in_sql(spark):
    docs = spark.createDataFrame([(i, prose(i % 3, 50) + (" more" * i), None, None, None) for i in range(6)] + [(9, "", None, None, None)], SCHEMA)
    f = ws.fingerprints(docs).select("doc_id", "fingerprint")
    pairs = f.crossJoin(f.select(F.col("doc_id").alias("other"), F.col("fingerprint").alias("g"))).withColumn("near", ws.likeness("fingerprint", "g")).collect()
    assert all(r.near == ws.likeness_of(bytes.fromhex(r.fingerprint), bytes.fromhex(r.g)) for r in pairs)


# ---------------------------------------------------------------- conversations

CONV = "conv_id long, turn long, role string, text string"


def plain_repair(rows):
    """Contract of the repair, by best suffixes of every state."""
    out = {}
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        hit = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        convs[c]
        if hit:
            text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
            convs[c] += [(turn, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)
    for c, r in convs.items():
        r.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        kinds, seen = [], set()
        for _, role, text in r:
            solid = re.findall(r"[^\x20\x09-\x0D]", text)
            kinds.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "fine")
            seen.add((role, text))
        far = (1 << 60, "")
        add = lambda p, a, x: (p + x[0], a + x[1])
        move = {"0s": "s", "0u": "u", "su": "u", "ua": "a", "au": "u"}
        free = {"0": "u", "s": "u", "u": "a", "a": "u"}

        def inserts(e):
            return {q: min(e[q], add(5, "I", e[free[q]]), add(10, "II", e[free[free[q]]])) for q in e}

        best = inserts({"0": (0, ""), "s": far, "u": far, "a": (0, "")})
        for (_, role, _), kind in list(zip(r, kinds))[::-1]:
            e = {}
            for q in best:
                ways = [add(2, "D", best[q])]
                if kind in ("fine", "truncated"):
                    more = 5 * (kind == "truncated")
                    ways.append(add(1 + more, "R", best[free[q]]))
                    if q + role[:1] in move and role:
                        ways.append(add(more, "K", best[move[q + role[:1]]]))
                e[q] = min(ways)
            best = inserts(e)
        cost, audit = best["0"]
        q, i, said = "0", 0, []
        for a in audit:
            if a == "I":
                q = free[q]
                said.append({"u": "user", "a": "assistant"}[q] + ":")
                continue
            _, role, text = r[i]
            i += 1
            if a == "K":
                q = move[q + role[:1]]
                said.append(f"{role}:{text}")
            elif a == "R":
                q = free[q]
                said.append({"u": "user", "a": "assistant"}[q] + f":{text}")
        turns = [t for t, _, _ in r if t is not None]
        ini = [x[1][:1] for x in r]
        out[c] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(ini, ini[1:])), cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest(),
        )
    return out


def random_rows(seed, convs, most):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        for k in range(rng.randint(1, most)):
            turn = rng.choice([None, k, k, k, k, k + 2, 1])
            rows.append((c, turn, rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None, "usher"]), rng.choice(["", " \n", "Yes.", "No", "Well! ", "ok?\t", "é.", None, f"unique {k}.", f"cut {k}", f"x{k}!"])))
    return rows


def compared(df, segment=repair.SEGMENT):
    got = repair.repaired(df, segment).collect()
    want = plain_repair([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
    assert len(got) == len(want)
    for r in got:
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) == want[r.conv_id], r


@pytest.mark.parametrize("segment", [1, 3, 1000])
def test_repairs_by_plain_dynamic_programming(spark, segment):
    """Short and long conversations, however they are cut and dealt."""
    rows = random_rows(segment, 60, 9) + [(500, *r[1:]) for r in random_rows(77, 1, 1)] + [(501 + i % 2, *r[1:]) for i, r in enumerate(random_rows(78, 40, 12))]
    compared(spark.createDataFrame(rows, CONV).repartition(5), segment)


def test_conversation_edges(spark):
    rows = random_rows(3, 8, 6)
    rows += [(None, t, r, x) for _, t, r, x in random_rows(4, 1, 12)] + [(90, None, None, None)] * 3 + [(91, 0, "user", "Same.")] * 40 + [(92, -5, "assistant", "Far."), (92, 7, "user", "x" * 50_000)]
    gone = next(i for i in range(1000, 2000) if zlib.crc32(f"{i}:1".encode()) % 20 == 0)
    rows.append((gone, 1, "user", "All dropped."))
    df = spark.createDataFrame(rows, CONV)
    compared(df)
    compared(df, 5)
    extra = df.withColumns({c: F.lit("x") for c in ("times", "earlier", "copy", "hit", "n", "part", "seq", "cost", "audit", "first", "every_", "is_blank")})
    assert sorted(map(str, repair.repaired(extra).collect())) == sorted(map(str, repair.repaired(df).collect()))
    assert repair.repaired(df.limit(0)).count() == 0
    empty = [r for r in repair.repaired(df).collect() if r.conv_id == gone][0]
    assert (empty.cost, empty.audit, empty.repaired_sha256) == (0, "", hashlib.sha256(b"").hexdigest())


def test_heuristic_is_admissible_and_search_small():
    """No node's bound is above the true rest, and faults of which each must be paid lead straight on."""
    rng = random.Random(8)
    for _ in range(200):
        n = rng.randint(0, 7)
        kinds, roles = [rng.randint(0, 3) for _ in range(n)], [rng.choice(["user", "assistant", "system", "x"]) for _ in range(n)]
        for i in range(n + 1):
            for enter in range(4):
                assert all(c >= sum(repair.CHARGE[k] for k in kinds[i:]) for c, _ in repair.search(kinds[i:], roles[i:], enter).values())
