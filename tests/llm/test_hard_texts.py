"""Texts made to defeat hashes and scanners: words after the Thue-Morse sequence, and very long runs."""

import time

import numpy as np
import pytest

from skyframe.llm import common, jaccard_join, pii_crf, registry, substring_dedup

from ..conftest import canonical
from .helpers import SCHEMA, prose


def thue_morse(n):
    s = "a"
    while len(s) < n:
        s += s.translate({97: 98, 98: 97})
    return s[:n], s[:n].translate({97: 98, 98: 97})


@pytest.mark.parametrize("n", [512, 1024, 2048, 4096, 1 << 17])
def test_words_that_agree_modulo_powers_of_two(n):
    for lower in (False, True):
        h, _ = common.hash_words([x.encode() for x in thue_morse(n)] + [thue_morse(n)[0].upper().encode()], lower)
        assert len(set(h.tolist())) == (2 if lower else 3)


def test_hash_of_a_word_is_that_of_the_word_alone():
    """Whatever stands around it, in spans of any length."""
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcXYZ0é"), rng.integers(1, 30))) for _ in range(400)] + ["x" * 5_000_000, "x" * 5_000_001]
    alone = {w: common.hash_words([w.encode()])[0][0] for w in words}
    assert len(set(alone.values())) == len(set(words))
    order = [words[i] for i in rng.permutation(len(words))]
    assert common.hash_words([" ".join(order).encode()])[0].tolist() == [alone[w] for w in order]


@pytest.fixture(scope="module")
def forged(spark, tmp_path_factory):
    """Pairs of documents that differ in one such word, in windows and in shingles, and documents of nothing else."""
    rows = []
    for k, n in enumerate((1024, 2048, 4096)):
        a, b = thue_morse(n)
        left, right = prose(k, 60), prose(10 + k, 60)
        rows += [f"{left} {a} {right}", f"{left} {b} {right}"]
        odd = prose(20 + k, 160).split()
        for w in (a, b):
            rows.append(" ".join(x for i in range(0, 160, 4) for x in (*odd[i : i + 4], w)))
        rows += [" ".join([a] * 60), " ".join([b] * 60), a, b]
    d = str(tmp_path_factory.mktemp("forged"))
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(rows)], SCHEMA).write.parquet(f"{d}/documents.parquet")
    return d


@pytest.mark.parametrize("name", ["op2_substring_dedup", "op4_ngram_jaccard_join"])
def test_forged_words_against_sql(spark, forged, name):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{forged}/documents.parquet/*.parquet'")
    got, want = canonical(registry.QUERIES[name](spark, forged).toPandas()), canonical(con.sql(registry.ORACLES[name]).df())
    assert got == want


def test_one_forged_word_is_kept(spark):
    a, b = thue_morse(1024)
    x, y = prose(1, 60), prose(2, 60)
    docs = spark.createDataFrame([(1, f"{x} {a} {y}", None, None, None), (2, f"{x} {b} {y}", None, None, None)], SCHEMA)
    assert {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(docs).collect()} == {1: 0, 2: 120}
    sets = [" ".join(prose(30 + k, 4) + " " + (a, b)[j] for k in range(10 * j, 10 * j + 10)) for j in (0, 1)]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(sets)], SCHEMA)
    assert {r.component_id for r in jaccard_join.similarity_components(docs).collect()} == {0, 1}


LONG = {
    "letters": "a@b.c " + "x" * 5_000_000,
    "base64": "mail a@b.c " + "QUJDREVGR0hJSktMTU5PUFFSU1RVVldYWVo" * 30_000,
    "digits": "a@b.c " + "7" * 1_000_000 + " 10.0.0.1",
    "dotted": "1." * 500_000 + "a@b.c",
    "ats": "a@b.c " + "@" * 1_000_000,
    "opened": "a@b.c " + "(1" * 300_000,
    "plus": "+1" * 500_000 + " a@b.c 1.2",
}


@pytest.mark.parametrize("name", sorted(LONG))
def test_long_runs_take_linear_time(name):
    began = time.process_time()
    (base,), _ = pii_crf.label_texts([LONG[name]], pii_crf.Field())
    assert time.process_time() - began < 15 and any(k == 0 for k, _, _ in base)


def test_long_runs_are_redacted(spark):
    docs = spark.createDataFrame([(i, LONG[n], None, None, None) for i, n in enumerate(("base64", "digits", "ats"))], SCHEMA)
    got = {r.doc_id: r.text for r in pii_crf.redact(docs).collect()}
    assert all("a@b.c" not in t and "[EMAIL]" in t for t in got.values()) and got[1].endswith("[IP]")


def test_marginals_do_not_depend_on_the_texts_beside():
    rng = np.random.default_rng(6)
    field = pii_crf.Field()
    field.node, field.link, field.same = rng.normal(0, 1, field.node.shape), rng.normal(0, 1, field.link.shape), np.array(1.5)
    bits = ["+49 30 1234567", "10.0.0.1", "a@b.c", "x@y", "1234 5678", "555-0100", "A@B.C", "call", "4111 1111 1111 1111"]
    texts = [" ".join(rng.choice(bits, rng.integers(1, 40))) for _ in range(60)]

    def marginals(some):
        g = pii_crf.Graph()
        for i, t in enumerate(some):
            g.add(i, t, pii_crf.base_spans(t))
        p, _, _ = field.beliefs(np.array(g.feature), pii_crf._edges(g.chain), pii_crf._edges(g.skip), np.array([x for x, _, _ in g.place]))
        return [p[[k for k, place in enumerate(g.place) if place[0] == i]] for i in range(len(some))]

    for t, p in zip(texts, marginals(texts)):
        assert np.abs(marginals([t])[0] - p).max(initial=0) < 1e-12


def test_prefixes_keep_every_link():
    """Two sets within the bound share one of their rarest tokens, whatever is popular and whatever their sizes."""
    rng = np.random.default_rng(9)
    for trial in range(400):
        n = int(rng.integers(1, 260))
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
        drop = int(rng.integers(0, n // 4 + 1))
        add = int(rng.integers(0, max(1, (n // 3 - drop) + 1)))
        b = np.concatenate([a[drop:], rng.integers(0, 1 << 63, add, dtype=np.uint64)])
        a, b = common.distinct(a), common.distinct(b)
        if len(b) and 7 * len(np.intersect1d(a, b)) >= 3 * (len(a) + len(b)):
            cut = rng.integers(1, 1 << 62)
            x, y = jaccard_join.prefixes(a, a > cut), jaccard_join.prefixes(b, b > cut)
            key, i, j = np.intersect1d(x >> jaccard_join.SIDE, y >> jaccard_join.SIDE, return_indices=True)
            sides = {frozenset(p) for p in zip((x[i] & np.uint64(6)).tolist(), (y[j] & np.uint64(6)).tolist())}
            assert sides & {frozenset([0]), frozenset([2, 4])}


def template(n, shared, words=200, spread=1):
    """Pages of a template and ``words - shared`` own words, or up to ``spread`` times as many."""
    own = words - shared
    head = prose(800 + shared, shared)
    return [f"{head} " + " ".join(f"w{k}x{i}" for i in range(own + (own * (spread - 1) * (k % 7)) // 7)) for k in range(n)]


@pytest.mark.parametrize("spread", [1, 3])
@pytest.mark.parametrize("shared", [120, 160, 164])
def test_pages_of_a_template_never_meet(spark, shared, spread):
    """A template with own words from 18 per cent: the second index makes no pair at all, at any number of pages."""
    for n in (500, 1000):
        docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(template(n, shared, spread=spread))], SCHEMA).repartition(4)
        again = common.text_bytes(docs).selectExpr("text", "md5(text) as root")
        pairs = jaccard_join._candidates(again, 4, jaccard_join._popular(again, 4, jaccard_join.SMALL_BUCKET + 1), rarest=True)
        assert pairs.count() == 0


def test_templates_and_their_copies(spark, monkeypatch):
    """Pages of a template stay apart; near copies among them are found, and no block is compared."""
    rows = template(700, 165)
    for k in range(0, 60, 3):
        w = rows[k].split()
        w[30] = "changed"
        w[190] = f"also{k}"
        rows.append(" ".join(w))
    rows = [(i, t, None, None, None) for i, t in enumerate(rows)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)

    def never(*_):
        raise AssertionError("blocks")

    monkeypatch.setattr(jaccard_join, "_blocks", never)
    got = {r.doc_id: r.component_id for r in jaccard_join.similarity_components(docs).collect()}
    assert got == {i: i if i < 700 else 3 * (i - 700) for i in range(len(rows))}
