"""Jaccard join against its SQL and brute force, and its filters on random sets."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cuelake.llm import jaccard


def shingles(text, size=3):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(w)} if 0 < len(w) < size else {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def components(texts, percent=90):
    sets, up = [shingles(t) for t in texts], list(range(len(texts)))
    links = {(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])}
    for _ in texts:
        for i, j in links:
            up[i] = up[j] = min(up[i], up[j])
    return sets, up, links


def family(r, words, n, copies, edits):
    base = [r.choice(words) for _ in range(n)]
    out = []
    for _ in range(copies):
        w = list(base)
        for _ in range(r.randint(0, edits)):
            w[r.randrange(n)] = r.choice(words)
        out.append(" ".join(w))
    return out


WORDS = [a + b for a in "bcdfghklmnprst" for b in ("a", "e", "io", "ur", "an", "el")]
ODD = [None, "", " \n", "a", "A", "a b", "a  B", "a b c", "b c", "x" * 20_000, "p q r " * 2000, "same row here", "same row here"]


def corpus(seed):
    r = random.Random(seed)
    texts = list(ODD)
    for k in range(12):
        texts += family(r, WORDS, r.choice([12, 40, 150, 400]), r.randint(2, 12), 3)
    texts += [" ".join(r.choices(WORDS, k=r.randint(1, 60))) + " a common passage that many documents share" for _ in range(60)]
    return texts


def test_against_brute_force_and_sql(spark, make_docs, tmp_path):
    import duckdb

    texts = corpus(1)
    sets, up, links = components(texts)
    docs = make_docs(texts)
    docs.withColumns({"node": F.lit("mine"), "key": F.lit(1), "n": F.lit(None).cast("int")}).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in jaccard.op11_jaccard_join(spark, str(tmp_path)).collect()}
    assert len(rows) == len(texts) and len(links) > 100
    for i in range(len(texts)):
        assert (rows[i].n_shingles, rows[i].component_id) == (len(sets[i]), up[i]), (i, texts[i][:80] if texts[i] else None)
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    sql = db.sql(jaccard.OP11_SQL).project("doc_id, n_shingles, component_id").fetchall()
    assert sorted(sql) == sorted((r.doc_id, r.n_shingles, r.component_id) for r in rows.values())


@pytest.mark.parametrize("percent,stars", [(90, 0), (70, 1)])
def test_without_stars_and_at_other_similarity(make_docs, percent, stars):
    texts = corpus(2)
    _, up, _ = components(texts, percent)
    found = {r.doc_id: r.component_id for r in jaccard.jaccard_components(make_docs(texts), percent=percent, stars=stars).collect()}
    assert [found[i] for i in range(len(texts))] == up


def test_null_and_repeated_keys(spark, make_docs):
    rows = [(None, "one two three four"), (5, "one two three four"), (3, "quite another text here"), (3, "one two three four"), (None, "nobody else has this"), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = jaccard.jaccard_components(docs)
    assert sorted(map(str, out.collect())) == sorted(map(str, spark.createDataFrame([(None, 2, 3), (5, 2, 3), (3, 2, 3), (3, 2, 3), (None, 2, None), (None, 0, None)], out.schema).collect()))
    assert jaccard.jaccard_components(make_docs([])).count() == 0


def rows(n, pos=None, left=None, bits=None, part=None, chunk=None):
    k, zero = len(n), lambda x: np.zeros(len(n), np.int64) if x is None else np.array(x)
    return {"n": np.array(n), "pos": zero(pos), "left": np.ascontiguousarray(zero(left)).view(np.uint8).reshape(k, 8), "bits": np.zeros((k, 4), np.uint64) if bits is None else np.stack(bits), "part": zero(part), "chunk": zero(chunk)}


def test_filters_lose_no_link():
    """For every two sets that are alike, the first shared n-gram of both prefixes passes all filters."""
    r, classes = random.Random(3), np.random.default_rng(3).integers(0, 4, 1 << 8).astype(np.uint8)
    met = 0
    for _ in range(400):
        n, percent = r.randint(1, 80), r.choice([70, 80, 90, 100])
        x = {r.getrandbits(64) for _ in range(n)}
        y = set(x)
        for _ in range(r.randint(0, n // 6)):
            y.discard(r.choice(sorted(y)))
            y.add(r.getrandbits(64)) if r.random() < 0.5 else None
        if not y or 100 * len(x & y) < percent * len(x | y):
            continue
        (a, left_a), (b, left_b) = (jaccard.prefix(np.array(sorted(s), np.uint64), classes, percent) for s in (x, y))
        shared = next(g for g in a if g in set(b.tolist()))
        i, j = a.tolist().index(shared), b.tolist().index(shared)
        u, v = (jaccard.signature(np.array(sorted(t), np.uint64)) for t in (x, y))
        bits = [np.frombuffer(jaccard.folded(np.frombuffer(t, np.uint8), 32).tobytes(), np.uint64) for t in (u, v)]
        pair = rows(n=[len(x), len(y)], pos=[i, j], left=[left_a[i], left_b[j]], bits=bits, part=[1, 2])
        assert len(jaccard.block_pairs(pair, percent)[0]) == len(jaccard.small_pairs(pair, np.zeros(2, np.int64), percent)[0]) == 1
        assert jaccard.signatures_apart(u, v) <= len(x ^ y)
        met += 1
    assert met > 100


def test_strange_long_sets_are_no_candidates(spark):
    """Sets of 3,000 that share one n-gram aren't put out as pairs; alike ones are."""
    g = np.random.default_rng(7)
    sets = [np.sort(g.integers(0, 1 << 64, 3000, dtype=np.uint64)) for _ in range(12)]
    sets.append(np.sort(np.concatenate((sets[0][30:], g.integers(0, 1 << 64, 30, dtype=np.uint64)))))
    df = spark.createDataFrame([(1, k, 3000, 0, -1, k) for k in range(13)], "gram long, node long, n long, pos long, left long, part long")
    signatures = spark.createDataFrame([(k, bytearray(jaccard.signature(s))) for k, s in enumerate(sets)], "node long, signature binary")
    assert [(r.u, r.v) for r in jaccard._rest(df, signatures, 90).collect()] == [(0, 12)]


def test_left_over_classes_meet_the_largest_component(spark):
    """Sixty classes that share an n-gram with a component of three, in a later star round: all meet the component, not one another."""
    df = spark.createDataFrame([(1, k, 50, 0, 0, min(k, 60), 3 if k >= 60 else 1) for k in range(63)], "gram long, node long, n long, pos long, left long, part long, size long")
    for k in (1, 2):
        found = [(r.u, r.v) for r in jaccard._stars(df, k, 90).collect()]
        assert sorted(u for u, _ in found) == list(range(60)) and {v >= 60 for _, v in found} == {True}


def test_blocks_meet_every_pair_of_components():
    """Chunks and their pairs together give the pairs of one block."""
    g = np.random.default_rng(5)
    part, chunk, found = g.integers(0, 9, 60), g.integers(0, 4, 60), set()
    expected = {frozenset((i, j)) for i in range(60) for j in range(i) if part[i] != part[j]}
    pairs = lambda i, j, at: {frozenset((int(at[x]), int(at[y]))) for x, y in zip(i, j)}
    assert pairs(*jaccard.block_pairs(rows([50] * 60, part=part), 90), range(60)) == expected
    for a in range(4):
        for b in range(a, 4):
            at = np.flatnonzero((chunk == a) | (chunk == b))
            found |= pairs(*jaccard.block_pairs(rows([50] * len(at), part=part[at], chunk=chunk[at]), 90), at)
    assert found == expected
    block = np.repeat(np.arange(10), 6)
    within = {p for p in expected if len({block[i] for i in p}) == 1 and 3 not in {block[i] for i in p}}
    assert pairs(*jaccard.small_pairs(rows([50] * 60, part=part), np.where(block == 3, -1, block), 90), range(60)) == within


def test_hot_grams_are_cut_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    df = spark.createDataFrame([(1, k, 50, 0, 0, 0 if k < 40 else k) for k in range(70)], "gram long, node long, n long, pos long, left long, part long")
    signatures = spark.createDataFrame([(k, bytearray(64)) for k in range(70)], "node long, signature binary")
    found = {(r.u, r.v) for r in jaccard._rest(df, signatures, 90).collect()}
    assert found == {(u, v) for v in range(40, 70) for u in range(v)}


def test_shingle_sets_of_short_texts():
    sets = [s.tolist() for s in jaccard.shingle_sets(pa.array([b"a", b"A", b"a b", b"a  b", b"a b c", b"", None, b"b a"]), 3)]
    assert sets[0] == sets[1] and sets[2] == sets[3] and [len(s) for s in sets] == [1, 1, 1, 1, 1, 0, 0, 1]
    assert len({tuple(s) for s in sets}) == 5
