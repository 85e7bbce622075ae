"""Periodic runs against brute force, and word hashes against Python's words."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cuelake.llm import periodic
from cuelake.llm import words as hashed


def brute(w, least=24, times=3):
    n, out = len(w), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                out.setdefault((i, j + q - i), q)
            i = max(j, i) + 1
    return sorted((s, n, q) for (s, n), q in out.items())


def stretch(r, n, letters):
    w = []
    while len(w) < n:
        w += [r.randrange(letters) for _ in range(r.randint(1, 9))] * (r.randint(1, 6) if r.random() < 0.4 else 1)
    return w[:n]


@pytest.mark.parametrize("least,times", [(24, 3), (6, 3), (4, 2), (9, 2), (12, 4)])
def test_runs_are_those_of_brute_force(least, times):
    r, hits = random.Random(least * times), 0
    for _ in range(500):
        w = stretch(r, r.randint(1, 120), r.choice([1, 2, 3, 5]))
        expected = brute(w, least, times)
        hits += len(expected)
        assert periodic.find_runs(np.array(w, np.uint64), least, times) == expected
    assert hits > 100


def test_long_sets_are_split_in_blocks():
    w = np.zeros(5000, np.uint64)
    assert periodic.find_runs(w) == [(0, 5000, 1)]
    assert periodic.find_runs(np.arange(9000, dtype=np.uint64) % 2) == [(0, 9000, 2)]


def test_hashes_that_clash_are_found_out():
    text = b" ".join([b"a", b"b"] * 30)
    found, words = periodic.runs_of(text, np.zeros(60, np.uint64), 24, 3)
    assert found == [(0, 60, 2)] and len(words) == 60


@pytest.mark.parametrize("size", [7, 64, 1 << 20])
def test_hash_words(monkeypatch, size):
    monkeypatch.setattr(hashed, "SLICE", size)
    r, ids = random.Random(1), {}
    texts = [None, b"", b" \t\n", b"a", b"a b", b"x y z " * 20, b"xyz" * 50, " é ü x ñ ".encode(), b"  lead", b"trail  ", *(bytes(r.choice(b"ab \n") for _ in range(r.randint(0, 200))) for _ in range(100))]
    h, bounds = hashed.hash_words(pa.array(texts, pa.binary()))
    for i, t in enumerate(texts):
        own = (t or b"").split()
        assert len(own) == bounds[i + 1] - bounds[i]
        for w, x in zip(own, h[bounds[i] : bounds[i + 1]].tolist()):
            assert ids.setdefault(w, x) == x
    assert len(set(ids.values())) == len(ids)
    h, bounds = hashed.hash_words(pa.array([b"Ab aB", b"ab \xc3\x84 \xc3\xa4"]), lower=True)
    assert h[0] == h[1] == h[2] and h[3] != h[4]
    assert hashed.hash_words(pa.array([], pa.binary()))[1].tolist() == [0]


ODD = [None, "", " \t\n", "a", "a b " * 30, "x" * 30_000, " ".join("abc"[i % 3] for i in range(60_000)), "p q r s t u " * 4 + "z " * 25, "same row " * 20, "same row " * 20]


def test_periodic_runs_on_odd_rows(make_docs):
    docs = make_docs(ODD).withColumns({"runs": F.lit("mine"), "extra": F.lit(7)})
    out = periodic.periodic_runs(docs, ["doc_id", "extra", "runs"])
    assert out.columns == ["doc_id", "extra", "n_words", "runs", "collapsed"]
    found = {r.doc_id: r for r in out.collect()}
    for i, t in enumerate(ODD):
        w = (t or "").split()
        runs = brute(w) if len(w) < 5000 else [(0, 60_000, 3)]
        drop = {k for s, n, q in runs for k in range(s + q, s + n)}
        assert [tuple(x) for x in found[i].runs] == runs
        assert found[i].collapsed == " ".join(x for k, x in enumerate(w) if k not in drop) and found[i].n_words == len(w)
    assert periodic.periodic_runs(docs.filter("false"), ["doc_id"]).count() == 0
    with pytest.raises(ValueError):
        periodic.periodic_runs(docs, ["doc_id"], times=1)


def test_query_against_brute_force(spark, make_docs, tmp_path):
    r = random.Random(3)
    texts = [*ODD, *("\n ".join(str(x) for x in stretch(r, r.randint(0, 150), 2000 if k % 2 else 3)) for k in range(300))]
    make_docs(texts).unionByName(make_docs(["a " * 30]).withColumn("doc_id", F.lit(None).cast("long"))).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {x.doc_id: x for x in periodic.op13_periodic_runs(spark, str(tmp_path)).collect()}
    assert len(rows) == len(texts) + 1 and (rows[None].n_runs, rows[None].length, rows[None].exponent_milli) == (1, 30, 30_000)
    changed = 0
    for i, t in enumerate(texts):
        w, h = (t or "").split(), zlib.crc32(str(i).encode())
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
            changed += 1
        runs = brute(w) if n < 5000 else [(0, 60_000, 3)]
        drop = {k for s, m, q in runs for k in range(s + q, s + m)}
        best = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=None)
        x = rows[i]
        assert (x.n_runs, x.start, x.length, x.period) == ((len(runs), *best) if best else (0, None, None, None)), i
        assert x.exponent_milli == (1000 * best[1] // best[2] if best else None)
        assert x.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert x.collapsed_sha256 == hashlib.sha256(" ".join(v for k, v in enumerate(w) if k not in drop).encode()).hexdigest()
    assert changed > 15
