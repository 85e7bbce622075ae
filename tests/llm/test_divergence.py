"""Source divergence against its SQL and against plain sums."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cuelake.llm import divergence


def test_tree_corrections():
    """Shared paths give the same sums as all pairs of all rows."""
    r, base = random.Random(2), {k: 100 + k for k in range(6)}
    rows = [tuple((k, r.choice([200, 300, 500]), base[k]) for k in range(6) if r.random() < 0.6) for _ in range(300)]
    tree, expected = divergence.Tree(), Counter()
    for path, times in sorted(Counter(rows).items()):
        tree.insert(list(path), times)
    for path in rows:
        for i, (a, p, u) in enumerate(path):
            for b, q, v in path[i + 1 :]:
                expected[a, b] += abs(p - q) - abs(p - v) - abs(u - q) + abs(u - v)
    a, b, value = tree.totals()
    assert dict(zip(zip(a.tolist(), b.tolist()), value.tolist())) == dict(expected)
    assert len(tree.source) < sum(map(len, rows)) and tree.rows[0] > 1
    assert [len(x) for x in divergence.Tree().totals()] == [0, 0, 0]


@pytest.mark.parametrize("size", [3, 10, 1 << 20])
def test_term_counts(monkeypatch, size):
    monkeypatch.setattr(divergence, "SLICE", size)
    assert divergence.term_counts("The the-THE é1É x\x7fy longer-than-ten-bytes muchlongerthantenbytes é".encode()) == {b"the": 3, "é".encode(): 2, "É".encode(): 1, b"x": 1, b"y": 1, b"longer": 1, b"than": 1, b"ten": 1, b"bytes": 1, b"muchlongerthantenbytes": 1}
    assert divergence.term_counts(b"") == {} and divergence.term_counts(b"12 .;") == {}


def test_against_sql_on_odd_rows(spark, make_docs, tmp_path):
    import duckdb

    r, words = random.Random(4), "alpha Beta gamma été DELTA eta".split()
    texts = [None, "", "12 34", "alpha " * 40_000] + [" ".join(r.choices(words, [5, 4, 3, 2, 2, 1 + k % 4], k=r.randint(1, 30))) for k in range(400)]
    docs = make_docs(texts).withColumn("source", F.when(F.col("doc_id") % 7 > 0, F.concat(F.lit("s"), F.col("doc_id") % 7)))
    docs = docs.withColumn("lang", F.when(F.col("doc_id") % 3 == 0, "en").when(F.col("doc_id") < 9, "rare").otherwise(None)).withColumn("value", F.lit("mine"))
    docs = docs.unionByName(docs.filter("doc_id > 380"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = divergence.op12_source_divergence(spark, str(tmp_path))
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    columns = ["lang", "source", "part", "item", "value", "rank"]
    expected = db.sql(divergence.OP12_SQL).project(", ".join(columns)).fetchall()
    rows = [tuple(x) for x in found.select(*columns).collect()]
    assert sorted(rows) == sorted(expected)
    assert {x[0] for x in rows} == {"", "en", "rare"} and all(x[4] == 0 for x in rows if x[0] == "rare")
    assert any(x[1] == "" for x in rows) and max(x[5] for x in rows if x[2] == "pair") == 6


def test_empty_table(make_docs):
    assert divergence.source_divergence(make_docs([])).count() == 0
