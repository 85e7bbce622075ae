import os

import pytest

SF = "/root/testdata/sf0.001"
#: Columns with names that the stages use themselves, and their values.
CLASHING = {"kept": "mine", "fp": 1, "taken": 2, "size": -3, "shard": 4, "words": "w", "component_id": 6, "n_words": -7, "n_lines": 8, "base_failed": "no", "word_chars": 9, "source_size": 10, "target": 11, "first_finish": 12}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages_against_brute_force(spark):
    import corpus_pipeline
    from cuelake.llm import common
    from tests.llm.test_small import brute_items

    docs, kept = common.documents(spark, SF), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, common.materialize(stage(spark, docs, SF), name)
        kept[name] = {r.doc_id for r in docs.collect()}
        assert kept[name] <= {r.doc_id for r in before.collect()}
        if name == "simhash_near_duplicates":
            groups = corpus_pipeline.simhash.near_duplicates(before).collect()
            assert kept[name] == {r.component_id for r in groups}
        if name == "benchmark_decontamination":
            items = [(r.item_id, r.text) for r in common.documents(spark, SF, "benchmark").collect()]
            assert kept[name] == {r.doc_id for r in before.collect() if not brute_items(r.text, items)[1]}
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    counts = [r["count"] for r in docs.groupBy("shard").count().collect()]
    assert max(counts) - min(counts) <= 1 and sum(counts) == before.count()
    labels = {r.doc_id: r.quality for r in common.documents(spark, SF, "labels").collect()}
    good = [i for i, q in labels.items() if q == 1]
    assert len([i for i in good if i in kept["quality_rules"]]) > 0.85 * len(good)


def test_rows_are_decided_one_by_one(spark, tmp_path):
    """Rows without a doc_id and rows that share one with another text."""
    import corpus_pipeline
    from tests.llm.conftest import DOCS
    from tests.llm.test_small import prose

    a, b, c, d, item = (prose(120, 900 + k) for k in range(5))
    rows = [(None, a), (None, a), (3, a), (None, b), (None, b), (7, c), (7, d), (8, d), (None, c + " " + item), (9, d + " " + item), (9, b)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS)
    kept = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs.limit(8), "").collect()), key=str)
    assert kept == sorted([(3, a), (None, b), (7, c), (7, d)], key=str)
    spark.createDataFrame([(None, item), (1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.decontaminated(spark, docs, str(tmp_path)).collect()]
    assert sorted(kept, key=str) == sorted([x for x in rows if item not in x[1]], key=str)
    found = corpus_pipeline.decontaminate.find_items(docs, corpus_pipeline.documents(spark, str(tmp_path), "benchmark"))
    assert sorted(map(str, found.filter("size(spans) > 0").first()["items"])) == ["1", "None"]


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls in any column, empty and long texts, repeated rows, an empty table, and columns with clashing names."""
    import corpus_pipeline
    from pyspark.sql import functions as F
    from tests.llm.conftest import DOCS
    from tests.llm.test_small import prose

    spark.createDataFrame([(1, prose(30, 1)), (None, None), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = [None, "", "   ", prose(60, 50), prose(60, 50), prose(9000, 51), prose(60, 52) + " " + prose(30, 1), *[prose(80, 60 + k) for k in range(12)]]
    rows = [(None if k % 5 == 4 else k, t, None if k % 7 == 6 else "en", None if k % 4 == 3 else "s", None) for k, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[3]], DOCS).withColumns({c: F.lit(v) for c, v in CLASHING.items()})
    left = {"quality_rules": 17, "simhash_near_duplicates": 16, "benchmark_decontamination": 19, "consistent_hash_shards": 20}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert set(docs.columns) <= set(out.columns), name
        if name in left:
            assert out.count() == left[name], name
        else:
            assert {r.text for r in out.collect()} <= {r.text for r in docs.collect()}
        own = {"shard"} if name == "consistent_hash_shards" else set()  # the last stage's own column
        values = out.select(*[c for c in CLASHING if c not in own]).distinct().collect()
        assert [r.asDict() for r in values] == [{c: v for c, v in CLASHING.items() if c not in own}], name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
