"""The words of more text are dealt over more tasks."""

from cuelake.plans import captions, tables


def test_tasks_grow_with_the_text(spark, tmp_path, monkeypatch):
    rows = [(c, t, f"w{c} " * 50) for c in range(40) for t in range(5)]
    spark.createDataFrame(rows, "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    few = tables.words(spark, str(tmp_path))
    assert few.rdd.getNumPartitions() == 4
    monkeypatch.setattr(tables, "TASK_BYTES", 1000)
    size = sum(len(t) for *_, t in rows)
    many = tables.words(spark, str(tmp_path))
    assert many.rdd.getNumPartitions() == tables.word_tasks(spark, str(tmp_path)) == -(-size // 1000)
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, few.collect()))
    assert captions.emission_tails(spark, str(tmp_path)).rdd.getNumPartitions() == -(-size // 1000)
    ends = captions.segment_ends(spark, str(tmp_path))
    monkeypatch.undo()
    assert sorted(map(tuple, ends.collect())) == sorted(map(tuple, captions.segment_ends(spark, str(tmp_path)).collect()))
