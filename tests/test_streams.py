"""The streaming forms give what the batch forms give."""

import json

from pyspark.sql import functions as F

from cuelake.operators import cues, guard, lanes
from cuelake.streaming import machines


def run(spark, df, path, name, build):
    df.coalesce(1).write.parquet(str(path / name))
    stream = build(spark.readStream.schema(df.schema).parquet(str(path / name)))
    stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


def test_cues(spark, tmp_path):
    lines = spark.createDataFrame([("s", "en", i, None if i == 5 else f"line {i}", i % 2 == 0, i * 100_000) for i in range(12)], "stream_id string, lang string, seq long, text string, new_row boolean, due long")
    got = run(spark, lines, tmp_path, "stream_cues", lambda s: machines.stream_cues(s, idle_ms=None))
    key = lambda r: (r.start, r.end, r.text)
    batch = sorted(map(key, cues.cue_track(lines).collect()))
    assert sorted(map(key, got.collect())) == batch[:-1] and len(batch) > 5  # the last cue is still open


def test_loops(spark, tmp_path):
    words = spark.createDataFrame([("s", i, w, i * 300, i * 300 + 200, i // 4 * 1200 + 1260) for i, w in enumerate("a b no no no no no c d x y x y x y z".split())], "stream_id string, seq long, text string, start_ms long, end_ms long, arrival_ms long")
    got = run(spark, words, tmp_path, "stream_loops", machines.stream_prune_loops)
    assert sorted(r.seq for r in got.collect()) == sorted(r.seq for r in guard.prune_loops(words).collect())


def test_shedding(spark, tmp_path):
    lags = [("s", t * 1000, {"de": 5000 if t < 8 else 100, "fr": 4500 if t < 8 else 100}) for t in range(30)]
    snapshots = spark.createDataFrame([(s, t, json.dumps(x)) for s, t, x in lags], "stream_id string, at_ms long, lags string")
    got = run(spark, snapshots, tmp_path, "stream_shedding", lambda s: machines.stream_shedding(s, ["de", "fr"], "en", 4000))
    long = spark.createDataFrame([(s, t, k, v) for s, t, x in lags for k, v in x.items()], "stream_id string, at_ms long, lang string, lag_ms long")
    languages = spark.createDataFrame([("en", True, 0, 0), ("fr", False, 1, 1), ("de", False, 2, 2)], "code string, source boolean, priority int, position int")
    key = lambda r: (r.changed_ms, r.lang, r.paused)
    batch = sorted(map(key, lanes.degrade_policy(long, languages, 4000).collect()))
    assert sorted(map(key, got.collect())) == batch and len(batch) >= 3


def test_late_translations(spark, tmp_path):
    clauses = spark.createDataFrame([("s", i, 1_700_000_000 + i) for i in range(3)], "stream_id string, id long, at long").withColumn("closed_ts", F.timestamp_seconds("at"))
    clauses.coalesce(1).write.parquet(str(tmp_path / "c"))
    texts = spark.createDataFrame([("s", 0, "de", "x", 1_700_000_002), ("s", 1, "de", "y", 1_700_000_030)], "stream_id string, clause_id long, lang string, text string, at long").withColumn("arrival_ts", F.timestamp_seconds("at"))
    texts.coalesce(1).write.parquet(str(tmp_path / "t"))
    read = lambda df, p: spark.readStream.schema(df.schema).parquet(str(tmp_path / p))
    joined = machines.stream_translations(read(clauses, "c"), read(texts, "t"))
    joined.writeStream.format("memory").queryName("stream_translations").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert ("s", 0, "x") in [(r.stream_id, r.id, r.text) for r in spark.table("stream_translations").collect()]
