"""Streams whose rows arrive out of order give what the batch forms give."""

import random

from pyspark.sql import functions as F

from cuelake.functions.times import WRAP
from cuelake.operators import audio, frames
from cuelake.streaming import events


def run(spark, df, path, name, build, files=4):
    """The rows, shuffled within two seconds and over files that are read one after another, then a row that moves the watermark on."""
    at = next(c for c in ("at_ms", "start_ms", "seq") if c in df.columns)
    rows = df.collect()
    r = random.Random(1)
    rows.sort(key=lambda x: x[at] + (r.randrange(2000) if at != "seq" else 0))
    parts = [rows[k * len(rows) // files : (k + 1) * len(rows) // files] for k in range(files)]
    last = {c: "end" if c == "stream_id" else True if c in ("speech", "is_key") else 1 << 40 if c == at else 1 << 41 if c == "end_ms" else 0 for c in df.columns}
    for part in [*parts, [tuple(last[c] for c in df.columns)]]:
        spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(str(path / name))
    stream = build(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(path / name)))
    stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return [x for x in spark.table(name).collect() if x.stream_id != "end"]


def test_unwrap(spark, tmp_path):
    pts = [(WRAP - 20_000 + 3000 * k) % WRAP for k in range(40)]
    pts[12], pts[13] = pts[13], WRAP - 500  # a late value from before the wrap
    df = spark.createDataFrame([(s, k, p, 1000 * k + 1000) for s in ("a", "b") for k, p in enumerate(pts)], "stream_id string, seq long, pts_90k long, at_ms long")
    got = run(spark, df, tmp_path, "unwrap", events.stream_unwrap_pts)
    expected = frames.unwrap_pts(df).collect()
    assert sorted((r.stream_id, r.seq, r.pts_unwrapped) for r in got) == sorted((r.stream_id, r.seq, r.pts_unwrapped) for r in expected)
    assert len({r.pts_unwrapped // WRAP for r in expected}) == 2


def test_speech(spark, tmp_path):
    r = random.Random(2)
    rows = [(s, k * 100 + 1000, k * 100 + 1100, (k // 17 + (s == "b")) % 3 > 0 if r.random() < 0.97 else None) for s in ("a", "b") for k in range(400)]
    df = spark.createDataFrame(rows, "stream_id string, start_ms long, end_ms long, speech boolean")
    settings = {"hangover_ms": 700, "young_ms": 6000}
    got = run(spark, df, tmp_path, "speech", lambda s: events.stream_speech_intervals(s, **settings))
    expected = audio.speech_intervals(df, **settings).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, expected)) and len(expected) > 10


def test_outages(spark, tmp_path):
    r, rows = random.Random(3), []
    for s in ("a", "b"):
        at = 1000
        for _ in range(150):
            at += r.choice([200, 300, 400, 1500, 4000])
            rows.append((s, at, r.random() < 0.4))
    df = spark.createDataFrame(rows, "stream_id string, at_ms long, is_key boolean")
    got = run(spark, df, tmp_path, "outages", lambda s: events.stream_outages(s, 1000))
    expected = [tuple(x) for x in audio.outages(df, 1000).collect()]
    ended = [tuple(x) for x in got if x.end_ms is not None]
    assert sorted(ended) == sorted(x for x in expected if x[2] is not None) and len(ended) > 20
    begun = {(x.stream_id, x.start_ms) for x in got if x.end_ms is None}
    assert begun >= {(x[0], x[1]) for x in expected}  # and the one that begins after the last row


def test_display_order(spark, tmp_path):
    order = [0, 4, 2, 1, 3]  # decoded before shown
    rows = [("s", n, k, 3000 * (5 * (k // 5) + order[k % 5])) for n in (0, 1) for k in range(50)]
    df = spark.createDataFrame(rows, "stream_id string, session long, seq long, pts_90k long")
    got = run(spark, df, tmp_path, "display", lambda s: events.stream_display_order(s, depth=4, idle_ms=None))
    expected = {(r.session, r.seq): r["rank"] for r in frames.display_order(df).collect()}
    assert {(r.session, r.seq): r["rank"] for r in got} == {k: v for k, v in expected.items() if v < 46}  # the last four are held
