"""Streams cut into blocks and islands give what one machine in order gives."""

import random

import pytest
from pyspark.sql import functions as F

from cuelake.functions.times import TICKS, WRAP
from cuelake.operators import audio, cues, frames, guard, hot
from cuelake.operators.guard import admit


def test_scans_against_plain_loops(spark):
    r = random.Random(1)
    rows = [(k, i, r.choice([None, r.randrange(-9, 9)])) for k in ("hot", "cold", None) for i in range(400 if k == "hot" else 7)]
    df = spark.createDataFrame(rows, "k string, i long, v long").repartition(3)
    found = {(x.k, x.i): (x.s, x.m, x.l) for x in hot.scanned(df, ["k"], ["i"], {"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "l": ("last", F.col("v"))}, 9).collect()}
    seen: dict = {}
    for k, i, v in rows:
        past = seen.setdefault(k, [])
        assert found[k, i] == (sum(past) + (v or 0), max(past, default=None), past[-1] if past else None), (k, i)
        past += [] if v is None else [v]
    assert hot.scanned(df.limit(0), ["k"], ["i"], {"s": ("sum", F.col("v"))}).count() == 0


def test_one_stream_is_many_tasks(spark):
    """A stream is cut into blocks, and its islands go to different tasks."""
    df = spark.range(20_000).select(F.lit("one").alias("k"), "id")
    blocks = hot.scanned(df, ["k"], ["id"], {"s": ("sum", F.lit(1))}, 8)
    assert {x.s - x.id for x in blocks.collect()} == {1}

    class Count:
        def take(self, pdf):
            import os

            from pyspark import TaskContext

            return pdf.assign(task=TaskContext.get().partitionId(), pid=os.getpid())[["id", "task"]]

        def end(self):
            return None

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    out = hot.run_islands(df, ["k"], ["id"], F.col("id") % 100 == 0, Count, "id long, task long", 8)
    counts = [x["count"] for x in out.groupBy("task").count().collect()]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(counts) == 20_000 and len(counts) == 4 and max(counts) < 10_000


def test_sessions(spark):
    r, rows, pts = random.Random(2), [], WRAP - 500_000
    for i in range(600):
        pts = (pts + r.choice([3000, 3000, 3000, 9000, -40_000, 20 * TICKS if r.random() < 0.2 else 3000])) % WRAP
        rows.append(("s", i, r.choice(["video", "audio", "audio"]), pts))
    session, last, forced, expected = -1, None, True, {}
    for _, i, kind, p in rows:
        step = None if last is None else (p - last + WRAP // 2) % WRAP - WRAP // 2
        fits = step is not None and not forced and -TICKS <= step <= 3 * TICKS
        if kind == "video" and not fits:
            session, forced, fits = session + 1, False, True
        if not fits:
            forced = True
        elif kind == "video":
            last = p
        if fits:
            expected[i] = session
    df = spark.createDataFrame(rows, "stream_id string, seq long, kind string, pts_90k long")
    assert {x.seq: x.session for x in frames.sessionize_av(df).collect()} == expected and session > 5


def test_speech(spark):
    r = random.Random(3)
    blocks, at = [], 0
    for _ in range(500):
        at += r.choice([100, 100, 100, 100, 900, 1500, 1600, 4000])
        blocks.append(("s", at, at + 100, r.random() < 0.8))
    runs: list = []
    for _, a, z, speech in blocks:
        if speech and runs and runs[-1][1] == a:
            runs[-1][1] = z
        elif speech:
            runs.append([a, z])
    out, end = [], 0
    for a, z in runs:
        if out and a - out[-1][1] < 1500 and a - out[-1][0] < 6000:
            out[-1][1] = z
        else:
            out.append([max(a - 600, end, 0), z])
        end = z
    df = spark.createDataFrame(blocks, "stream_id string, start_ms long, end_ms long, speech boolean")
    assert sorted([x.start_ms, x.end_ms] for x in audio.speech_intervals(df, young_ms=6000).collect()) == out and len(out) > 50


def test_speech_of_many_short_islands(spark, monkeypatch):
    """Islands of a row each make no pandas frames."""
    monkeypatch.setattr(hot, "run_ordered", None)
    blocks = spark.range(20_000).select((F.col("id") % 50).alias("stream_id"), (F.col("id") * 100).alias("start_ms"), (F.col("id") * 100 + 50).alias("end_ms"), F.lit(True).alias("speech"))
    rows = audio.speech_intervals(blocks).collect()
    assert sorted((x.stream_id, x.start_ms, x.end_ms) for x in rows) == sorted((i % 50, max(i * 100 - 600, 0), i * 100 + 50) for i in range(20_000))


def test_cues_and_loops(spark):
    r, due, lines, track, expected = random.Random(4), 0, [], cues.CueTrack(), []
    for i in range(300):
        due += r.choice([0, 50_000, 100_000, 360_000, 500_000, -20_000])
        lines.append(("s", "en", i, r.choice(["", "  ", "a line", "more words here", None]), r.random() < 0.5, due))
        expected.append(track.line(lines[-1][3] or "", lines[-1][4], due))
    expected = [x for x in [*expected, track.close(track.until)] if x]
    df = spark.createDataFrame(lines, "stream_id string, lang string, seq long, text string, new_row boolean, due long")
    assert sorted((x.start, x.end, x.text) for x in cues.cue_track(df).collect()) == sorted(expected) and len(expected) > 30

    words, at = [], 0
    for i in range(600):
        at += r.choice([300, 300, 300, 300, 31_000 if r.random() < 0.3 else 300])
        words.append(("s", i, r.choice("a b no yes".split()), at, at + 200, i // 5 * 10))
    recent, kept = [], []
    for b in range(0, 600, 5):
        batch = words[b : b + 5]
        ok, recent = admit(recent, [(w, s / 1000, e / 1000) for _, _, w, s, e, _ in batch])
        kept += [x[1] for x, keep in zip(batch, ok) if keep]
    df = spark.createDataFrame(words, "stream_id string, seq long, text string, start_ms long, end_ms long, arrival_ms long")
    assert sorted(x.seq for x in guard.prune_loops(df).collect()) == kept and 100 < len(kept) < 600
