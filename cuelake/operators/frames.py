"""Frame taps: matching input and output frames, delay reports, sessions, clocks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import TICKS, WRAP, pts_diff
from ..sources.staging import staged
from .hot import scanned
from .joins import asof_join
from .ordered import add_ordered
from .ranks import nearest, with_ranks
from .stats import drift_ms_per_min, rank_percentiles

NO_HASH = "0" * 16


def _match(inputs: DataFrame, outputs: DataFrame, key: str) -> DataFrame:
    """Outputs with the latest input of the same key at or before them, else the earliest one. One sort of both sides
    by key and time: a key that stands very often costs no pairs."""
    left = outputs.filter(F.col(key).isNotNull()).select("stream_id", F.col(key), F.col("wall_ns").alias("out_wall_ns"), F.col("seq").alias("out_seq"), F.col("pts_90k").alias("out_pts"))
    right = inputs.filter(F.col(key).isNotNull()).select("stream_id", F.col(key), F.col("wall_ns").alias("in_wall_ns"), F.col("seq").alias("in_seq"), F.col("pts_90k").alias("in_pts"))
    out = asof_join(left, right, ["stream_id", key], "out_wall_ns", "in_wall_ns", ["in_wall_ns", "in_seq", "in_pts"], tie="in_seq", first_if_none=True)
    return out.filter("in_seq is not null").withColumn("delay_ms", (F.col("out_wall_ns") - F.col("in_wall_ns")) / 1e6).drop(key)


def match_frames_hash(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Pairs of frames ``stream_id, in_seq, out_seq, in_pts, out_pts, in_wall_ns, out_wall_ns, delay_ms`` by hash."""
    own = lambda df: df.withColumn("__k", F.when(F.col("tail_hash") != NO_HASH, F.col("tail_hash")))
    return _match(own(inputs), own(outputs), "__k")


def match_frames_pts(inputs: DataFrame, outputs: DataFrame, offsets: DataFrame) -> DataFrame:
    """Pairs by PTS; ``offsets(stream_id, offset)`` is what the output's is ahead."""
    moved = outputs.join(offsets, "stream_id", "left").withColumn("__k", F.pmod(F.col("pts_90k") - F.coalesce("offset", F.lit(0)), F.lit(WRAP)))
    return _match(inputs.withColumn("__k", F.col("pts_90k")), moved, "__k")


def pts_offset_mode(pairs: DataFrame) -> DataFrame:
    """Per stream the most frequent ``offset`` of hash pairs, and how many of them agree. Ties go to the smaller
    absolute, then the smaller value."""
    diff = pairs.filter("in_pts is not null and out_pts is not null").select("stream_id", pts_diff(F.col("out_pts"), F.col("in_pts")).alias("d"))
    counts = diff.groupBy("stream_id", "d").agg(F.count("*").alias("n"))
    return counts.groupBy("stream_id").agg(F.max_by("d", F.struct("n", -F.abs("d"), -F.col("d"))).alias("offset"), F.max("n").alias("agree"), F.sum("n").alias("checked"))


def match_frames(inputs: DataFrame, outputs: DataFrame, offset: int | None = None) -> DataFrame:
    """J2, auto: hash pairs of a stream if they cover half of its outputs, else PTS pairs with the forced offset, the
    offset of its hash pairs, or 0. ``method`` says which."""
    by_hash = staged(match_frames_hash(inputs, outputs), "hash-pairs")
    n_out = outputs.groupBy("stream_id").agg(F.count("*").alias("n_out"))
    use = n_out.join(by_hash.groupBy("stream_id").agg(F.count("*").alias("n")), "stream_id", "left")
    use = use.select("stream_id", (F.coalesce(2 * F.col("n") >= F.col("n_out"), F.lit(False))).alias("use_hash"))
    known = pts_offset_mode(by_hash).select("stream_id", "offset") if offset is None else n_out.select("stream_id", F.lit(offset).alias("offset"))
    rest = lambda df: df.join(use.filter(~F.col("use_hash")), "stream_id", "left_semi")
    by_pts = match_frames_pts(rest(inputs), rest(outputs), known)
    one = by_hash.join(use.filter("use_hash"), "stream_id", "left_semi").withColumn("method", F.lit("hash"))
    return one.unionByName(by_pts.drop("offset").withColumn("method", F.lit("pts")))


def skip_warmup(pairs: DataFrame, seconds: float) -> DataFrame:
    """pairs whose input comes after the first seconds of its stream."""
    first = pairs.groupBy("stream_id").agg(F.min("in_wall_ns").alias("__first"))
    return pairs.join(first, "stream_id").filter(F.col("in_wall_ns") >= F.col("__first") + int(seconds * 1e9)).drop("__first")


def match_report(inputs: DataFrame, outputs: DataFrame, pairs: DataFrame) -> DataFrame:
    """A5: per stream matched pairs, frames without a match in the time that both taps saw, inputs matched twice."""
    pairs = staged(pairs.select("stream_id", "in_seq", "out_seq"), "pairs")
    span = lambda df, k: df.groupBy("stream_id").agg(F.min("wall_ns").alias(f"{k}0"), F.max("wall_ns").alias(f"{k}1"))
    both = span(inputs, "i").join(span(outputs, "o"), "stream_id").select("stream_id", F.greatest("i0", "o0").alias("low"), F.least("i1", "o1").alias("high"))

    def alone(df: DataFrame, seq: str, name: str) -> DataFrame:
        none = df.join(pairs.select("stream_id", F.col(seq).alias("seq")).distinct(), ["stream_id", "seq"], "left_anti")
        return none.join(both, "stream_id").filter(F.col("wall_ns").between(F.col("low"), F.col("high"))).groupBy("stream_id").agg(F.count("*").alias(name))

    out = pairs.groupBy("stream_id").agg(F.count("*").alias("matched"), (F.count("*") - F.count_distinct("in_seq")).alias("duplicates"))
    for part in (alone(inputs, "in_seq", "unmatched_in"), alone(outputs, "out_seq", "unmatched_out")):
        out = out.join(part, "stream_id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("unmatched_in", "unmatched_out")})


def delay_report(pairs: DataFrame) -> DataFrame:
    """A1, A3, A4 of the delays of each stream."""
    w = Window.partitionBy("stream_id").orderBy("out_wall_ns", "out_seq")
    rows = pairs.withColumn("step", F.abs(F.col("delay_ms") - F.lag("delay_ms").over(w))).withColumn("at_s", (F.col("in_wall_ns") - F.min("in_wall_ns").over(Window.partitionBy("stream_id"))) / 1e9)
    ranks = {"p50": nearest(0.5), "p95": nearest(0.95), "p99": nearest(0.99)}
    plain = {"min": F.min("delay_ms"), "max": F.max("delay_ms"), "mean": F.avg("delay_ms"), "stddev": F.stddev_pop("delay_ms"), "mean_step": F.coalesce(F.avg("step"), F.lit(0.0)), "drift_ms_per_min": drift_ms_per_min(F.col("delay_ms"), F.col("at_s"))}
    return with_ranks(rows, "delay_ms", ["stream_id"], ranks, plain).select("stream_id", "n", "min", "p50", "p95", "p99", "max", "mean", "stddev", "mean_step", "drift_ms_per_min")


def unwrap_pts(rows: DataFrame, pts: str = "pts_90k", order: str = "seq") -> DataFrame:
    """``pts_unwrapped`` of a stream in order: a drop of more than half the clock's range is a wrap forward, a
    rise of more than half one back (a late frame from before the wrap)."""
    w = Window.partitionBy("stream_id").orderBy(order)
    step = F.col(pts) - F.lag(pts).over(w)
    turn = F.when(step < -(WRAP // 2), 1).when(step > WRAP // 2, -1).otherwise(0)
    return rows.withColumn("__turn", turn).withColumn("pts_unwrapped", F.col(pts) + F.sum("__turn").over(w) * F.lit(WRAP)).drop("__turn")


def sessionize_pts(frames: DataFrame, back_s: float = 1.0, ahead_s: float = 3.0) -> DataFrame:
    """S8, one kind of frames: ``session`` counts up where the unwrapped PTS falls by more than ``back_s`` or rises by
    more than ``ahead_s`` seconds, or where a column ``forced`` is true."""
    w = Window.partitionBy("stream_id").orderBy("seq")
    step = pts_diff(F.col("pts_90k"), F.lag("pts_90k").over(w))  # across the clock's wrap
    breaks = step.isNull() | (step < -back_s * TICKS) | (step > ahead_s * TICKS)
    if "forced" in frames.columns:
        breaks |= F.coalesce("forced", F.lit(False))
    return frames.withColumn("session", F.sum(breaks.cast("int")).over(w).cast("long") - 1)


def sessionize_av(frames: DataFrame, back_s: float = 1.0, ahead_s: float = 3.0) -> DataFrame:
    """S8, video and audio (``kind``) in one order: only video opens a session. Audio that doesn't fit is dropped and
    makes the next video open one."""

    is_video = F.col("kind") == "video"
    rows = scanned(frames, ["stream_id"], ["seq"], {"__last": ("last", F.when(is_video, F.col("pts_90k")))})
    # video always leaves its own PTS and nothing forced behind, so all that counts is the video before
    step = pts_diff(F.col("pts_90k"), F.col("__last"))
    bad = F.coalesce((step < -back_s * TICKS) | (step > ahead_s * TICKS), F.lit(True))
    rows = rows.withColumn("__bad", bad).withColumn("__odd", (bad & ~is_video).cast("long"))
    rows = scanned(rows, ["stream_id"], ["seq"], {"__odds": ("sum", F.col("__odd"))})
    rows = scanned(rows, ["stream_id"], ["seq"], {"__at_video": ("last", F.when(is_video, F.col("__odds")))})
    odd_since = F.col("__odds") > F.coalesce("__at_video", F.lit(0))  # with this row, if it is audio
    rows = rows.withColumn("__opens", is_video & (F.col("__bad") | odd_since)).withColumn("__drop", ~is_video & odd_since)
    rows = scanned(rows, ["stream_id"], ["seq"], {"session": ("sum", F.col("__opens").cast("long"))})
    return rows.filter(~F.col("__drop")).withColumn("session", F.col("session") - 1).select(*frames.columns, "session")


def session_offset(frames: DataFrame, hold_ms: int = 500, step_ms: int = 40) -> DataFrame:
    """Per session ``offset_ms``: the least of arrival less PTS over its first ``hold_ms``, but so that output times
    go on at least ``step_ms`` after the session before. Input: stream_id, session, arrival_ms, pts_ms."""
    first = frames.groupBy("stream_id", "session").agg(F.min("arrival_ms").alias("__begin"))
    rows = frames.join(first, ["stream_id", "session"])
    early = F.when(F.col("arrival_ms") <= F.col("__begin") + hold_ms, F.col("arrival_ms") - F.col("pts_ms"))
    each = rows.groupBy("stream_id", "session").agg(F.min(early).alias("least"), F.min("pts_ms").alias("first"), F.max("pts_ms").alias("last"))
    # sessions of a stream are few: their offsets follow one another
    ordered = each.groupBy("stream_id").agg(F.sort_array(F.collect_list(F.struct("session", "least", "first", "last"))).alias("s"))
    start = F.struct(F.lit(None).cast("long").alias("end"), F.array().cast("array<struct<session:long,offset_ms:long>>").alias("out"))

    def add(a, s):
        offset = F.greatest(s["least"], F.coalesce(a["end"] + step_ms - s["first"], s["least"]))
        return F.struct((s["last"] + offset).alias("end"), F.concat(a["out"], F.array(F.struct(s["session"].alias("session"), offset.alias("offset_ms")))).alias("out"))

    return ordered.select("stream_id", F.explode(F.aggregate("s", start, add, lambda a: a["out"])).alias("x")).select("stream_id", "x.*")


def sample_clock(samples: DataFrame, frames: DataFrame, rate: int = 16_000) -> DataFrame:
    """``at_ms`` of ``samples(stream_id, sample)`` by the anchors of ``frames(stream_id, start_ms, first_sample,
    n_samples)``: frames that don't follow on the one before. Samples before the first anchor go back from it."""
    w = Window.partitionBy("stream_id").orderBy("first_sample")
    due = F.lag(F.col("start_ms") + F.floor(F.col("n_samples") * 1000 / rate)).over(w)
    anchors = frames.withColumn("__due", due).filter("__due is null or start_ms <> __due")
    anchors = anchors.select("stream_id", F.col("first_sample").alias("anchor_sample"), F.col("start_ms").alias("anchor_ms"))
    out = asof_join(samples, anchors, ["stream_id"], "sample", "anchor_sample", ["anchor_sample", "anchor_ms"], first_if_none=True)
    return out.withColumn("at_ms", (F.col("anchor_ms") + F.floor((F.col("sample") - F.col("anchor_sample")) * 1000 / rate)).cast("long")).drop("anchor_sample", "anchor_ms")


def display_order(frames: DataFrame) -> DataFrame:
    """``rank`` of each frame of a session in order of PTS."""
    return frames.withColumn("rank", F.row_number().over(Window.partitionBy("stream_id", "session").orderBy("pts_90k", "seq")) - 1)


def frame_grid(frames: DataFrame, frame_ticks: int = 3000, most: int = 90) -> DataFrame:
    """``slot`` of each frame: the slot of the frame before plus the PTS step in frames, rounded (halves away from
    zero). The first frame, and one that lands ``most`` slots or more after or more than ``most`` before the next free
    slot, starts anew at that slot; so does one without a PTS and the one after it. A frame before slot 0 has none."""

    def grid() -> Callable[[int | None], int | None]:
        free, last = 0, None

        def slot_of(pts: int | None) -> int | None:
            nonlocal free, last
            slot = free
            if last is not None and pts is not None:
                step = (pts - last[0]) / frame_ticks
                slot = last[1] + int(abs(step) + 0.5) * (1 if step >= 0 else -1)
            if slot >= free + most or slot < free - most:
                slot = free
            last, free = None if pts is None else (pts, slot), max(free, slot + 1)
            return slot if slot >= 0 else None

        return slot_of

    return add_ordered(frames, ["stream_id", "session"], ["seq"], "pts_90k", grid, "slot")


def stage_latency(stamps: DataFrame, stages: list[str]) -> DataFrame:
    """Percentiles of the time from each stage to the next, over frames with both stamps. Input: a row for each
    frame with a column of ms for each stage; negative or null means missing."""
    steps = F.array(*[F.struct(F.lit(f"{a}-{b}").alias("stage"), F.when((F.col(a) >= 0) & (F.col(b) >= 0), F.col(b) - F.col(a)).cast("double").alias("ms")) for a, b in zip(stages, stages[1:])])
    rows = stamps.select(F.explode(steps).alias("x")).select("x.*").filter("ms >= 0")
    return rank_percentiles(rows, "ms", ["stage"], "half_up", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
