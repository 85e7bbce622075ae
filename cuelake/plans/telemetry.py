"""Queries of the frame, statistics and trend operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import times
from ..operators import frames, joins, stats
from .tables import TAPS_SQL, table, taps


def _frames(spark, sf_dir):
    """Frames of each user with a PTS that jumps now and then."""
    e = table(spark, sf_dir, "events")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    pts = F.col("event_id") * 3000 + F.when(F.col("event_id") % 50 == 0, 900_000).otherwise(0)
    return e.select(F.col("user_id").alias("stream_id"), F.col("event_id").alias("seq"), F.pmod(pts * 40_000, F.lit(1 << 33)).alias("pts_90k"), F.when(F.col("event_id") % 3 == 0, "audio").otherwise("video").alias("kind"), ms.alias("arrival_ms"))


def frame_pairs(spark, sf_dir):
    """J1."""
    return frames.match_frames_hash(*taps(spark, sf_dir)).select("stream_id", "in_seq", "out_seq", "in_pts", "out_pts", F.round("delay_ms", 3).alias("delay_ms"))


PAIRS_SQL = f"""
WITH {TAPS_SQL}
SELECT o.stream_id, i.seq AS in_seq, o.seq AS out_seq, i.pts AS in_pts, o.pts AS out_pts, round((o.wall_ns - i.wall_ns) / 1e6, 3) AS delay_ms
FROM tap_out o JOIN tap_in i USING (stream_id, seq)"""


def frame_pairs_pts(spark, sf_dir):
    """J2 with A6's offsets."""
    i, o = taps(spark, sf_dir)
    offsets = frames.pts_offset_mode(frames.match_frames_hash(i, o)).select("stream_id", "offset")
    return frames.match_frames_pts(i, o, offsets).groupBy("stream_id").agg(F.count("*").alias("n"), F.round(F.avg("delay_ms"), 6).alias("mean_ms"))


PAIRS_PTS_SQL = f"""
WITH {TAPS_SQL}
SELECT o.stream_id, count(*) AS n, round(avg((o.wall_ns - i.wall_ns) / 1e6), 6) AS mean_ms
FROM tap_out o JOIN tap_in i USING (stream_id, seq) GROUP BY 1"""


def frame_report(spark, sf_dir):
    """A5 over J2 (auto)."""
    i, o = taps(spark, sf_dir)
    return frames.match_report(i, o, frames.match_frames(i, o))


REPORT_SQL = f"""
WITH {TAPS_SQL},
b AS (SELECT stream_id, greatest(i0, o0) AS low, least(i1, o1) AS high
      FROM (SELECT stream_id, min(wall_ns) AS i0, max(wall_ns) AS i1 FROM tap_in GROUP BY 1)
      JOIN (SELECT stream_id, min(wall_ns) AS o0, max(wall_ns) AS o1 FROM tap_out GROUP BY 1) USING (stream_id))
SELECT i.stream_id, count(o.seq) AS matched, CAST(0 AS BIGINT) AS duplicates,
       count(*) FILTER (WHERE o.seq IS NULL AND i.wall_ns BETWEEN low AND high) AS unmatched_in, CAST(0 AS BIGINT) AS unmatched_out
FROM tap_in i LEFT JOIN tap_out o USING (stream_id, seq) JOIN b ON b.stream_id = i.stream_id GROUP BY 1"""


def delay_report(spark, sf_dir):
    """F9, A1, A3, A4."""
    pairs = frames.skip_warmup(frames.match_frames_hash(*taps(spark, sf_dir)), 60)
    out = frames.delay_report(pairs)
    level = F.when(F.abs("drift_ms_per_min") < 5e-7, 0.0).otherwise(F.round("drift_ms_per_min", 6)).alias("drift_ms_per_min")  # no sign on a zero
    return out.select("stream_id", "n", *[F.round(c, 6).alias(c) for c in out.columns[2:-1]], level)


DELAY_SQL = f"""
WITH {TAPS_SQL},
p AS (SELECT o.stream_id, o.seq, o.wall_ns AS ow, i.wall_ns AS iw, (o.wall_ns - i.wall_ns) / 1e6 AS d FROM tap_out o JOIN tap_in i USING (stream_id, seq)),
f AS (SELECT * FROM (SELECT *, min(iw) OVER (PARTITION BY stream_id) AS f0 FROM p) WHERE iw >= f0 + 60000000000),
s AS (SELECT *, abs(d - lag(d) OVER (PARTITION BY stream_id ORDER BY ow, seq)) AS step, (iw - min(iw) OVER (PARTITION BY stream_id)) / 1e9 AS at_s FROM f)
SELECT stream_id, count(*) AS n, round(min(d), 6) AS min, round(quantile_disc(d, 0.5), 6) AS p50, round(quantile_disc(d, 0.95), 6) AS p95, round(quantile_disc(d, 0.99), 6) AS p99,
       round(max(d), 6) AS max, round(avg(d), 6) AS mean, round(stddev_pop(d), 6) AS stddev, round(coalesce(avg(step), 0), 6) AS mean_step, CASE WHEN abs(regr_slope(d, at_s) * 60) < 5e-7 THEN 0 ELSE round(regr_slope(d, at_s) * 60, 6) END AS drift_ms_per_min
FROM s GROUP BY 1"""


def pts_offset(spark, sf_dir):
    """A6."""
    return frames.pts_offset_mode(frames.match_frames_hash(*taps(spark, sf_dir)))


OFFSET_SQL = f"WITH {TAPS_SQL} SELECT stream_id, CAST(90000 AS BIGINT) AS \"offset\", count(*) AS agree, count(*) AS checked FROM tap_out GROUP BY 1"


def pts_sessions(spark, sf_dir):
    """Sessions of each user."""
    f = frames.unwrap_pts(_frames(spark, sf_dir))
    return frames.sessionize_pts(f).groupBy("stream_id").agg((F.max("session") + 1).alias("sessions"), F.max("pts_unwrapped").alias("last_pts"))


_FRAMES_SQL = """
f AS (SELECT user_id AS stream_id, event_id AS seq, ((event_id * 3000 + CASE WHEN event_id % 50 = 0 THEN 900000 ELSE 0 END) * 40000) % 8589934592 AS pts FROM events),
g AS (SELECT *, pts - lag(pts) OVER (PARTITION BY stream_id ORDER BY seq) AS step FROM f)"""
SESSIONS_SQL = f"""
WITH {_FRAMES_SQL},
h AS (SELECT *, pts + 8589934592 * sum(CASE WHEN step < -4294967296 THEN 1 WHEN step > 4294967296 THEN -1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY seq) AS u FROM g)
SELECT stream_id, count(*) FILTER (WHERE step IS NULL OR step < -90000 OR step > 270000) AS sessions, CAST(max(u) AS BIGINT) AS last_pts FROM h GROUP BY 1"""


def av_sessions(spark, sf_dir):
    return frames.sessionize_av(_frames(spark, sf_dir), 10_000.0, 30_000.0).groupBy("stream_id").agg(F.count("*").alias("kept"), (F.max("session") + 1).alias("sessions"))


def session_offsets(spark, sf_dir):
    """S9."""
    f = frames.sessionize_pts(_frames(spark, sf_dir), 10_000.0, 30_000.0)
    return frames.session_offset(f.withColumn("pts_ms", F.floor(F.col("pts_90k") / 90)))


def display_ranks(spark, sf_dir):
    """S19."""
    f = frames.sessionize_pts(_frames(spark, sf_dir))
    return frames.display_order(f).select("stream_id", "session", "seq", F.col("rank").cast("long").alias("rank"))


RANKS_SQL = f"""
WITH {_FRAMES_SQL},
s AS (SELECT *, sum(CASE WHEN step IS NULL OR step < -90000 OR step > 270000 THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY seq) - 1 AS session FROM g)
SELECT stream_id, CAST(session AS BIGINT) AS session, seq, row_number() OVER (PARTITION BY stream_id, session ORDER BY pts, seq) - 1 AS rank FROM s"""


def frame_slots(spark, sf_dir):
    """S20."""
    f = frames.sessionize_pts(_frames(spark, sf_dir), 10_000.0, 30_000.0)
    return frames.frame_grid(f.select("stream_id", "session", "seq", "pts_90k"), 120_000_000).groupBy("stream_id", "session").agg(F.max("slot").alias("last_slot"))


def sample_times(spark, sf_dir):
    """S18."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("stream_id"), "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("start_ms"))
    f = e.select("stream_id", "start_ms", (F.col("event_id") * 1600).alias("first_sample"), F.lit(1600).alias("n_samples"))
    return frames.sample_clock(e.select("stream_id", (F.col("event_id") * 1600 + 800).alias("sample")), f)


SAMPLES_SQL = "SELECT user_id AS stream_id, event_id * 1600 + 800 AS sample, epoch_us(ts) // 1000 + 50 AS at_ms FROM events"


def order_summary(spark, sf_dir):
    """A1."""
    out = stats.summary(table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_returnflag", "l_linestatus"])
    return out.select("l_returnflag", "l_linestatus", "n", *[F.round(c, 2).alias(c) for c in out.columns[3:]])


SUMMARY_SQL = """
SELECT l_returnflag, l_linestatus, count(*) AS n, round(CAST(min(l_extendedprice) AS DOUBLE), 2) AS min, round(CAST(quantile_disc(l_extendedprice, 0.5) AS DOUBLE), 2) AS p50,
       round(CAST(quantile_disc(l_extendedprice, 0.95) AS DOUBLE), 2) AS p95, round(CAST(quantile_disc(l_extendedprice, 0.99) AS DOUBLE), 2) AS p99, round(CAST(max(l_extendedprice) AS DOUBLE), 2) AS max,
       round(avg(CAST(l_extendedprice AS DOUBLE)), 2) AS mean, round(stddev_pop(CAST(l_extendedprice AS DOUBLE)), 2) AS stddev
FROM lineitem GROUP BY 1, 2"""

_INDEX = {
    "nearest": "ceil({p} * n) - 1", "linear": "floor({p} * (n - 1) + 0.5)", "floor_n": "floor({p} * n)", "floor_n1": "floor({p} * (n - 1))", "half_up": "round_even({p} * n + 0.5, 0) - 1",
}


def percentiles(method: str):
    def run(spark, sf_dir):
        """A2."""
        out = stats.rank_percentiles(table(spark, sf_dir, "orders"), "o_totalprice", ["o_orderpriority"], method, {"p50": 0.5, "p95": 0.95, "p99": 0.99})
        return out.select("o_orderpriority", "n", *[F.round(c, 2).alias(c) for c in ("p50", "p95", "p99")])

    return run


def percentiles_sql(method: str) -> str:
    at = lambda p: f"round(max(v) FILTER (WHERE i = greatest(0, least(CAST({_INDEX[method].format(p=p)} AS BIGINT), n - 1))), 2)"
    return f"""
SELECT o_orderpriority, count(*) AS n, {at(0.5)} AS p50, {at(0.95)} AS p95, {at(0.99)} AS p99
FROM (SELECT o_orderpriority, CAST(o_totalprice AS DOUBLE) AS v, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) - 1 AS i,
             count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders) GROUP BY 1"""


def price_trend(spark, sf_dir):
    """A3."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy("o_orderpriority").agg(F.round(stats.slope(F.col("o_totalprice").cast("double"), F.col("o_custkey").cast("double")), 6).alias("slope"))


TREND_SQL = "SELECT o_orderpriority, round(coalesce(regr_slope(CAST(o_totalprice AS DOUBLE), CAST(o_custkey AS DOUBLE)), 0), 6) AS slope FROM orders GROUP BY 1"


def value_jitter(spark, sf_dir):
    """A4."""
    out = stats.jitter(table(spark, sf_dir, "events"), "value", ["user_id"], ["ts", "event_id"])
    return out.select("user_id", F.round("stddev", 6).alias("stddev"), F.round("mean_step", 6).alias("mean_step"))


JITTER_SQL = """
SELECT user_id, round(coalesce(stddev_pop(value), 0), 6) AS stddev, round(coalesce(avg(abs(value - before)), 0), 6) AS mean_step
FROM (SELECT user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) GROUP BY 1"""


def counter_deltas(spark, sf_dir):
    """Event ids modulo 500 as counters that restart."""
    e = table(spark, sf_dir, "events").withColumn("frames", F.col("event_id") % 500)
    return stats.counter_delta(e, ["frames"], ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "frames_delta")


DELTAS_SQL = """
SELECT user_id, event_id, CASE WHEN f < b THEN f ELSE f - b END AS frames_delta
FROM (SELECT user_id, event_id, event_id % 500 AS f, lag(event_id % 500) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events)"""


def last_errors(spark, sf_dir):
    """O2: the newest 5 errors of each user."""
    e = table(spark, sf_dir, "events").filter("event_type = 'error'")
    return stats.latest_n(e, 5, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "value")


ERRORS_SQL = "SELECT user_id, event_id, value FROM events WHERE event_type = 'error' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 5"


def head_orders(spark, sf_dir):
    """The first 20 orders, the feature's own limit."""
    return stats.head_n(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), 20, "o_orderkey")


HEAD_SQL = "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 20"


def last_purchase(spark, sf_dir):
    """Each error with the latest purchase of its user before it."""
    e = table(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    left = e.filter("event_type = 'error'").select("user_id", "event_id", "us")
    right = e.filter("event_type = 'purchase'").select("user_id", F.col("us").alias("p_us"), F.col("event_id").alias("purchase_id"), F.col("value").alias("purchase_value"))
    return joins.asof_join(left, right, ["user_id"], "us", "p_us", ["purchase_id", "purchase_value"], tie="purchase_id").drop("us")


ASOF_SQL = """
SELECT user_id, event_id, purchase_id, purchase_value FROM (
  SELECT l.user_id, l.event_id, r.event_id AS purchase_id, r.value AS purchase_value,
         row_number() OVER (PARTITION BY l.event_id ORDER BY r.ts DESC, r.event_id DESC) AS k
  FROM (SELECT * FROM events WHERE event_type = 'error') l LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') r
  ON l.user_id = r.user_id AND r.ts <= l.ts) WHERE k = 1"""


def clicks_near_errors(spark, sf_dir):
    """Range join: clicks of a user within ten minutes after each error."""
    e = table(spark, sf_dir, "events").withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))
    spans = e.filter("event_type = 'error'").select("user_id", F.col("event_id").alias("error_id"), F.col("ms").alias("low"), (F.col("ms") + 600_000).alias("high"))
    points = e.filter("event_type = 'click'").select("user_id", F.col("event_id").alias("click_id"), "ms")
    return joins.range_join(points, spans, ["user_id"], "ms", "low", "high", 600_000).select("user_id", "error_id", "click_id")


RANGE_SQL = """
SELECT l.user_id, l.event_id AS error_id, r.event_id AS click_id FROM events l JOIN events r ON l.user_id = r.user_id
WHERE l.event_type = 'error' AND r.event_type = 'click' AND epoch_ms(r.ts) BETWEEN epoch_ms(l.ts) AND epoch_ms(l.ts) + 600000"""


def event_settings(spark, sf_dir):
    """Props that change from one event of a user to the next."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").withColumn("next_id", F.lead("event_id").over(w))
    before = e.select(F.col("next_id").alias("event_id"), F.col("props").alias("settings")).filter("event_id is not null")
    after = e.join(before.select("event_id"), "event_id", "left_semi").select("event_id", F.col("props").alias("settings"))
    return stats.changed_settings(before, after, ["event_id"])


SETTINGS_SQL = """
SELECT event_id, 'k' AS path, b AS old, a AS new FROM (
  SELECT event_id, json_extract_string(props, '$.k') AS a, lag(json_extract_string(props, '$.k')) OVER w AS b, lag(event_id) OVER w AS p FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE p IS NOT NULL AND a IS DISTINCT FROM b"""


def stage_latency(spark, sf_dir):
    """Three stamps made of an event's value."""
    e = table(spark, sf_dir, "events").select(F.lit(0.0).alias("entry"), F.when(F.col("event_id") % 9 == 0, -1.0).otherwise(F.col("value")).alias("bridge"), (F.col("value") * 2 + 1).alias("mux"))
    out = frames.stage_latency(e, ["entry", "bridge", "mux"])
    return out.select("stage", "n", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "p99")])


STAGE_SQL = """
SELECT stage, count(*) AS n, round(max(ms) FILTER (WHERE i = greatest(0, least(CAST(round_even(0.5 * n + 0.5, 0) AS BIGINT) - 1, n - 1))), 6) AS p50,
       round(max(ms) FILTER (WHERE i = greatest(0, least(CAST(round_even(0.95 * n + 0.5, 0) AS BIGINT) - 1, n - 1))), 6) AS p95,
       round(max(ms) FILTER (WHERE i = greatest(0, least(CAST(round_even(0.99 * n + 0.5, 0) AS BIGINT) - 1, n - 1))), 6) AS p99
FROM (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY ms) - 1 AS i, count(*) OVER (PARTITION BY stage) AS n FROM (
  SELECT 'entry-bridge' AS stage, value AS ms FROM events WHERE event_id % 9 <> 0 AND value >= 0
  UNION ALL SELECT 'bridge-mux', value * 2 + 1 - value FROM events WHERE event_id % 9 <> 0 AND value >= 0)) GROUP BY 1"""


def clock_texts(spark, sf_dir):
    """T16, T17, T22, T23, T24 over events."""
    e = table(spark, sf_dir, "events")
    ms = F.col("event_id") * 1237
    srt = times.srt_time(ms / 1000.0)
    return e.select("event_id", srt.alias("srt"), times.vtt_time(ms * 90).alias("vtt"), F.round(times.parse_time(srt), 3).alias("seconds"), F.round(times.dbfs(F.col("value") / 100), 6).alias("dbfs"), times.pts_diff(F.pmod(ms * 90_000_000, F.lit(1 << 33)), F.col("event_id")).alias("diff"), times.to_output_ts(ms, F.lit(5000), F.lit(100)).alias("out_ts"))


_HMS = "printf('%02d:%02d:%02d{m}%03d', ms // 3600000, (ms // 60000) % 60, (ms // 1000) % 60, ms % 1000)"
CLOCK_SQL = f"""
SELECT event_id, {_HMS.format(m=',')} AS srt, {_HMS.format(m='.')} AS vtt, round(ms / 1000.0, 3) AS seconds,
       round(CASE WHEN value <= 0 THEN -100.0 ELSE greatest(20 * log10(value / 100), -100) END, 6) AS dbfs,
       CASE WHEN d >= 4294967296 THEN d - 8589934592 ELSE d END AS diff, greatest(100 + (ms - 5000) * 90, 0) + 324000000 AS out_ts
FROM (SELECT *, event_id * 1237 AS ms, (((event_id * 1237 * 90000000) % 8589934592 - event_id) % 8589934592 + 8589934592) % 8589934592 AS d FROM events)"""

_AV = """
av AS (SELECT user_id AS stream_id, event_id % 3 <> 0 AS video, epoch_us(ts) // 1000 AS arrival_ms, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k,
              ((event_id * 3000 + CASE WHEN event_id % 50 = 0 THEN 900000 ELSE 0 END) * 40000) % 8589934592 AS pts FROM events)"""
_STEP = "((({}) + 12884901888) % 8589934592 - 4294967296)"
_SPLIT = f"""{_AV},
sn AS (SELECT *, sum(CASE WHEN step BETWEEN -900000000 AND 2700000000 THEN 0 ELSE 1 END) OVER (PARTITION BY stream_id ORDER BY k) - 1 AS session FROM (SELECT *, {_STEP.format('pts - lag(pts) OVER (PARTITION BY stream_id ORDER BY k)')} AS step FROM av))"""

AV_SQL = f"""
WITH RECURSIVE {_AV},
s AS (SELECT stream_id, CAST(0 AS BIGINT) AS k, CAST(-1 AS BIGINT) AS session, CAST(NULL AS BIGINT) AS last, true AS forced, false AS kept FROM (SELECT DISTINCT stream_id FROM av)
  UNION ALL
  SELECT stream_id, k, session + CASE WHEN video AND NOT fits THEN 1 ELSE 0 END, CASE WHEN video THEN pts ELSE last END, NOT (fits OR video), fits OR video FROM (
    SELECT av.*, s.session, s.last, NOT s.forced AND coalesce({_STEP.format('av.pts - s.last')} BETWEEN -900000000 AND 2700000000, false) AS fits FROM s JOIN av ON av.stream_id = s.stream_id AND av.k = s.k + 1))
SELECT stream_id, count(*) AS kept, max(session) + 1 AS sessions FROM s WHERE kept GROUP BY 1"""

OFFSETS_SQL = f"""
WITH RECURSIVE {_SPLIT},
e AS (SELECT stream_id, session, min(d) FILTER (WHERE arrival_ms <= begin_ + 500) AS low, min(p) AS first, max(p) AS last FROM (
  SELECT stream_id, session, arrival_ms, pts // 90 AS p, arrival_ms - pts // 90 AS d, min(arrival_ms) OVER (PARTITION BY stream_id, session) AS begin_ FROM sn) GROUP BY 1, 2),
o AS (SELECT stream_id, session, low AS offset_ms, last + low AS end_ FROM e WHERE session = 0
  UNION ALL SELECT e.stream_id, e.session, greatest(low, end_ + 40 - first), last + greatest(low, end_ + 40 - first) FROM o JOIN e ON e.stream_id = o.stream_id AND e.session = o.session + 1)
SELECT stream_id, CAST(session AS BIGINT) AS session, CAST(offset_ms AS BIGINT) AS offset_ms FROM o"""

SLOTS_SQL = f"""
WITH RECURSIVE {_SPLIT},
f AS (SELECT stream_id, session, pts, row_number() OVER (PARTITION BY stream_id, session ORDER BY k) AS j FROM sn),
s AS (SELECT stream_id, session, pts, j, CAST(0 AS BIGINT) AS slot, CAST(1 AS BIGINT) AS free FROM f WHERE j = 1
  UNION ALL
  SELECT stream_id, session, pts, j, slot, greatest(free, slot + 1) FROM (
    SELECT stream_id, session, pts, j, free, CASE WHEN slot >= free + 90 OR slot < free - 90 THEN free ELSE slot END AS slot FROM (
      SELECT f.stream_id, f.session, f.pts, f.j, s.free, s.slot + CAST(round((f.pts - s.pts) / 120000000.0) AS BIGINT) AS slot FROM s JOIN f ON f.stream_id = s.stream_id AND f.session = s.session AND f.j = s.j + 1)))
SELECT stream_id, CAST(session AS BIGINT) AS session, max(slot) FILTER (WHERE slot >= 0) AS last_slot FROM s GROUP BY 1, 2"""

QUERIES = {
    "frame_pairs": frame_pairs, "frame_pairs_pts": frame_pairs_pts, "frame_report": frame_report, "delay_report": delay_report, "pts_offset": pts_offset, "pts_sessions": pts_sessions,
    "av_sessions": av_sessions, "session_offsets": session_offsets, "display_ranks": display_ranks, "frame_slots": frame_slots, "sample_times": sample_times, "order_summary": order_summary,
    **{f"percentiles_{m}": percentiles(m) for m in _INDEX},
    "price_trend": price_trend, "value_jitter": value_jitter, "counter_deltas": counter_deltas, "last_errors": last_errors, "head_orders": head_orders, "last_purchase": last_purchase,
    "clicks_near_errors": clicks_near_errors, "event_settings": event_settings, "stage_latency": stage_latency, "clock_texts": clock_texts,
}
SQL = {
    "frame_pairs": PAIRS_SQL, "frame_pairs_pts": PAIRS_PTS_SQL, "frame_report": REPORT_SQL, "delay_report": DELAY_SQL, "pts_offset": OFFSET_SQL, "pts_sessions": SESSIONS_SQL, "display_ranks": RANKS_SQL,
    "sample_times": SAMPLES_SQL, "order_summary": SUMMARY_SQL, **{f"percentiles_{m}": percentiles_sql(m) for m in _INDEX}, "price_trend": TREND_SQL, "value_jitter": JITTER_SQL,
    "counter_deltas": DELTAS_SQL, "last_errors": ERRORS_SQL, "head_orders": HEAD_SQL, "last_purchase": ASOF_SQL, "clicks_near_errors": RANGE_SQL, "event_settings": SETTINGS_SQL,
    "stage_latency": STAGE_SQL, "clock_texts": CLOCK_SQL,
    "av_sessions": AV_SQL, "session_offsets": OFFSETS_SQL, "frame_slots": SLOTS_SQL,
}
