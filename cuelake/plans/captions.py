"""Queries of the cue, lag, error-rate, lane, audio, hypothesis, report and text operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import agree, audio, cues, lag, lanes, reports, stats, wer
from ..sources import named, readers, sinks
from .tables import WORDS_SQL, dealt, languages, shared_path, table, word_tasks, words

# ---- cues: one for each turn, two-second segments

CUES_SQL = """
cues AS (SELECT conv_id AS stream_id, turn * 450000 AS start, turn * 450000 + 180000 + 9000 * (length(text) % 30) AS end_, text FROM conversations)"""


def _cues(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    start = F.col("turn") * 450_000
    return c.select(F.col("conv_id").alias("stream_id"), F.lit("en").alias("lang"), F.col("turn").alias("seq"), start.alias("start"), (start + 180_000 + 9000 * (F.length("text") % 30)).alias("end"), "text")


def _segments(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("stream_id")).agg(F.max("turn").alias("last"))
    return c.withColumn("seq", F.explode(F.sequence(F.lit(0), F.col("last") * 2))).select("stream_id", F.col("seq").cast("long").alias("seq"), (F.col("seq") * 180_000).cast("long").alias("seg_start"), ((F.col("seq") + 1) * 180_000).cast("long").alias("seg_end"), F.lit(2.0).alias("dur"))


SEGMENTS_SQL = """
segs AS (SELECT stream_id, seq, seq * 180000 AS s, (seq + 1) * 180000 AS e FROM (
  SELECT conv_id AS stream_id, unnest(generate_series(0, CAST(max(turn) * 2 AS BIGINT))) AS seq FROM conversations GROUP BY conv_id))"""


def cue_overlap(spark, sf_dir):
    """J8."""
    return cues.cue_overlap(_cues(spark, sf_dir), _segments(spark, sf_dir)).select("stream_id", "seq", "start", "end")


OVERLAP_SQL = f"""
WITH {CUES_SQL}, {SEGMENTS_SQL}
SELECT stream_id, seq, greatest(s, start) AS start, least(e, end_) AS "end" FROM segs JOIN cues USING (stream_id)
WHERE end_ > s AND start < e AND least(e, end_) - greatest(s, start) >= 90"""


def vtt_bodies(spark, sf_dir):
    """K1."""
    langs = spark.createDataFrame([("en",)], "lang string")
    out = cues.vtt_segments(_cues(spark, sf_dir), _segments(spark, sf_dir), langs)
    return out.select("stream_id", "lang", "seq", F.md5("body").alias("body_md5"), F.length("body").cast("long").alias("n_chars"))


def playlists(spark, sf_dir):
    """K2."""
    langs = languages(spark).select(F.col("code").alias("lang"))
    return cues.subtitle_playlists(_segments(spark, sf_dir), langs).select("stream_id", "lang", F.md5("body").alias("body_md5"))


def master_playlists(spark, sf_dir):
    return cues.master_playlist(_segments(spark, sf_dir), languages(spark))


def cue_tracks(spark, sf_dir):
    """S13 over clauses of turns."""
    c = table(spark, sf_dir, "conversations")
    rows = c.select(F.col("conv_id").alias("stream_id"), F.lit("en").alias("lang"), F.col("turn").alias("seq"), "text", (F.col("turn") % 2 == 0).alias("new_row"), (F.col("turn") * 135_000).alias("due"))
    return cues.cue_track(rows)


#: Line by line: what is shown, since when, until when, and the cue that the line ends.
CUE_TRACKS_SQL = r"""
WITH RECURSIVE l AS (SELECT conv_id AS stream_id, turn AS seq, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t, turn % 2 = 0 AS new_row, CAST(turn * 135000 AS BIGINT) AS due FROM conversations),
r AS (
  SELECT stream_id, CAST(-1 AS BIGINT) AS seq, CAST([] AS VARCHAR[]) AS lines, CAST(NULL AS BIGINT) AS start, CAST(0 AS BIGINT) AS until, CAST(NULL AS BIGINT) AS s, CAST(NULL AS BIGINT) AS e, CAST(NULL AS VARCHAR) AS shown FROM (SELECT DISTINCT stream_id FROM l)
  UNION ALL
  SELECT stream_id, seq, CASE WHEN len(kept) > 0 AND NOT new_row AND len(kept[-1] || ' ' || t) <= 42 THEN list_append(kept[1:-2], kept[-1] || ' ' || t) ELSE list_append(kept, t)[-2:] END, now, now + 360000,
         CASE WHEN least(now, until) > start THEN start END, CASE WHEN least(now, until) > start THEN least(now, until) END, CASE WHEN least(now, until) > start THEN array_to_string(lines, chr(10)) END
  FROM (SELECT r.stream_id, l.seq, l.t, l.new_row, r.lines, r.start, r.until, greatest(l.due, coalesce(r.start, l.due)) AS now,
               CASE WHEN r.start IS NOT NULL AND greatest(l.due, r.start) >= r.until THEN r.lines[1:0] ELSE r.lines END AS kept
        FROM r JOIN l ON l.stream_id = r.stream_id AND l.seq = r.seq + 1))
SELECT stream_id, 'en' AS lang, s AS start, e AS "end", shown AS text FROM r WHERE s IS NOT NULL
UNION ALL SELECT stream_id, 'en', start, until, array_to_string(lines, chr(10)) FROM r WHERE start IS NOT NULL QUALIFY row_number() OVER (PARTITION BY stream_id ORDER BY seq DESC) = 1"""


def simple_cues(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("stream_id"), F.lit("en").alias("lang"), F.col("turn").alias("seq"), (F.col("turn") * 135_000 + F.length("text") * 900).alias("due"), "text")
    return cues.simple_cues(c).select("stream_id", "start", "end")


SIMPLE_SQL = """
SELECT stream_id, due AS start, least(coalesce(nxt, due + 360000), due + 360000) AS "end" FROM (
  SELECT *, lead(due) OVER (PARTITION BY stream_id ORDER BY due, turn) AS nxt FROM (SELECT conv_id AS stream_id, turn, turn * 135000 + length(text) * 900 AS due FROM conversations))
WHERE least(coalesce(nxt, due + 360000), due + 360000) > due"""


def _srt(spark, sf_dir):
    c = _cues(spark, sf_dir).select("stream_id", (F.col("start") / 90000).alias("start"), (F.col("end") / 90000).alias("end"), F.regexp_replace("text", r"\s+", " ").alias("text"))
    return c, cues.srt_body(c)


def srt_round_trip(spark, sf_dir):
    """What is written is read back."""
    _, body = _srt(spark, sf_dir)
    back = readers.parse_srt(body.withColumnRenamed("body", "value"))
    return back.select("stream_id", F.col("position").cast("long").alias("position"), F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), F.length("text").cast("long").alias("n_chars"))


SRT_SQL = rf"""
WITH {CUES_SQL}
SELECT stream_id, row_number() OVER (PARTITION BY stream_id ORDER BY start) - 1 AS position, round(start / 90000.0, 3) AS start, round(end_ / 90000.0, 3) AS "end",
       length(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS n_chars FROM cues WHERE trim(text) <> ''"""


def playlist_round_trip(spark, sf_dir):
    """K2 and R6."""
    bodies = cues.subtitle_playlists(_segments(spark, sf_dir), spark.createDataFrame([("en",)], "lang string"))
    return readers.parse_playlist(bodies.select("stream_id", F.col("body").alias("value")))


PLAYLIST_SQL = f"WITH {SEGMENTS_SQL} SELECT stream_id, 2.0 AS target, seq, 2.0 AS dur, 'en_' || seq || '.vtt' AS uri FROM segs"


def published_subtitles(spark, sf_dir):
    """Segments and playlists are written as files; each playlist is read and each URI that it names opened."""
    langs, base = spark.createDataFrame([("en",), ("fr",)], "lang string"), shared_path(spark, "subtitles")
    segments = _segments(spark, sf_dir)
    named.write_vtt_segments(cues.vtt_segments(_cues(spark, sf_dir), segments, langs), f"{base}/segments")
    named.write_playlists(cues.subtitle_playlists(segments, langs), f"{base}/playlists")
    # files are opened by name where the rows are, dealt over all tasks: listed folders are planned at some 30 files a task
    many = lambda df: df.repartition("file")
    names = segments.select("stream_id").distinct().crossJoin(F.broadcast(langs)).select("stream_id", "lang", named.playlist_name(F.col("stream_id"), F.col("lang")).alias("file"))
    lists = named.read_named(many(names), f"{base}/playlists").select(F.struct("stream_id", "lang").alias("stream_id"), "value")
    uris = readers.parse_playlist(lists).select("stream_id.*", "seq", F.concat(named.folder(F.col("stream_id.stream_id")), F.lit("/"), "uri").alias("file"))
    opened = named.read_named(many(uris), f"{base}/segments")
    return opened.select("stream_id", "lang", "seq", F.md5("value").alias("body_md5"))


def emission_tails(spark, sf_dir):
    """K3, W6."""
    w = words(spark, sf_dir).withColumn("emit_s", F.col("arrival_ms") / 1000.0)
    return cues.emission_cues(w).select("stream_id", "start", "end", F.md5("text").alias("text_md5"))


EMISSION_SQL = f"""
WITH {WORDS_SQL},
t AS (SELECT stream_id, seq, arrival_ms / 1000.0 AS s, string_agg(text, ' ') OVER (PARTITION BY stream_id ORDER BY seq ROWS BETWEEN 15 PRECEDING AND CURRENT ROW) AS tail FROM words),
e AS (SELECT stream_id, s, arg_max(tail, seq) AS tail FROM t GROUP BY 1, 2)
SELECT stream_id, s AS start, coalesce(lead(s) OVER (PARTITION BY stream_id ORDER BY s), s + 4.0) AS "end", md5(tail) AS text_md5 FROM e"""

# ---- lag


def _seconds(spark, sf_dir, tasks=None):
    return words(spark, sf_dir, tasks).select("stream_id", "seq", "text", (F.col("start_ms") / 1000.0).alias("start"), (F.col("end_ms") / 1000.0).alias("end"), (F.col("arrival_ms") / 1000.0).alias("emit"))


def segment_ends(spark, sf_dir):
    """Segments of 7.3 s."""
    tasks = word_tasks(spark, sf_dir)
    w = _seconds(spark, sf_dir, tasks)
    segs = w.groupBy("stream_id").agg(F.max("end").alias("m")).withColumn("k", F.explode(F.sequence(F.lit(0), F.floor(F.col("m") / 7.3).cast("int"))))
    segs = segs.select("stream_id", (F.col("k") * 7.3).alias("start"), (F.col("k") * 7.3 + 6.0).alias("end"))
    return lag.words_in_segment(segs, w, tasks=tasks).select("stream_id", F.round("start", 3).alias("start"), F.round("ref_end", 3).alias("ref_end"))


SEGMENT_ENDS_SQL = f"""
WITH {WORDS_SQL},
w AS (SELECT stream_id, start_ms / 1000.0 AS s, end_ms / 1000.0 AS e FROM words),
g AS (SELECT stream_id, k * 7.3 AS a, k * 7.3 + 6.0 AS z FROM (SELECT stream_id, unnest(generate_series(0, CAST(floor(max(e) / 7.3) AS BIGINT))) AS k FROM w GROUP BY 1))
SELECT g.stream_id, round(a, 3) AS start, round(coalesce(max(w.e), any_value(z)), 3) AS ref_end FROM g LEFT JOIN w ON w.stream_id = g.stream_id AND w.s >= a AND w.s < z GROUP BY g.stream_id, a"""


def clip_lags(spark, sf_dir):
    """A clip for each turn of ten seconds."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("stream_id"), F.col("turn").alias("clip_id"), (F.col("turn") * 10.0).alias("start"), (F.col("turn") * 10.0 + 8.0).alias("end"))
    return lag.clip_lag(c, _seconds(spark, sf_dir)).select("stream_id", "clip_id", F.round("lag_s", 3).alias("lag_s"))


CLIP_SQL = f"""
WITH {WORDS_SQL}
SELECT c.conv_id AS stream_id, c.turn AS clip_id, round(max(w.arrival_ms) / 1000.0 - (c.turn * 10.0 + 8.0), 3) AS lag_s
FROM conversations c LEFT JOIN words w ON w.stream_id = c.conv_id AND w.end_ms BETWEEN c.turn * 10000 AND c.turn * 10000 + 8500 GROUP BY 1, 2"""


def caption_lag(spark, sf_dir):
    """A12."""
    return lag.caption_lag_now(words(spark, sf_dir)).groupBy("stream_id").agg(F.max("lag_ms").alias("max_ms"), F.round(F.avg("lag_ms"), 6).alias("mean_ms"))


LAG_NOW_SQL = f"""
WITH {WORDS_SQL}
SELECT stream_id, CAST(max(l) AS BIGINT) AS max_ms, round(avg(l), 6) AS mean_ms FROM (
  SELECT stream_id, arrival_ms - max(end_ms) OVER (PARTITION BY stream_id ORDER BY arrival_ms, seq) AS l FROM words) GROUP BY 1"""


def utterance_lags(spark, sf_dir):
    """Turns as utterances, shown two seconds after they end."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("stream_id"), F.col("turn").cast("long").alias("utt"), (F.col("turn") * 6.0).alias("start"), (F.col("turn") * 6.0 + 4.0).alias("end"), "text")
    shown = c.select("stream_id", (F.col("end") + 2.0).alias("start"), "text")
    span = c.groupBy("stream_id").agg(F.lit(0.0).alias("low"), (F.max("end") + 20).alias("high"))
    utts = lag.borrow_words(lag.in_span(c, span, 15.0)).withColumns({"loop": F.lit(0).cast("long"), "ref_end": F.col("end")})
    return lag.lag_summary(lag.utterance_appearance(utts, shown))


def nearest_words(spark, sf_dir):
    """Words against themselves, 0.1 s later."""
    w = _seconds(spark, sf_dir)
    return lag.word_timing_error(lag.nearest_word(w, w.withColumn("start", F.col("start") + 0.1))).select("stream_id", "n", *[F.round(c, 6).alias(c) for c in ("p5", "p50", "p95")])


def closest_lines(spark, sf_dir):
    """Turns against what was shown of them; of every other turn the first word is missing."""
    c = table(spark, sf_dir, "conversations")
    expected = c.select(F.col("conv_id").alias("file"), F.col("turn").alias("line"), "text")
    shown = c.select(F.col("conv_id").alias("file"), F.when(F.col("turn") % 2 == 1, F.col("text")).otherwise(F.regexp_replace("text", r"^\S+\s*", "")).alias("text"))
    return lag.exact_or_closest(expected, shown).select("file", "line", "exact", F.round("similarity", 6).alias("similarity"))


def first_lines(spark, sf_dir):
    """J18."""
    c = table(spark, sf_dir, "conversations")
    shown = c.select(F.col("conv_id").alias("stream_id"), (F.col("turn") * 2.0).alias("start"), "text")
    lines = c.select(F.col("conv_id").alias("stream_id"), F.col("turn").cast("double").alias("at_s"), F.explode(F.split("text", "\n")).alias("line"))
    return lag.first_appearance(shown, lines).select("stream_id", "at_s", "lag_s")


FIRST_LINES_SQL = """
WITH l AS (SELECT conv_id AS stream_id, CAST(turn AS DOUBLE) AS at_s, unnest(string_split(text, chr(10))) AS line FROM conversations),
s AS (SELECT stream_id, line, min(start) AS a FROM (SELECT conv_id AS stream_id, turn * 2.0 AS start, unnest(string_split(text, chr(10))) AS line FROM conversations) GROUP BY 1, 2)
SELECT l.stream_id, at_s, a - at_s AS lag_s FROM l LEFT JOIN s USING (stream_id, line)"""


def translation_deltas(spark, sf_dir):
    """Turns as clauses pushed on three lanes."""
    c = table(spark, sf_dir, "conversations").withColumn("lane", F.explode(F.array(*[F.lit(k) for k in range(3)]))).filter("not (lane > 0 and turn % 11 = 3)")
    wall = F.col("turn") * 1_000_000_000 + F.col("lane") * (700_000_000 + F.length("text") * 100_000)
    return lag.clause_translation_delta(c.select(F.col("conv_id").alias("stream_id"), "lane", F.col("turn").alias("clause"), wall.alias("wall_ns"), (F.length("text") % 30).cast("double").alias("wait_ms"))).select("lane", "clauses", "missing", *[F.round(c, 6).alias(c) for c in ("mean_wait_ms", "p50", "p95")])


# ---- error rates


def turn_wer(spark, sf_dir):
    """Turn t against turn t + 1."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("ref"))
    pairs, _ = wer.ref_hyp_join(c, c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("ref").alias("hyp")), ["conv_id", "turn"])
    out = wer.wer(pairs, ["conv_id"], kinds=True)
    return out.select("conv_id", "utts", "edits", "n_ref", "sub", "del", "ins", F.round("wer", 6).alias("wer"))


#: The table of a pair a row at a time, packed as cost and deletions; steps add a fixed number, so insertions are a running
#: minimum over the row.
TURN_WER_SQL = r"""
WITH RECURSIVE c AS (SELECT conv_id, turn, text, list_filter(string_split_regex(regexp_replace(lower(nfc_normalize(text)), '[\p{P}\p{S}\p{C}]', ' ', 'g'), '\s+'), lambda x: x <> '') AS w FROM conversations),
p AS MATERIALIZED (SELECT row_number() OVER () AS id, a.conv_id, a.w AS x, b.w AS y FROM c a JOIN c b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1
      WHERE trim(a.text) <> '' AND len(a.w) > 0),
r AS (SELECT id, 0 AS i, unnest(range(0, len(y) + 1)) AS j, unnest(list_transform(range(0, len(y) + 1), lambda j: j * 4294967296)) AS v FROM p
      UNION ALL
      SELECT id, i, j, min(t - j * 4294967296) OVER (PARTITION BY id ORDER BY j) + j * 4294967296
      FROM (SELECT r.id, r.i + 1 AS i, r.j, least(v + 4294967297, CASE WHEN r.j > 0 THEN lag(v) OVER (PARTITION BY r.id ORDER BY r.j) + CASE WHEN p.x[r.i + 1] = p.y[r.j] THEN 0 ELSE 4294967296 END ELSE v + 4294967297 END) AS t
            FROM r JOIN p USING (id) WHERE r.i < len(p.x))),
k AS (SELECT p.conv_id, len(x) AS n, len(y) AS m, v >> 32 AS cost, v & 4294967295 AS gone FROM r JOIN p USING (id) WHERE i = len(x) AND j = len(y))
SELECT conv_id, count(*) AS utts, CAST(sum(cost) AS BIGINT) AS edits, CAST(sum(n) AS BIGINT) AS n_ref, CAST(sum(cost - 2 * gone + n - m) AS BIGINT) AS sub, CAST(sum(gone) AS BIGINT) AS del,
       CAST(sum(gone - n + m) AS BIGINT) AS ins, round(100.0 * sum(cost) / sum(n), 6) AS wer FROM k GROUP BY conv_id"""


def missing_turns(spark, sf_dir):
    """Turns without a next one."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    return stats.missing_ids(c, c.select("conv_id", (F.col("turn") - 1).alias("turn")), ["conv_id", "turn"])


MISSING_SQL = "SELECT conv_id, turn FROM conversations WHERE (conv_id, turn) NOT IN (SELECT (conv_id, turn - 1) FROM conversations)"

# ---- lanes


def _clauses(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("stream_id"), F.col("turn").alias("id"), "text", (F.col("turn") * 2000).alias("closed_ms"))


def _translations(spark, sf_dir):
    c = lanes.fanout_targets(_clauses(spark, sf_dir), languages(spark))
    late = F.length("text") * 3 + F.when(F.col("lang") == "de", 2500).otherwise(0)
    return c.select("stream_id", F.col("id").alias("clause_id"), "lang", reports.stub_translate(F.col("text"), F.col("lang")).alias("text"), (F.col("closed_ms") + late).alias("arrival_ms"))


TRANSLATIONS_SQL = """
tr AS (SELECT conv_id AS stream_id, turn AS clause_id, lang, text, turn * 2000 AS closed_ms, turn * 2000 + length(text) * 3 + CASE WHEN lang = 'de' THEN 2500 ELSE 0 END AS arrival_ms
       FROM conversations, (VALUES ('es'), ('fr'), ('de')) l(lang))"""


def fanout(spark, sf_dir):
    """J6, G2."""
    return _translations(spark, sf_dir).select("stream_id", "clause_id", "lang", F.md5("text").alias("text_md5"))


FANOUT_SQL = f"WITH {TRANSLATIONS_SQL} SELECT stream_id, clause_id, lang, md5('[' || lang || '] ' || text) AS text_md5 FROM tr"


def stale_drops(spark, sf_dir):
    """J5, F7."""
    return lanes.drop_stale(_translations(spark, sf_dir), _clauses(spark, sf_dir)).groupBy("stream_id", "lang").agg(F.count_if(F.col("drop") == "stale").alias("stale"), F.max("age_ms").alias("max_age_ms"))


STALE_SQL = f"WITH {TRANSLATIONS_SQL} SELECT stream_id, lang, count(*) FILTER (WHERE arrival_ms - closed_ms > 6000) AS stale, CAST(max(arrival_ms - closed_ms) AS BIGINT) AS max_age_ms FROM tr GROUP BY 1, 2"


def _lags(spark, sf_dir):
    t = lanes.translation_join(_clauses(spark, sf_dir), _translations(spark, sf_dir))
    at = (F.floor(F.col("arrival_ms") / 1000) * 1000).cast("long")
    return t.groupBy("stream_id", at.alias("at_ms"), "lang").agg(F.max("age_ms").alias("lag_ms"))


def lane_states(spark, sf_dir):
    """S14."""
    return lanes.degrade_policy(_lags(spark, sf_dir), languages(spark), 5000)


def lane_quality(spark, sf_dir):
    """A11, F7 with J9's lane states."""
    changes = lanes.degrade_policy(_lags(spark, sf_dir), languages(spark), 5000)
    return lanes.quality_counters(lanes.drop_stale(_translations(spark, sf_dir), _clauses(spark, sf_dir), changes), changes)


#: Time between two looks at the lanes.
LOOK_MS = 5000


def lane_lags(spark, sf_dir):
    """A10, at all looks that a clause is queued, pending, or lately shown at."""
    t = lanes.translation_join(_clauses(spark, sf_dir), _translations(spark, sf_dir))
    looks = F.sequence(F.ceil(F.col("closed_ms") / LOOK_MS).cast("long"), F.floor((F.col("arrival_ms") + 10_000) / LOOK_MS).cast("long"))
    t = t.withColumn("look", F.explode(looks)).withColumn("at_ms", F.col("look") * LOOK_MS).withColumn("ago_ms", F.col("at_ms") - F.col("arrival_ms"))
    queued = t.filter("ago_ms >= 0 and ago_ms < 3000").select("stream_id", "at_ms", "lang", F.col("ago_ms").alias("age_ms"))
    got = t.filter("ago_ms >= 0").select("stream_id", "at_ms", "lang", "ago_ms", F.col("age_ms").alias("latency_ms"))
    pending = t.filter("ago_ms < 0").select("stream_id", "at_ms", "lang", (F.col("at_ms") - F.col("closed_ms")).alias("age_ms"))
    return lanes.lane_lag(queued, got, pending)


LANE_LAG_SQL = f"""
WITH {TRANSLATIONS_SQL},
a AS (SELECT *, at_ms - arrival_ms AS ago FROM (SELECT *, unnest(generate_series(CAST(ceil(closed_ms / 5000.0) AS BIGINT), CAST(floor((arrival_ms + 10000) / 5000.0) AS BIGINT))) * 5000 AS at_ms FROM tr)),
q AS (SELECT stream_id, at_ms, lang, max(ago) AS q FROM a WHERE ago >= 0 AND ago < 3000 GROUP BY 1, 2, 3),
t AS (SELECT stream_id, at_ms, lang, arg_min(arrival_ms - closed_ms, ago) AS t FROM a WHERE ago >= 0 AND ago <= 10000 GROUP BY 1, 2, 3),
p AS (SELECT stream_id, at_ms, lang, max(at_ms - closed_ms) AS p FROM a WHERE ago < 0 AND at_ms - closed_ms <= 7000 GROUP BY 1, 2, 3)
SELECT stream_id, CAST(at_ms AS BIGINT) AS at_ms, lang, CAST(greatest(coalesce(q, 0), coalesce(t, 0), coalesce(p, 0)) AS BIGINT) AS lag_ms FROM q FULL JOIN t USING (stream_id, at_ms, lang) FULL JOIN p USING (stream_id, at_ms, lang)"""


def backlog(spark, sf_dir):
    """F8: a snapshot for each nine turns, queued by age."""
    c = table(spark, sf_dir, "conversations")
    rows = c.select(F.floor(F.col("turn") / 9).alias("snapshot"), F.col("conv_id").alias("stream_id"), F.lit("en").alias("lang"), F.col("turn").alias("seq"), "text", (F.col("turn") % 9).cast("double").alias("age_s"), F.lit(1.0).alias("lead_s"))
    return lanes.cap_backlog(rows).select("stream_id", "seq")


BACKLOG_SQL = """
SELECT stream_id, seq FROM (SELECT conv_id AS stream_id, turn AS seq, sum(length(text)) OVER (PARTITION BY conv_id, turn // 9 ORDER BY turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n
  FROM conversations WHERE turn % 9 <= 6) WHERE n / 40.0 + 1 <= 6"""


def _models(spark, sf_dir):
    """Models made of nations and regions: a model for each nation translates its language to two others."""
    n = table(spark, sf_dir, "nation")
    lang = lambda k: F.element_at(F.array(*[F.lit(x) for x in ("en", "es", "fr", "de", "pt", "it")]), (k % 6 + 1).cast("int"))
    key = F.col("n_nationkey")
    return n.select(F.concat(F.lit("m"), key.cast("string")).alias("id"), lang(key).alias("source"), F.array(lang(key * 5 + 1), lang(key * 7 + 2)).alias("targets"), (key % 3 == 0).alias("is_default"), (key % 2 == 0).alias("installed"), key.alias("position"))


def routes(spark, sf_dir):
    """J13."""
    m = _models(spark, sf_dir)
    langs = m.select(F.col("source").alias("source")).distinct()
    pairs = langs.join(langs.withColumnRenamed("source", "target"), F.col("source") != F.col("target"))
    return lanes.route_models(m, pairs).select("source", "target", F.array_join("hops", ">").alias("hops"), "via")


def pivots(spark, sf_dir):
    """Each turn of a conversation asks for all languages."""
    m = _models(spark, sf_dir)
    langs = m.select("source").distinct()
    r = lanes.route_models(m, langs.join(langs.withColumnRenamed("source", "target"), F.col("source") != F.col("target")))
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("stream_id"), F.col("turn").alias("clause_id"), F.lit("es").alias("source"), F.array(*[F.lit(x) for x in ("en", "fr", "de", "pt")]).alias("langs"))
    return lanes.pivot_plan(c, r).select("stream_id", "clause_id", F.array_join("direct", ",").alias("direct"), F.array_join("pivot", ",").alias("pivot"), "english_from_pivot")


# ---- audio, made of events


def _pcm(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    at = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    loud = F.when(F.col("event_type") == "error", 0).otherwise((F.col("value") * 100).cast("int") % 20_000)
    return e.select(F.col("user_id").alias("stream_id"), (at * 250).cast("long").alias("start_ms"), F.transform(F.sequence(F.lit(0), F.lit(39)), lambda i: F.when(i % 2 == 0, loud).otherwise(-loud).cast("smallint")).alias("samples"), F.col("event_type"))


def levels(spark, sf_dir):
    """A9, S16."""
    rows = audio.level_windows(_pcm(spark, sf_dir)).withColumn("end_ms", F.col("start_ms") + 250)
    return audio.silence_meter(rows, alert_s=0.5).select("stream_id", "end_ms", F.round("rms_dbfs", 6).alias("rms_dbfs"), F.round("peak_dbfs", 6).alias("peak_dbfs"), "silent_s", "alert")


LEVELS_SQL = """
WITH p AS (SELECT user_id AS stream_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) * 250 AS a, CASE WHEN event_type = 'error' THEN 0 ELSE CAST(trunc(value * 100) AS BIGINT) % 20000 END AS v FROM events),
l AS (SELECT stream_id, a + 250 AS end_ms, CASE WHEN v = 0 THEN -100.0 ELSE greatest(20 * log10(v / 32768.0), -100) END AS db FROM p),
s AS (SELECT *, coalesce(max(CASE WHEN db > -60 THEN end_ms END) OVER w, first(end_ms) OVER w - 250) AS loud FROM l WINDOW w AS (PARTITION BY stream_id ORDER BY end_ms))
SELECT stream_id, end_ms, round(db, 6) AS rms_dbfs, round(db, 6) AS peak_dbfs, (end_ms - loud) / 1000.0 AS silent_s, (end_ms - loud) / 1000.0 >= 0.5 AS alert FROM s"""


def audio_frames(spark, sf_dir):
    """Chunks of 40 samples to frames of 64."""
    out = audio.reframe_pcm(_pcm(spark, sf_dir).withColumn("start_ms", (F.col("start_ms") / 100).cast("long")), 64)
    return out.groupBy("stream_id").agg(F.count("*").alias("frames"), F.sum(F.size("samples")).alias("n_samples"))


AUDIO_FRAMES_SQL = "SELECT user_id AS stream_id, CAST(ceil(count(*) * 40 / 64.0) AS BIGINT) AS frames, count(*) * 40 AS n_samples FROM events GROUP BY 1"


def mono(spark, sf_dir):
    """Pairs of samples as two channels."""
    out = _pcm(spark, sf_dir).select("stream_id", "start_ms", audio.to_mono(F.col("samples"), 2, 1).alias("one"), audio.to_mono(F.col("samples"), 2).alias("mean"))
    return out.groupBy("stream_id").agg(F.sum(F.size("one")).alias("n"), F.sum(F.aggregate("one", F.lit(0).cast("long"), lambda a, x: a + x)).alias("total"), F.sum(F.aggregate("mean", F.lit(0).cast("long"), lambda a, x: a + x)).alias("mean_total"))


MONO_SQL = """
SELECT user_id AS stream_id, count(*) * 20 AS n, CAST(-20 * sum(CASE WHEN event_type = 'error' THEN 0 ELSE CAST(trunc(value * 100) AS BIGINT) % 20000 END) AS BIGINT) AS total, CAST(0 AS BIGINT) AS mean_total FROM events GROUP BY 1"""


def speech(spark, sf_dir):
    """Purchases and clicks are speech."""
    rows = _pcm(spark, sf_dir).select("stream_id", "start_ms", (F.col("start_ms") + 250).alias("end_ms"), F.col("event_type").isin("purchase", "click").alias("speech"))
    return audio.speech_intervals(rows, hangover_ms=600)


def outages(spark, sf_dir):
    """An hour without events is an outage; purchases are key rows."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("stream_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"), (F.col("event_type") == "purchase").alias("is_key"))
    return audio.outages(e, 36_000_000).withColumn("end_ms", F.coalesce("end_ms", F.lit(-1)))


OUTAGES_SQL = """
WITH e AS (SELECT user_id AS stream_id, epoch_us(ts) // 1000 AS at_ms, event_type = 'purchase' AS k FROM events),
g AS (SELECT *, lead(at_ms) OVER (PARTITION BY stream_id ORDER BY at_ms) - at_ms AS gap, min(CASE WHEN k THEN at_ms END) OVER (PARTITION BY stream_id ORDER BY at_ms ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS back FROM e)
SELECT stream_id, min(at_ms + 36000000) AS start_ms, coalesce(back, -1) AS end_ms FROM g WHERE gap >= 36000000 GROUP BY stream_id, back"""


def heartbeats(spark, sf_dir):
    """Users as workers."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("worker"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"))
    return audio.heartbeat_gaps(e, 18_000_000, 60_000_000)


def recoveries(spark, sf_dir):
    """Errors are losses, views the next ready."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("worker"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"), F.when(F.col("event_type") == "error", "lost").when(F.col("event_type") == "view", "ready").otherwise("other").alias("kind"))
    return audio.recovery_time(e)


RECOVERY_SQL = """
SELECT worker, at_ms AS lost_ms, (r - at_ms) / 1000.0 AS recovery_s FROM (
  SELECT user_id AS worker, event_type, epoch_us(ts) // 1000 AS at_ms, min(CASE WHEN event_type = 'view' THEN epoch_us(ts) // 1000 END) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS r FROM events)
WHERE event_type = 'error'"""

# ---- hypotheses


def _hypotheses(spark, sf_dir):
    """Passes over a whole turn: each hears six words more, and the newest word still wrong."""
    c = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("stream_id"), F.filter(F.split("text", r"\s+"), lambda w: w != "").alias("w")).filter("size(w) > 0")
    c = c.withColumn("pass_no", F.explode(F.sequence(F.lit(1), F.ceil(F.size("w") / 6).cast("int"))))
    n = F.least(F.col("pass_no") * 6, F.size("w"))
    heard = F.transform(F.slice("w", 1, n), lambda x, i: F.struct(F.when((i == n - 1) & (n < F.size("w")), F.concat(x, F.lit("x"))).otherwise(x).alias("text"), (i * 0.3).cast("double").alias("t0"), (i * 0.3 + 0.2).cast("double").alias("t1")))
    return c.select("stream_id", F.col("pass_no").cast("long").alias("pass_no"), F.lit(0.0).alias("buf_t0"), (n == F.size("w")).alias("final"), heard.alias("words"))


def committed_words(spark, sf_dir):
    """S3, S4."""
    return agree.commit_agreed(_hypotheses(spark, sf_dir)).groupBy("stream_id").agg(F.count("*").alias("n_words"), F.max("pass_no").alias("last_pass"))


def revisions(spark, sf_dir):
    """A18."""
    return agree.revision_rate(_hypotheses(spark, sf_dir)).select("stream_id", "passes", F.col("shown").cast("long").alias("shown"), F.col("revised").cast("long").alias("revised"), F.round("rate", 6).alias("rate"))


def token_words(spark, sf_dir):
    """Words cut into pieces of three letters."""
    w = words(spark, sf_dir).select("stream_id", "seq", F.posexplode(F.regexp_extract_all("text", F.lit(".{1,3}"), F.lit(0))).alias("p", "piece"))
    tokens = w.select("stream_id", (F.col("seq") * 1000 + F.col("p")).alias("i"), F.concat(F.when(F.col("p") == 0, "▁").otherwise(""), "piece").alias("token"), (F.col("seq") * 0.3 + F.col("p") * 0.01).alias("t"))
    out = agree.group_tokens(tokens)
    return out.select("stream_id", F.col("word").cast("long").alias("word"), "text")


TOKENS_SQL = f"WITH {WORDS_SQL} SELECT stream_id, seq AS word, text FROM words"


def late_suffixes(spark, sf_dir):
    """Versions of a word that grow letter by letter."""
    w = words(spark, sf_dir).filter("length(text) > 1").select("stream_id", F.col("seq").alias("word"), "text", F.explode(F.array(F.lit(0), F.lit(1))).alias("version"))
    v = w.select("stream_id", "word", "version", F.when(F.col("version") == 0, F.expr("substring(text, 1, length(text) - 1)")).otherwise(F.col("text")).alias("text"), F.lit(0.0).alias("t0"), F.lit(0.2).alias("t1"))
    return agree.late_suffix(v).select("stream_id", "word", F.col("version").cast("long").alias("version"), "emit", "emit_t0")


LATE_SQL = f"""
WITH {WORDS_SQL}
SELECT stream_id, seq AS word, CAST(0 AS BIGINT) AS version, substring(text, 1, length(text) - 1) AS emit, 0.0 AS emit_t0 FROM words WHERE length(text) > 1
UNION ALL SELECT stream_id, seq, 1, substring(text, length(text), 1), 0.2 FROM words WHERE length(text) > 1"""

# ---- texts and reports


def text_functions(spark, sf_dir):
    """T1, T5, T6, T13, T15, T18, T19 over documents."""
    d = table(spark, sf_dir, "documents")
    url = F.concat(F.lit("rtmp://host/app/k"), F.col("doc_id").cast("string"), F.lit("?key="), F.col("doc_id").cast("string"), F.lit("&a=1"))
    return d.select("doc_id", F.md5(T.html_escape(T.strip_tags(F.col("text")))).alias("escaped_md5"), T.decode_cap(F.col("text")).cast("long").alias("cap"), T.translatable(F.col("text")).alias("fits"), T.redact_url(url).alias("url"))


TEXT_SQL = r"""
SELECT doc_id, md5(replace(replace(replace(regexp_replace(regexp_replace(text, '<[^>]*(>|$)', '', 'g'), '\{[^}]*(\}|$)', '', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS escaped_md5,
       CAST(least(len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) * 4 + 16, 256) AS BIGINT) AS cap, octet_length(encode(text)) <= 4096 AS fits,
       'rtmp://host/app/***?key=***&a=1' AS url FROM documents"""


def folded_words(spark, sf_dir):
    """Folded words of all documents, counted."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.explode(T.tokens(F.col("text"))).alias("w")).groupBy(T.fold(F.col("w")).alias("word")).agg(F.count("*").alias("n"))


FOLD_SQL = r"""
SELECT word, count(*) AS n FROM (
  SELECT replace(replace(replace(translate(lower(w), 'àáâãäåāăąçćčĉċďđèéêëēĕėęěğĝġģìíîïĩīĭįıłľĺļñńňņòóôõöøōŏőŕřŗśšşŝșťţțùúûüũūŭůűųýÿŷźżž', 'aaaaaaaaacccccddeeeeeeeeeggggiiiiiiiiillllnnnnooooooooorrrssssstttuuuuuuuuuuyyyzzz'), 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe') AS word
  FROM (SELECT unnest(regexp_extract_all(text, '[\p{L}\p{N}]+')) AS w FROM documents)) GROUP BY 1"""


def cleaned_texts(spark, sf_dir):
    """T1, T6, T7, T10, T12, T20."""
    d = dealt(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", T.clean(F.col("text")).alias("t"))  # used five times
    t = F.col("t")
    return d.select("doc_id", F.length(t).cast("long").alias("n_clean"), F.size(T.split_sentences(t)).cast("long").alias("sentences"), F.size(T.content_words(t)).cast("long").alias("content_words"), F.size(T.wrap_lines(t, 32)).cast("long").alias("lines"), T.sentence_end(t).alias("ends"))


_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_ABBREVIATED = "|".join(a.replace(".", r"\.") for a in T.ABBREVIATIONS)
#: Few words of these texts have more than two lines of 32 characters.
CLEANED_SQL = rf"""
WITH d AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g'), ' ') AS t FROM documents),
w AS (SELECT *, regexp_replace(t, '([^ ]{{32}})([^ ])', '\1 \2', 'g') AS cut FROM d)
SELECT doc_id, length(t) AS n_clean, CASE WHEN t = '' THEN 0 ELSE 1 + len(regexp_extract_all(t, '[.!?] [\p{{Lu}}¿¡"“]')) - len(regexp_extract_all(t, '(?:{_ABBREVIATED}) [\p{{Lu}}¿¡"“]')) END AS sentences,
       len(list_filter(string_split_regex(lower(replace(t, '''', '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '' AND x NOT IN ({_STOP}))) AS content_words,
       len(regexp_extract_all(cut, '[^ ](?:.{{0,30}}[^ ])?(?: |$)')) AS lines, regexp_matches(t, '[.!?。！？…][»)\]"''”’」』）》]*$') AS ends FROM w"""


def joined_words(spark, sf_dir):
    """Turns joined from their words."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.filter(F.split("text", r"\s+"), lambda w: w != "").alias("w"))
    return c.select("conv_id", "turn", F.md5(T.join_words("w")).alias("text_md5"))


JOINED_SQL = r"""
SELECT conv_id, turn, md5(regexp_replace(array_to_string(list_filter(string_split_regex(text, '\s+'), lambda w: w <> ''), ' '), ' ([^\p{L}\p{N} ]+)( |$)', '\1\2', 'g')) AS text_md5 FROM conversations"""


def charsets(spark, sf_dir):
    """A17, T21."""
    return reports.charset_coverage(table(spark, sf_dir, "documents")).select("lang", "chars", F.round("covered", 6).alias("covered"), "unsupported")


def language_names(spark, sf_dir):
    """T25, T26 over the languages of documents."""
    d = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    return d.select("lang", "n", T.endonym(F.col("lang")).alias("name"), F.array_join(T.lang_formats(F.col("lang")), ",").alias("formats"), T.lang_note(F.col("lang")).alias("note"))


NAMES_SQL = """
SELECT lang, count(*) AS n, CASE lang WHEN 'en' THEN 'English' WHEN 'es' THEN 'Español' WHEN 'fr' THEN 'Français' WHEN 'de' THEN 'Deutsch' ELSE lang END AS name,
       'cea608,cea708,webvtt' AS formats, CAST(NULL AS VARCHAR) AS note FROM documents GROUP BY lang"""


def _runs(spark, sf_dir):
    t = _translations(spark, sf_dir)
    n = F.length("text")
    return t.select(F.concat(F.lit("r"), (F.col("stream_id") % 3).cast("string")).alias("run"), F.col("clause_id").cast("string").alias("id"), "lang", F.substr("text", F.lit(6)).alias("src"), F.col("text").alias("out"), F.when(F.col("clause_id") % 5 == 0, "fragment").otherwise("full").alias("kind"), F.substr("text", F.lit(6)).alias("ref"), (n % 97).cast("double").alias("ms"), (n % 131).cast("double").alias("req_ms"), (n % 17).cast("double").alias("ttft_ms"), (n % 40).cast("int").alias("n_out"), F.when(n % 50 == 0, "max").otherwise("").alias("cap"), (F.col("stream_id") * 1000 + F.col("clause_id")).alias("line"))


def run_report(spark, sf_dir):
    """A15."""
    out = reports.mt_run_report(_runs(spark, sf_dir))
    return out.select("run", "lang", "n", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "max", "ttft_p50", "req_p50", "req_p95", "req_max", "tokens_per_s")], "capped")


def failure_labels(spark, sf_dir):
    """A16."""
    return reports.label_failures(_runs(spark, sf_dir)).groupBy("run", "lang", "label").agg(F.count("*").alias("n"))


def translated(spark, sf_dir):
    """G1 with the stand-in model."""

    def make():
        return lambda texts, lang: [f"[{lang}] {t}" for t in texts]

    t = lanes.fanout_targets(_clauses(spark, sf_dir), languages(spark)).select("stream_id", "id", "lang", "text")
    return reports.translate(t, make).groupBy("lang", "error").agg(F.count("*").alias("n"), F.sum(F.length("out")).alias("chars"))


TRANSLATED_SQL = rf"""
WITH t AS (SELECT trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS t FROM conversations),
n AS (SELECT t, CASE WHEN t = '' THEN 0 ELSE 1 + len(regexp_extract_all(t, '[.!?]\s[\p{{Lu}}¿¡"“]')) - len(regexp_extract_all(t, '(?:{_ABBREVIATED})\s[\p{{Lu}}¿¡"“]')) END AS n FROM t)
SELECT lang, CASE WHEN n = 0 THEN 'empty' END AS error, count(*) AS n, CAST(sum(CASE WHEN n > 0 THEN length(t) + 5 * n END) AS BIGINT) AS chars FROM n, (SELECT unnest(['es', 'fr', 'de']) AS lang) GROUP BY 1, 2"""


#: Stand-in models: each puts one letter for another.
MODELS = {"es-en": "aá", "fr-en": "eé", "en-de": "ií", "en-fr": "oó", "es-de": "uú"}


def translated_routes(spark, sf_dir):
    """G1 by J13's routes: turns in three languages into four, some through English, some not at all."""
    swap = dict(MODELS)  # goes to the workers

    def make():
        return lambda texts, model: [t.replace(*swap[model]) for t in texts]

    models = spark.createDataFrame([(m, m[:2], [m[3:]], True, True, k) for k, m in enumerate(MODELS)], "id string, source string, targets array<string>, is_default boolean, installed boolean, position long")
    codes = [F.lit(x) for x in ("es", "fr", "en")]
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.element_at(F.array(*codes), (F.col("conv_id") % 3 + 1).cast("int")).alias("source"), T.clean(F.col("text")).alias("text"))
    turns = turns.withColumn("langs", F.filter(F.array(*[F.lit(x) for x in ("en", "de", "fr", "it")]), lambda x: x != F.col("source")))
    pairs = spark.createDataFrame([(a, b) for a in ("es", "fr", "en") for b in ("en", "de", "fr", "it") if a != b], "source string, target string")
    out = reports.translate_routes(turns, lanes.route_models(models, pairs), make, ["conv_id", "turn"])
    return out.select("conv_id", "turn", "source", "lang", "via", F.md5("out").alias("out_md5"), "error")


TRANSLATED_ROUTES_SQL = r"""
WITH t AS (SELECT conv_id, turn, ['es', 'fr', 'en'][conv_id % 3 + 1] AS source, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM conversations),
w AS (SELECT *, unnest(list_filter(['en', 'de', 'fr', 'it'], lambda x: x <> source)) AS lang FROM t),
o AS (SELECT conv_id, turn, source, lang, CASE WHEN source <> 'en' AND lang = 'fr' OR source = 'fr' AND lang = 'de' THEN 'en' END AS via,
        CASE WHEN source = 'es' AND lang = 'de' THEN replace(t, 'u', 'ú') ELSE
          CASE lang WHEN 'de' THEN replace(h, 'i', 'í') WHEN 'fr' THEN replace(h, 'o', 'ó') WHEN 'en' THEN h END END AS o
      FROM (SELECT *, CASE source WHEN 'es' THEN replace(t, 'a', 'á') WHEN 'fr' THEN replace(t, 'e', 'é') ELSE t END AS h FROM w))
SELECT conv_id, turn, source, lang, via, md5(nullif(o, '')) AS out_md5, CASE WHEN o IS NULL THEN 'no route' WHEN o = '' THEN 'empty' END AS error FROM o"""


def soak(spark, sf_dir):
    """One-hour blocks of events."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("stream_id"), F.col("ts").cast("timestamp").alias("ts"), "value", "event_id", "user_id")
    return reports.soak_blocks(e, "value", "ts", 60, ["event_id"], "user_id")


SOAK_SQL = """
SELECT event_type AS stream_id, date_trunc('hour', ts) AS block, count(*) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.99) AS p99, max(value) AS max, arg_min(value, ts) AS first, arg_max(value, ts) AS last,
       max(event_id) - min(event_id) AS event_id_delta, count(DISTINCT user_id) AS sessions FROM events GROUP BY 1, 2"""


def run_table(spark, sf_dir):
    """J16, A19, A21."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("run"), F.col("value").alias("compute_s"), F.lit(10.0).alias("audio_s"), (F.col("value") * 2).alias("now_s"), F.col("value").alias("fed_s"), "props")
    junk = reports.junk_rate(e.filter("run <> 'error'"), ["run"], "props")
    out = reports.run_summary(e.select("run").distinct(), {"speed": reports.rtf(e), "junk": junk})
    return out.select("run", F.round("speed_rtf", 6).alias("speed_rtf"), "speed_backlog_s", "junk_lines", "junk_words")


RUN_TABLE_SQL = r"""
WITH r AS (SELECT event_type AS run, round(sum(value) / (10.0 * count(*)), 6) AS speed_rtf, max(value * 2 - value) AS speed_backlog_s FROM events GROUP BY 1),
j AS (SELECT event_type AS run, count(*) AS junk_lines, CAST(sum(len(list_filter(string_split_regex(props, '\s+'), lambda w: w <> ''))) AS BIGINT) AS junk_words FROM events WHERE event_type <> 'error' GROUP BY 1)
SELECT run, speed_rtf, speed_backlog_s, junk_lines, junk_words FROM r LEFT JOIN j USING (run)"""


def event_feed(spark, sf_dir):
    """K7."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    return sinks.event_feed(e, "line")


FEED_SQL = """SELECT '{"type":"line","event_id":' || event_id || ',"event_type":"' || event_type || '"}' AS value FROM events"""


def parsed_messages(spark, sf_dir):
    """R2: words messages made of turns, and lines that aren't messages."""
    c = table(spark, sf_dir, "conversations")
    w = F.transform(F.filter(F.split("text", r"\s+"), lambda x: x != ""), lambda x, i: F.struct(x.alias("text"), i.cast("long").alias("start_ms"), (i + 1).cast("long").alias("end_ms")))
    line = F.when(F.col("turn") % 7 == 3, F.lit("{broken")).otherwise(F.to_json(F.struct(F.lit("words").alias("type"), w.alias("words"), F.col("turn").alias("seq"))))
    good, bad = readers.parse_messages(c.select(F.col("conv_id").cast("string").alias("stream_id"), line.alias("value")))
    n_bad = bad.groupBy("stream_id").agg(F.count("*").alias("rejects"))
    return readers.message_words(good).groupBy("stream_id").agg(F.count("*").alias("n_words"), F.max("end_ms").alias("last")).join(n_bad, "stream_id", "left")


MESSAGES_SQL = r"""
WITH c AS (SELECT CAST(conv_id AS VARCHAR) AS stream_id, turn, len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) AS n FROM conversations),
w AS (SELECT stream_id, CAST(sum(n) AS BIGINT) AS n_words, CAST(max(n) AS BIGINT) AS last FROM c WHERE turn % 7 <> 3 AND n > 0 GROUP BY 1),
b AS (SELECT stream_id, count(*) AS rejects FROM c WHERE turn % 7 = 3 GROUP BY 1)
SELECT stream_id, n_words, last, rejects FROM w LEFT JOIN b USING (stream_id)"""


def turn_context(spark, sf_dir):
    """The two turns before."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), "turn", "text")
    return stats.previous_context(c, 2, ["turn"]).select("doc", "turn", F.md5(F.array_join("context", "|")).alias("context_md5"))


def catalogue(spark, sf_dir):
    """Parts as models. User models are variants of the one before, in chains that begin at a model that isn't there."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("position"), F.lit("en").alias("source"), F.when(F.col("p_partkey") % 50 > 0, F.array(F.lit("de"))).alias("targets"))
    name = lambda c: F.concat(F.lit("m"), c)
    k = F.col("position")
    base = p.filter("position % 5 = 0").select(name(k).alias("id"), "source", F.array(F.lit("de")).alias("targets"), F.when(k % 10 == 0, name(k + 1)).alias("variant_of"), "position")
    user = p.filter("position % 3 > 0").select(name(k).alias("id"), "source", "targets", F.when(k % 40 > 1, name(k - 1 - (k % 3 == 1).cast("int"))).otherwise(F.when(k % 40 == 1, F.lit("nothing"))).alias("variant_of"), "position")
    rows, skipped = lanes.merge_catalogue(base, user)
    return rows.select("id", "variant_of", F.lit(None).cast("string").alias("reason")).unionByName(skipped.select("id", "variant_of", "reason"))


CATALOGUE_SQL = """
WITH RECURSIVE p AS (SELECT p_partkey AS k FROM part),
u AS (SELECT 'm' || k AS id, CASE WHEN k % 40 > 1 THEN 'm' || (k - 1 - CASE WHEN k % 3 = 1 THEN 1 ELSE 0 END) WHEN k % 40 = 1 THEN 'nothing' END AS variant_of, k % 50 = 0 AS bad FROM p WHERE k % 3 > 0),
b AS (SELECT 'm' || k AS id, CASE WHEN k % 10 = 0 THEN 'm' || (k + 1) END AS variant_of FROM p WHERE k % 5 = 0 AND NOT EXISTS (SELECT 1 FROM u WHERE u.id = 'm' || k AND NOT bad)),
o AS (SELECT id, variant_of FROM u WHERE NOT bad),
g AS (SELECT id FROM o WHERE variant_of IS NOT NULL AND variant_of NOT IN (SELECT id FROM o UNION ALL SELECT id FROM b)
      UNION SELECT o.id FROM o JOIN g ON o.variant_of = g.id)
SELECT id, variant_of, NULL AS reason FROM b UNION ALL SELECT id, variant_of, CASE WHEN id IN (SELECT id FROM g) THEN 'unknown variant' END FROM o
UNION ALL SELECT id, variant_of, 'no targets' FROM u WHERE bad"""


def source_context(spark, sf_dir):
    """In each language's documents, in order, the three before of the same source, back to the first other one."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.floor(F.col("doc_id") * 7 % 23 / 8).alias("doc"), F.md5("text").alias("text"))
    return stats.previous_context(d, 3, ["doc_id"], by=["lang"]).select("doc_id", F.array_join("context", "|").alias("context"))


SOURCE_CONTEXT_SQL = """
WITH d AS (SELECT doc_id, lang, md5(text) AS h, doc_id * 7 % 23 // 8 AS doc FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - row_number() OVER (PARTITION BY lang, doc ORDER BY doc_id) AS stretch FROM d)
SELECT doc_id, coalesce(string_agg(h, '|') OVER (PARTITION BY lang, doc, stretch ORDER BY doc_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), '') AS context FROM n"""

CONTEXT_SQL = """
SELECT conv_id AS doc, turn, md5(coalesce(string_agg(text, '|') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), '')) AS context_md5 FROM conversations"""


def retimed_turns(spark, sf_dir):
    """W2."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("turn") * 2 + F.length("text") % 2).alias("start"), F.lit(0).cast("long").alias("end"))
    return stats.next_start_as_end(c, ["conv_id"], ["turn"]).select("conv_id", "turn", "start", "end")


RETIMED_SQL = 'SELECT conv_id, turn, s AS start, coalesce(lead(s) OVER (PARTITION BY conv_id ORDER BY turn), s) AS "end" FROM (SELECT conv_id, turn, turn * 2 + length(text) % 2 AS s FROM conversations)'

DELTAS_SQL = """
WITH e AS (SELECT conv_id, turn, lane, turn * 1000000000 + lane * (700000000 + length(text) * 100000) AS wall, CAST(length(text) % 30 AS DOUBLE) AS wait
           FROM conversations, (VALUES (0), (1), (2)) l(lane) WHERE NOT (lane > 0 AND turn % 11 = 3)),
j AS (SELECT l.lane, s.turn, e.wait, (e.wall - s.wall) / 1e9 AS d FROM (SELECT * FROM e WHERE lane = 0) s CROSS JOIN (VALUES (1), (2)) l(lane)
      LEFT JOIN e ON e.conv_id = s.conv_id AND e.turn = s.turn AND e.lane = l.lane),
r AS (SELECT *, row_number() OVER (PARTITION BY lane ORDER BY d NULLS LAST) - 1 AS i, count(d) OVER (PARTITION BY lane) AS n FROM j)
SELECT lane, count(*) AS clauses, count(*) FILTER (WHERE d IS NULL) AS missing, round(avg(wait), 6) AS mean_wait_ms,
       round(max(d) FILTER (WHERE i = CAST(floor(0.5 * (n - 1) + 0.5) AS BIGINT)), 6) AS p50, round(max(d) FILTER (WHERE i = CAST(floor(0.95 * (n - 1) + 0.5) AS BIGINT)), 6) AS p95 FROM r GROUP BY 1"""

HEARTBEATS_SQL = """
WITH e AS (SELECT user_id AS worker, epoch_us(ts) // 1000 AS at_ms FROM events),
g AS (SELECT *, sum(CASE WHEN gap > 18000000 THEN 1 ELSE 0 END) OVER (PARTITION BY worker ORDER BY at_ms) AS spell FROM (SELECT *, at_ms - lag(at_ms) OVER (PARTITION BY worker ORDER BY at_ms) AS gap FROM e)),
s AS (SELECT worker, spell, min(at_ms) AS a, max(at_ms) AS z FROM g GROUP BY 1, 2),
l AS (SELECT *, sum(CASE WHEN pz - pa >= 60000000 THEN 1 ELSE 0 END) OVER (PARTITION BY worker ORDER BY spell) AS grp FROM (SELECT *, lag(a) OVER w AS pa, lag(z) OVER w AS pz FROM s WINDOW w AS (PARTITION BY worker ORDER BY spell))),
k AS (SELECT *, row_number() OVER (PARTITION BY worker, grp ORDER BY spell) - 1 AS restarts FROM l)
SELECT worker, CAST(spell AS BIGINT) AS spell, a AS start_ms, z AS end_ms, restarts, CASE WHEN spell = 0 THEN 0.0 ELSE least(0.5 * pow(2.0, restarts), 10.0) END AS wait_s FROM k"""

NEAREST_SQL = f"""
WITH {WORDS_SQL},
w AS (SELECT stream_id, seq, start_ms / 1000.0 AS t, lower(regexp_replace(text, '[^\\p{{L}}\\p{{N}}'']+', '', 'g')) AS k FROM words),
d AS (SELECT a.stream_id, a.seq, arg_min(a.t - (b.t + 0.1), abs(a.t - (b.t + 0.1))) AS d FROM w a JOIN w b ON a.stream_id = b.stream_id AND a.k = b.k AND abs(a.t - (b.t + 0.1)) <= 3.0 WHERE a.k <> '' GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY d) - 1 AS i, count(*) OVER (PARTITION BY stream_id) AS n FROM d)
SELECT stream_id, count(*) AS n, round(max(d) FILTER (WHERE i = CAST(floor(0.05 * (n - 1)) AS BIGINT)), 6) AS p5, round(max(d) FILTER (WHERE i = CAST(floor(0.5 * (n - 1)) AS BIGINT)), 6) AS p50,
       round(max(d) FILTER (WHERE i = CAST(floor(0.95 * (n - 1)) AS BIGINT)), 6) AS p95 FROM r GROUP BY 1"""

REVISIONS_SQL = r"""
WITH c AS (SELECT conv_id || '-' || turn AS stream_id, list_filter(string_split_regex(text, '\s+'), lambda w: w <> '') AS w FROM conversations),
p AS (SELECT stream_id, w, len(w) AS m, unnest(generate_series(1, CAST(ceil(len(w) / 6.0) AS BIGINT))) AS k FROM c WHERE len(w) > 0)
SELECT stream_id, count(*) AS passes, CAST(sum(least(k * 6, m)) AS BIGINT) AS shown, count(*) - 1 AS revised, round((count(*) - 1) / sum(least(k * 6, m)), 6) AS rate FROM p GROUP BY 1"""

VTT_SQL = f"""
WITH {CUES_SQL}, {SEGMENTS_SQL},
o AS (SELECT stream_id, seq, greatest(s, start) - s AS a, least(e, end_) - s AS z, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS t FROM segs JOIN cues USING (stream_id)
      WHERE end_ > s AND start < e AND least(e, end_) - greatest(s, start) >= 90),
b AS (SELECT stream_id, seq, string_agg(printf('%02d:%02d:%02d.%03d --> %02d:%02d:%02d.%03d', a // 324000000, (a // 5400000) % 60, (a // 90000) % 60, (a // 90) % 1000, z // 324000000, (z // 5400000) % 60, (z // 90000) % 60, (z // 90) % 1000)
        || chr(10) || t || chr(10), chr(10) ORDER BY a, t) AS body FROM o GROUP BY 1, 2),
v AS (SELECT g.stream_id, g.seq, 'WEBVTT' || chr(10) || 'X-TIMESTAMP-MAP=MPEGTS:' || (g.s % 8589934592) || ',LOCAL:00:00:00.000' || chr(10) || chr(10) || coalesce(b.body, '') AS body FROM segs g LEFT JOIN b USING (stream_id, seq))
SELECT stream_id, 'en' AS lang, seq, md5(body) AS body_md5, length(body) AS n_chars FROM v"""

PUBLISHED_SQL = VTT_SQL.replace("SELECT stream_id, 'en' AS lang, seq, md5(body) AS body_md5, length(body) AS n_chars FROM v", """SELECT stream_id, 'en' AS lang, seq, md5(body) AS body_md5 FROM v
UNION ALL SELECT stream_id, 'fr', seq, md5('WEBVTT' || chr(10) || 'X-TIMESTAMP-MAP=MPEGTS:' || (s % 8589934592) || ',LOCAL:00:00:00.000' || chr(10) || chr(10)) FROM segs""")

SPEECH_SQL = """
WITH RECURSIVE p AS (SELECT user_id AS stream_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) * 250 AS a, event_type IN ('purchase', 'click') AS speech FROM events),
b AS (SELECT stream_id, a, sum(CASE WHEN due = a THEN 0 ELSE 1 END) OVER (PARTITION BY stream_id ORDER BY a) AS run FROM (SELECT stream_id, a, lag(a + 250) OVER (PARTITION BY stream_id ORDER BY a) AS due FROM p WHERE speech)),
r AS (SELECT stream_id, run, min(a) AS a, max(a) + 250 AS z FROM b GROUP BY 1, 2),
m AS (SELECT stream_id, run, greatest(a - 600, 0) AS s, z FROM r WHERE run = 1
      UNION ALL SELECT r.stream_id, r.run, CASE WHEN r.a - m.z < 600 AND r.a - m.s < 60000 THEN m.s ELSE greatest(r.a - 600, m.z, 0) END, r.z FROM m JOIN r ON r.stream_id = m.stream_id AND r.run = m.run + 1)
SELECT stream_id, s AS start_ms, max(z) AS end_ms FROM m GROUP BY 1, 2"""

#: Lanes are paused in the order de, fr, es and come back in reverse, so their number is the state.
STATES_SQL = f"""{TRANSLATIONS_SQL},
g AS (SELECT stream_id, (arrival_ms // 1000) * 1000 AS at_ms, max(CASE WHEN lang = 'de' THEN arrival_ms - closed_ms END) AS de, max(CASE WHEN lang = 'fr' THEN arrival_ms - closed_ms END) AS fr, max(CASE WHEN lang = 'es' THEN arrival_ms - closed_ms END) AS es FROM tr GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY at_ms) AS k FROM g),
st AS (SELECT stream_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS at_ms, 0 AS was, 0 AS p, CAST(NULL AS BIGINT) AS changed, CAST(NULL AS BIGINT) AS calm FROM (SELECT DISTINCT stream_id FROM k)
  UNION ALL
  SELECT stream_id, k, at_ms, was, was + up - down, CASE WHEN up + down > 0 THEN at_ms ELSE changed END, calm FROM (
    SELECT *, CASE WHEN worst > 5000 AND was < 3 AND (changed IS NULL OR at_ms - changed >= 3000) THEN 1 ELSE 0 END AS up,
           CASE WHEN 2 * worst < 5000 AND was > 0 AND at_ms - calm >= 10000 AND (changed IS NULL OR at_ms - changed >= 10000) THEN 1 ELSE 0 END AS down FROM (
      SELECT *, CASE WHEN worst > 5000 THEN NULL WHEN 2 * worst < 5000 THEN coalesce(quiet, at_ms) END AS calm FROM (
        SELECT k.stream_id, k.k, k.at_ms, st.p AS was, st.changed, st.calm AS quiet,
               coalesce(greatest(CASE WHEN st.p < 1 THEN de END, CASE WHEN st.p < 2 THEN fr END, CASE WHEN st.p < 3 THEN es END), 0) AS worst FROM st JOIN k ON k.stream_id = st.stream_id AND k.k = st.k + 1)))),
ch AS (SELECT stream_id, at_ms AS changed_ms, CASE greatest(was, p) WHEN 1 THEN 'de' WHEN 2 THEN 'fr' ELSE 'es' END AS lang, p > was AS paused FROM st WHERE p <> was)"""

LANE_STATES_SQL = f"WITH RECURSIVE {STATES_SQL} SELECT stream_id, changed_ms, lang, paused FROM ch"

LANE_QUALITY_SQL = f"""
WITH RECURSIVE {STATES_SQL},
d AS (SELECT tr.stream_id, tr.lang, arrival_ms - closed_ms > 6000 AS stale, coalesce((SELECT arg_max(ch.paused, ch.changed_ms) FROM ch WHERE ch.stream_id = tr.stream_id AND ch.lang = tr.lang AND ch.changed_ms <= tr.arrival_ms), false) AS paused FROM tr),
t AS (SELECT stream_id, lang, count(*) FILTER (WHERE NOT stale AND NOT paused) AS shown, count(*) FILTER (WHERE stale) AS stale, count(*) FILTER (WHERE NOT stale AND paused) AS paused_drops FROM d GROUP BY 1, 2)
SELECT t.stream_id, t.lang, shown, stale, paused_drops, coalesce(pauses, 0) AS pauses FROM t LEFT JOIN (SELECT stream_id, lang, count(*) FILTER (WHERE paused) AS pauses FROM ch GROUP BY 1, 2) c ON c.stream_id = t.stream_id AND c.lang = t.lang"""

_LANG = "['en', 'es', 'fr', 'de', 'pt', 'it'][CAST(({}) % 6 + 1 AS BIGINT)]"
_ROUTES = f"""
models AS (SELECT 'm' || n_nationkey AS id, {_LANG.format('n_nationkey')} AS source, n_nationkey % 3 = 0 AS std, n_nationkey % 2 = 0 AS inst, n_nationkey AS pos, unnest([{_LANG.format('n_nationkey * 5 + 1')}, {_LANG.format('n_nationkey * 7 + 2')}]) AS target FROM nation),
best AS (SELECT * FROM models QUALIFY row_number() OVER (PARTITION BY source, target ORDER BY (inst AND std) DESC, inst DESC, std DESC, pos) = 1),
langs AS (SELECT DISTINCT source AS l FROM models),
found AS (SELECT s.l AS source, t.l AS target, d.id AS d, d.inst AS d_in, a.id AS a, b.id AS b, a.inst AND b.inst AS ab_in FROM langs s JOIN langs t ON s.l <> t.l
  LEFT JOIN best d ON d.source = s.l AND d.target = t.l LEFT JOIN best a ON a.source = s.l AND a.target = 'en' LEFT JOIN best b ON b.source = 'en' AND b.target = t.l),
routes AS (SELECT source, target, CASE WHEN d_in THEN d WHEN ab_in THEN a || '>' || b WHEN d IS NOT NULL THEN d WHEN a IS NOT NULL AND b IS NOT NULL THEN a || '>' || b END AS hops FROM found)"""

ROUTES_SQL = f"WITH {_ROUTES} SELECT source, target, hops, CASE WHEN contains(hops, '>') THEN 'en' END AS via FROM routes"

PIVOTS_SQL = f"""
WITH {_ROUTES},
w AS (SELECT t.target, CASE WHEN hops IS NULL THEN 0 WHEN contains(hops, '>') THEN 2 ELSE 1 END AS n FROM (VALUES ('en'), ('fr'), ('de'), ('pt')) t(target) LEFT JOIN routes r ON r.source = 'es' AND r.target = t.target),
p AS (SELECT bool_or(n = 2) AND bool_or(n = 1 AND target = 'en') AS shared, coalesce(string_agg(target, ',' ORDER BY target) FILTER (WHERE n = 2), '') AS "pivot",
             coalesce(string_agg(target, ',' ORDER BY target) FILTER (WHERE n = 1), '') AS direct, coalesce(string_agg(target, ',' ORDER BY target) FILTER (WHERE n = 1 AND target <> 'en'), '') AS others FROM w)
SELECT conv_id AS stream_id, turn AS clause_id, CASE WHEN shared THEN others ELSE direct END AS direct, "pivot", shared AS english_from_pivot FROM conversations, p"""

COMMITTED_SQL = r"""
SELECT stream_id, n_words, CAST(ceil(m / 6.0) AS BIGINT) AS last_pass FROM (
  SELECT conv_id || '-' || turn AS stream_id, len(w) AS m, len(list_filter(w, lambda x: regexp_matches(x, '[\p{L}\p{N}'']'))) AS n_words
  FROM (SELECT conv_id, turn, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM conversations)) WHERE n_words > 0"""

PLAYLISTS_SQL = f"""
WITH {SEGMENTS_SQL}
SELECT stream_id, lang, md5('#EXTM3U' || chr(10) || '#EXT-X-VERSION:3' || chr(10) || '#EXT-X-TARGETDURATION:2' || chr(10) || '#EXT-X-MEDIA-SEQUENCE:0' || chr(10) || string_agg('#EXTINF:2.00000,' || chr(10) || lang || '_' || seq || '.vtt', chr(10) ORDER BY seq) || chr(10)) AS body_md5
FROM segs, (VALUES ('en'), ('es'), ('fr'), ('de')) l(lang) GROUP BY 1, 2"""

MASTER_SQL = """
SELECT stream_id, '#EXTM3U' || chr(10) || lines || chr(10) || '#EXT-X-STREAM-INF:BANDWIDTH=1,SUBTITLES="subs"' || chr(10) || 'video.m3u8' || chr(10) AS body FROM (SELECT DISTINCT conv_id AS stream_id FROM conversations),
  (SELECT string_agg('#EXT-X-MEDIA:TYPE=SUBTITLES,GROUP-ID="subs",NAME="' || name || '",LANGUAGE="' || code || '",DEFAULT=' || flag || ',AUTOSELECT=YES,URI="' || code || '.m3u8"', chr(10) ORDER BY position) AS lines
   FROM (VALUES (0, 'en', 'English', 'YES'), (1, 'es', 'Español', 'NO'), (2, 'fr', 'Français', 'NO'), (3, 'de', 'Deutsch', 'NO')) l(position, code, name, flag))"""

_RUNS = """
r AS (SELECT 'r' || (conv_id % 3) AS run, turn AS id, lang, length(text) + 5 AS n, conv_id * 1000 + turn AS line FROM conversations, (VALUES ('es'), ('fr'), ('de')) l(lang))"""


def _ranks(**names: float) -> str:
    return ", ".join(f"max(v) FILTER (WHERE i = CAST(floor({p} * (c - 1) + 0.5) AS BIGINT)) AS {n}" for n, p in names.items())


RUN_REPORT_SQL = f"""
WITH {_RUNS},
m AS (SELECT run, lang, count(*) AS n, {_ranks(p50=0.5, p95=0.95, max=1.0)} FROM (SELECT run, lang, CAST(n % 97 AS DOUBLE) AS v, row_number() OVER (PARTITION BY run, lang ORDER BY n % 97) - 1 AS i, count(*) OVER (PARTITION BY run, lang) AS c FROM r) GROUP BY 1, 2),
f AS (SELECT run, lang, {_ranks(ttft_p50=0.5)} FROM (SELECT run, lang, CAST(n % 17 AS DOUBLE) AS v, row_number() OVER (PARTITION BY run, lang ORDER BY n % 17) - 1 AS i, count(*) OVER (PARTITION BY run, lang) AS c FROM r) GROUP BY 1, 2),
q AS (SELECT run, lang, {_ranks(req_p50=0.5, req_p95=0.95, req_max=1.0)} FROM (SELECT run, lang, CAST(n % 131 AS DOUBLE) AS v, row_number() OVER (PARTITION BY run, lang ORDER BY n % 131) - 1 AS i, count(*) OVER (PARTITION BY run, lang) AS c
      FROM (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY run, lang, id ORDER BY line DESC) = 1)) GROUP BY 1, 2),
s AS (SELECT run, lang, round(1000.0 * sum(n % 40) / sum(n % 97), 6) AS tokens_per_s, count(*) FILTER (WHERE n % 50 = 0) AS capped FROM r GROUP BY 1, 2)
SELECT run, lang, n, p50, p95, max, ttft_p50, req_p50, req_p95, req_max, tokens_per_s, capped FROM m JOIN f USING (run, lang) JOIN q USING (run, lang) JOIN s USING (run, lang)"""

CHARSETS_SQL = f"""
WITH c AS (SELECT lang, unnest(regexp_extract_all(text, '(?s).')) AS ch FROM documents),
k AS (SELECT lang, ch, count(*) AS n, (unicode(ch) BETWEEN 32 AND 126) OR contains('{T.CAPTION_608_EXTRA}', ch) AS ok FROM c GROUP BY 1, 2),
t AS (SELECT lang, string_agg(ch, '' ORDER BY n DESC, ch) AS unsupported FROM (SELECT * FROM k WHERE NOT ok QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, ch) <= 10) GROUP BY 1)
SELECT k.lang, CAST(sum(n) AS BIGINT) AS chars, round(coalesce(sum(n) FILTER (WHERE ok), 0) / sum(n), 6) AS covered, coalesce(any_value(unsupported), '') AS unsupported FROM k LEFT JOIN t ON t.lang IS NOT DISTINCT FROM k.lang GROUP BY 1"""

QUERIES = {
    "cue_overlap": cue_overlap, "vtt_bodies": vtt_bodies, "playlists": playlists, "master_playlists": master_playlists, "cue_tracks": cue_tracks, "simple_cues": simple_cues, "srt_round_trip": srt_round_trip,
    "playlist_round_trip": playlist_round_trip, "published_subtitles": published_subtitles, "emission_tails": emission_tails, "segment_ends": segment_ends, "clip_lags": clip_lags, "caption_lag": caption_lag, "utterance_lags": utterance_lags,
    "nearest_words": nearest_words, "closest_lines": closest_lines, "first_lines": first_lines, "translation_deltas": translation_deltas, "turn_wer": turn_wer, "missing_turns": missing_turns,
    "fanout": fanout, "stale_drops": stale_drops, "lane_states": lane_states, "lane_quality": lane_quality, "lane_lags": lane_lags, "backlog": backlog, "routes": routes, "pivots": pivots, "levels": levels,
    "audio_frames": audio_frames, "mono": mono, "speech": speech, "outages": outages, "heartbeats": heartbeats, "recoveries": recoveries, "committed_words": committed_words, "revisions": revisions,
    "token_words": token_words, "late_suffixes": late_suffixes, "text_functions": text_functions, "folded_words": folded_words, "cleaned_texts": cleaned_texts, "joined_words": joined_words,
    "charsets": charsets, "language_names": language_names, "run_report": run_report, "failure_labels": failure_labels, "translated": translated, "translated_routes": translated_routes, "soak": soak, "run_table": run_table,
    "event_feed": event_feed, "parsed_messages": parsed_messages, "turn_context": turn_context, "source_context": source_context, "catalogue": catalogue, "retimed_turns": retimed_turns,
}
SQL = {
    "turn_wer": TURN_WER_SQL, "translated": TRANSLATED_SQL, "cleaned_texts": CLEANED_SQL, "cue_tracks": CUE_TRACKS_SQL, "translated_routes": TRANSLATED_ROUTES_SQL, "translation_deltas": DELTAS_SQL, "heartbeats": HEARTBEATS_SQL, "nearest_words": NEAREST_SQL, "revisions": REVISIONS_SQL, "vtt_bodies": VTT_SQL, "published_subtitles": PUBLISHED_SQL,
    "cue_overlap": OVERLAP_SQL, "simple_cues": SIMPLE_SQL, "srt_round_trip": SRT_SQL, "playlist_round_trip": PLAYLIST_SQL, "emission_tails": EMISSION_SQL, "segment_ends": SEGMENT_ENDS_SQL, "clip_lags": CLIP_SQL,
    "caption_lag": LAG_NOW_SQL, "first_lines": FIRST_LINES_SQL, "missing_turns": MISSING_SQL, "fanout": FANOUT_SQL, "stale_drops": STALE_SQL, "lane_lags": LANE_LAG_SQL, "backlog": BACKLOG_SQL, "levels": LEVELS_SQL,
    "audio_frames": AUDIO_FRAMES_SQL, "mono": MONO_SQL, "outages": OUTAGES_SQL, "recoveries": RECOVERY_SQL, "token_words": TOKENS_SQL, "late_suffixes": LATE_SQL, "text_functions": TEXT_SQL, "folded_words": FOLD_SQL,
    "joined_words": JOINED_SQL, "language_names": NAMES_SQL, "soak": SOAK_SQL, "run_table": RUN_TABLE_SQL, "event_feed": FEED_SQL, "parsed_messages": MESSAGES_SQL, "turn_context": CONTEXT_SQL, "source_context": SOURCE_CONTEXT_SQL, "catalogue": CATALOGUE_SQL, "retimed_turns": RETIMED_SQL,
    "speech": SPEECH_SQL, "lane_states": LANE_STATES_SQL, "lane_quality": LANE_QUALITY_SQL, "routes": ROUTES_SQL, "pivots": PIVOTS_SQL, "committed_words": COMMITTED_SQL, "playlists": PLAYLISTS_SQL, "master_playlists": MASTER_SQL, "run_report": RUN_REPORT_SQL, "charsets": CHARSETS_SQL,
}
