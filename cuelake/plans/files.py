"""Queries that write a table to files in the shared folder and read them with the library's readers (R1-R11, K4-K6), and
the text, list and audio operators that go with them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import audio, frames, guard, lag, stats
from ..sources import named, readers, sinks
from .tables import TAPS_SQL, WORDS_SQL, shared_path, table, taps, word_tasks, words


def _lines(df, path: str, *columns: str, sep: str = "\t") -> str:
    """Rows as text lines under ``path``."""
    df.select(F.concat_ws(sep, *columns).alias("value")).write.text(path)
    return path


def tap_files(spark, sf_dir):
    """The input tap as CSV; every 31st line lacks its sequence, every 43rd has a broken hash, every 53rd no PTS."""
    i, _ = taps(spark, sf_dir)
    k = F.col("seq")
    rows = i.select("wall_ns", F.when(k % 53 == 0, "").otherwise((k * 10).cast("string")).alias("pts"), F.when(k % 31 == 0, "x").otherwise(k.cast("string")).alias("s"), F.when(k % 43 == 0, "zz").otherwise(F.concat(F.lit(" "), F.upper("tail_hash"))).alias("h"))
    good, bad = readers.read_tap(spark, _lines(rows, shared_path(spark, "tap"), "wall_ns", "pts", "s", "h", sep=","))
    lost = bad.agg(F.lit(None).cast("long").alias("wall_ns"), F.lit(None).cast("long").alias("pts_90k"), F.sum("bad").alias("seq"), F.lit("bad").alias("tail_hash"))
    return good.select("wall_ns", "pts_90k", "seq", "tail_hash").unionByName(lost)


TAP_FILES_SQL = f"""
WITH {TAPS_SQL}
SELECT wall_ns, CASE WHEN seq % 53 > 0 THEN seq * 10 END AS pts_90k, seq, CASE WHEN seq % 43 = 0 THEN '0000000000000000' ELSE lpad(lower(to_hex(seq + 1)), 16, '0') END AS tail_hash FROM tap_in WHERE seq % 31 > 0
UNION ALL SELECT NULL, NULL, count(*), 'bad' FROM tap_in WHERE seq % 31 = 0"""


def emit_words(spark, sf_dir):
    """R1, a log of emissions with a header."""
    rows = words(spark, sf_dir).select((F.col("arrival_ms") / 1000.0).alias("emit_s"), "start_ms", "end_ms", "text")
    head = spark.range(1).select(F.lit("emit_s").alias("emit_s"), F.lit("start_ms").alias("start_ms"), F.lit("end_ms").alias("end_ms"), F.lit("text").alias("text"))
    path = _lines(rows.select(*[F.col(c).cast("string") for c in rows.columns]).unionByName(head), shared_path(spark, "emit"), *rows.columns)
    return readers.read_words(spark, path, "emit").select("text", "start_ms", "end_ms", "emit_s")


EMIT_WORDS_SQL = f"WITH {WORDS_SQL} SELECT text, start_ms, end_ms, arrival_ms / 1000.0 AS emit_s FROM words"


def engine_words(spark, sf_dir):
    """An engine's words by stream, written and read; seconds are cut to ms."""
    path, tasks = shared_path(spark, "engine"), word_tasks(spark, sf_dir)
    w = words(spark, sf_dir, tasks)
    files = sinks.write_words(w.select("stream_id", "text", (F.col("start_ms") / 1000.0).alias("t0_s"), (F.col("end_ms") / 1000.0).alias("t1_s"), (F.col("arrival_ms") / 1000.0).alias("emit_s")), path)
    # names are few bytes, but each is a file to open: a given number of tasks isn't made smaller
    return readers.read_word_files(files.repartition(tasks, "file"), path, "engine").select("text", "start_ms", "end_ms", "emit_s")


ENGINE_WORDS_SQL = f"""
WITH {WORDS_SQL}
SELECT text, CAST(trunc(CAST(start_ms / 1000.0 AS DOUBLE) * 1000.0) AS BIGINT) AS start_ms, CAST(trunc(CAST(end_ms / 1000.0 AS DOUBLE) * 1000.0) AS BIGINT) AS end_ms, arrival_ms / 1000.0 AS emit_s FROM words"""


def segment_files(spark, sf_dir):
    """Texts with tabs in them; lines without a number are left out."""
    c = table(spark, sf_dir, "conversations").select(F.when(F.col("turn") % 4 == 3, "-").otherwise((F.col("turn") * 2.5).cast("string")).alias("a"), (F.col("turn") * 2.5 + 2).cast("string").alias("z"), F.concat(F.md5("text"), F.lit("\t"), F.col("conv_id").cast("string")).alias("t"))
    return readers.read_segments(spark, _lines(c, shared_path(spark, "segments"), "a", "z", "t")).select("start", "end", "text")


SEGMENT_FILES_SQL = "SELECT CAST(turn * 2.5 AS DOUBLE) AS start, CAST(turn * 2.5 + 2 AS DOUBLE) AS end, md5(text) || chr(9) || conv_id AS text FROM conversations WHERE turn % 4 <> 3"


def run_files(spark, sf_dir):
    """First passes of runs, one file of them; second passes are left out."""
    e = table(spark, sf_dir, "events")
    path = shared_path(spark, "runs")
    e.select(F.col("event_type").alias("label"), (F.col("event_id") % 2).cast("int").alias("pass"), F.col("event_id").cast("string").alias("id"), F.col("value").alias("ms"), F.when(F.col("event_id") % 3 == 0, (F.col("event_id") % 9).cast("int")).alias("n_out")).write.json(path)
    return readers.read_runs(spark, path).select("label", "id", "ms", "n_out", "cap")


RUN_FILES_SQL = "SELECT event_type AS label, CAST(event_id AS VARCHAR) AS id, value AS ms, CAST(CASE WHEN event_id % 3 = 0 THEN event_id % 9 END AS INTEGER) AS n_out, CAST(NULL AS VARCHAR) AS cap FROM events WHERE event_id % 2 = 0"


def corpus_files(spark, sf_dir):
    """R8."""
    path = shared_path(spark, "corpus")
    c = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("conv_id").cast("string").alias("doc"), F.when(F.col("turn") % 2 == 0, "ask").otherwise("answer").alias("kind"), F.regexp_replace(F.trim(F.regexp_replace("text", r"\s+", " ")), '"', "'").alias("text"))
    c.write.option("sep", "\t").option("header", True).option("quote", "").csv(path)
    return readers.read_corpus(spark, path).select("id", "doc", "kind", F.md5("text").alias("text_md5"))


CORPUS_FILES_SQL = r"SELECT conv_id || '-' || turn AS id, CAST(conv_id AS VARCHAR) AS doc, CASE WHEN turn % 2 = 0 THEN 'ask' ELSE 'answer' END AS kind, md5(replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '\"', '''')) AS text_md5 FROM conversations".replace('\\"', '"')


def word_list_files(spark, sf_dir):
    """customers' names as block lists, suppliers' as allow lists, a file for each nation; entries and why some can't be used."""
    lists = []
    for name, key, kind in (("customer", "c", "block"), ("supplier", "s", "allow")):
        t = table(spark, sf_dir, name)
        nation = F.col(f"{key}_nationkey")
        lang = F.concat(F.chr(97 + nation % 5), F.chr(97 + F.floor(nation / 5)))
        entry = F.when(F.col(f"{key}_{'cust' if key == 'c' else 'supp'}key") % 7 == 0, F.concat(F.col(f"{key}_name"), F.lit("!"))).when(F.col(f"{key}_{'cust' if key == 'c' else 'supp'}key") % 11 == 0, "# note").otherwise(F.replace(f"{key}_name", F.lit("#"), F.lit(" ")))
        path = shared_path(spark, kind)
        bodies = t.select(F.concat(F.lit(f"{kind}."), lang, F.lit(".txt")).alias("file"), entry.alias("e")).groupBy("file").agg(F.array_join(F.collect_list("e"), "\n").alias("body"))
        named.write_named(bodies, path)
        lists.append(readers.read_wordlists(spark, path, kind))
    return stats.union_lists(*lists).withColumn("problem", T.entry_problem(F.col("entry")))


def _lists_sql(table_: str, key: str, prefix: str, kind: str) -> str:
    return f"""SELECT chr(97 + {prefix}_nationkey % 5) || chr(97 + {prefix}_nationkey // 5) AS lang, CASE WHEN {key} % 7 = 0 THEN {prefix}_name || '!' ELSE replace({prefix}_name, '#', ' ') END AS entry, '{kind}' AS list,
       CASE WHEN {key} % 7 = 0 THEN 'use letters, digits, spaces, '', - and * only' END AS problem FROM {table_} WHERE {key} % 7 = 0 OR {key} % 11 > 0"""


WORD_LIST_FILES_SQL = f"SELECT DISTINCT * FROM ({_lists_sql('customer', 'c_custkey', 'c', 'block')} UNION ALL {_lists_sql('supplier', 's_suppkey', 's', 'allow')})"


def emit_log(spark, sf_dir):
    """R10."""
    e = table(spark, sf_dir, "events").select((F.col("event_id") * 1000).alias("wall_ns"), (F.col("event_id") % 4).cast("int").alias("lane"), F.floor(F.col("event_id") / 4).alias("clause"), (F.col("event_id") * 7).alias("pts_ns"), F.col("value").alias("wait_ms"), F.col("event_type").alias("text"))
    path = shared_path(spark, "emit-log")
    e.write.option("sep", "\t").option("header", True).csv(path)
    return readers.read_emit_log(spark, path)


EMIT_LOG_SQL = "SELECT event_id * 1000 AS wall_ns, CAST(event_id % 4 AS INTEGER) AS lane, event_id // 4 AS clause, event_id * 7 AS pts_ns, value AS wait_ms, event_type AS text FROM events"


def pair_files(spark, sf_dir):
    """K4: frame pairs as CSV by stream, read back."""
    path = shared_path(spark, "pairs")
    sinks.write_pairs(frames.match_frames_hash(*taps(spark, sf_dir)), path)
    kinds = "in_seq long, out_seq long, in_pts long, out_pts long, in_wall_ns long, delay_ms double, stream_id string"
    return spark.read.schema(kinds).option("header", True).csv(path).select("stream_id", "in_seq", "out_seq", "in_pts", "out_pts", "delay_ms")


PAIR_FILES_SQL = f"""
WITH {TAPS_SQL}
SELECT o.stream_id, i.seq AS in_seq, o.seq AS out_seq, i.pts AS in_pts, o.pts AS out_pts, round((o.wall_ns - i.wall_ns) / 1e6, 3) AS delay_ms FROM tap_out o JOIN tap_in i USING (stream_id, seq)"""


def lag_files(spark, sf_dir):
    """K5: lags of turns as CSV, a missing appearance empty, read back."""
    c = table(spark, sf_dir, "conversations")
    k = F.col("turn")
    seen = F.when(k % 3 > 0, k * 2.0 + 1.5)
    rows = c.select(F.col("conv_id").alias("stream_id"), F.lit(0).alias("loop"), k.alias("utt"), (k * 2.0).alias("utt_start_s"), (k * 2.0 + 1).alias("utt_end_s"), (k * 2.0 + 1).alias("ref_end_s"), seen.alias("appear_s"), (seen - (k * 2.0 + 1)).alias("lag_s"), F.when(k % 3 > 0, 2).alias("words_matched"), F.array(F.lit("two"), F.lit("words")).alias("target"))
    path = shared_path(spark, "lags")
    sinks.write_lag(rows, path)
    kinds = "loop int, utt long, utt_start_s double, utt_end_s double, ref_end_s double, appear_s double, lag_s double, words_matched int, target string, stream_id long"
    return spark.read.schema(kinds).option("header", True).csv(path).select("stream_id", "utt", "appear_s", "lag_s", "words_matched", "target")


LAG_FILES_SQL = "SELECT conv_id AS stream_id, turn AS utt, CAST(CASE WHEN turn % 3 > 0 THEN turn * 2.0 + 1.5 END AS DOUBLE) AS appear_s, CAST(CASE WHEN turn % 3 > 0 THEN 0.5 END AS DOUBLE) AS lag_s, CAST(CASE WHEN turn % 3 > 0 THEN 2 END AS INTEGER) AS words_matched, 'two words' AS target FROM conversations"


def pcm_flags(spark, sf_dir):
    """Four samples for each event as bytes, every eleventh body cut short; the detector takes loud ones."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    word = lambda v: F.concat(F.lpad(F.hex(v % 256), 2, "0"), F.lpad(F.hex(F.floor(v / 256)), 2, "0"))
    body = F.concat(*[word(k * j * 37 % 2000) for j in (1, 2, 3, 4)])
    good, bad = audio.decode_pcm(e.select("event_id", F.unhex(F.when(k % 11 == 0, F.substring(body, 1, 14)).otherwise(body)).alias("body")))
    flagged = audio.with_speech_flag(good, lambda lists: [int(x.astype("int64").sum()) > 4000 for x in lists])
    total = F.aggregate("samples", F.lit(0).cast("long"), lambda s, x: s + x)
    return flagged.select("event_id", total.alias("total"), "speech").unionByName(bad.select("event_id", F.lit(None).cast("long").alias("total"), F.lit(None).cast("boolean").alias("speech")))


PCM_FLAGS_SQL = """
SELECT event_id, CASE WHEN event_id % 11 > 0 THEN t END AS total, CASE WHEN event_id % 11 > 0 THEN t > 4000 END AS speech
FROM (SELECT event_id, CAST(event_id * 37 % 2000 + event_id * 74 % 2000 + event_id * 111 % 2000 + event_id * 148 % 2000 AS BIGINT) AS t FROM events)"""


def cleaned_bytes(spark, sf_dir):
    """Turns as bytes with one in front and one behind that aren't UTF-8."""
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.md5(T.clean_bytes(F.concat(F.unhex(F.lit("FF")), F.col("text").cast("binary"), F.unhex(F.lit("C3"))))).alias("text_md5"))


CLEANED_BYTES_SQL = r"SELECT conv_id, turn, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS text_md5 FROM conversations"


def filler_lines(spark, sf_dir):
    """turns, some of them replaced by lines that recognisers make of silence, credits or interjections."""
    c, k = table(spark, sf_dir, "conversations"), F.col("turn")
    said = F.when(k % 5 == 1, "Thanks for watching! Bye.").when(k % 5 == 2, "Subtitles by nobody").when(k % 5 == 3, "Oh, ah.").when(k % 5 == 4, F.concat(F.lit("Thank you. "), F.col("text"))).otherwise(F.col("text"))
    return c.select("conv_id", "turn", guard.is_filler(F.split(T.clean(said), " ")).alias("filler"))


FILLER_LINES_SQL = "SELECT conv_id, turn, turn % 5 IN (1, 2, 3) AS filler FROM conversations"


def loop_spans(spark, sf_dir):
    """Utterances of a looped recording of 20 s in the span that was captioned, with the rank of shedding of their language."""
    c = table(spark, sf_dir, "conversations")
    utts = c.select(F.col("conv_id").alias("stream_id"), F.col("turn").alias("utt"), (F.col("turn") * 2.0).alias("start"), (F.col("turn") * 2.0 + 1.5).alias("end"))
    span = c.groupBy(F.col("conv_id").alias("stream_id")).agg((F.first("conv_id") % 7).cast("double").alias("low"), (F.first("conv_id") % 7 + 45).cast("double").alias("high"))
    rows = lag.in_span(lag.loop_occurrences(utts, span, 20.0).drop("low", "high"), span, 4.0)
    nations = table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("long").alias("region"), F.col("n_nationkey").alias("position"), (F.col("n_nationkey") % 3).alias("priority"), (F.col("n_nationkey") % 7 == 0).alias("source"))
    ranks = stats.shed_order(nations, ["region"]).groupBy("region").agg(F.max_by("position", F.struct(-F.col("shed_rank"))).cast("long").alias("first_shed"))
    return rows.withColumn("region", F.col("stream_id") % 5).join(ranks, "region", "left").select("stream_id", "utt", "loop", "start", "first_shed")


LOOP_SPANS_SQL = """
WITH u AS (SELECT conv_id, turn, turn * 2.0 AS a, turn * 2.0 + 1.5 AS z, CAST(conv_id % 7 AS DOUBLE) AS low, CAST(conv_id % 7 + 45 AS DOUBLE) AS high FROM conversations),
k AS (SELECT *, unnest(range(CAST(floor(low / 20) AS BIGINT), CAST(floor(high / 20) AS BIGINT) + 1)) AS loop FROM u),
s AS (SELECT n_regionkey AS region, CAST(arg_min(n_nationkey, r) AS BIGINT) AS first_shed FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey % 3 DESC, n_nationkey DESC) AS r FROM nation WHERE n_nationkey % 7 > 0) GROUP BY 1)
SELECT conv_id AS stream_id, turn AS utt, loop, CAST(a + loop * 20.0 AS DOUBLE) AS start, first_shed FROM k LEFT JOIN s ON s.region = conv_id % 5
WHERE a + loop * 20 >= low AND z + loop * 20 + 4 <= high"""

QUERIES = {
    "tap_files": tap_files, "emit_words": emit_words, "engine_words": engine_words, "segment_files": segment_files, "run_files": run_files, "corpus_files": corpus_files, "word_list_files": word_list_files,
    "emit_log": emit_log, "pair_files": pair_files, "lag_files": lag_files, "pcm_flags": pcm_flags, "cleaned_bytes": cleaned_bytes, "filler_lines": filler_lines, "loop_spans": loop_spans,
}
SQL = {
    "tap_files": TAP_FILES_SQL, "emit_words": EMIT_WORDS_SQL, "engine_words": ENGINE_WORDS_SQL, "segment_files": SEGMENT_FILES_SQL, "run_files": RUN_FILES_SQL, "corpus_files": CORPUS_FILES_SQL, "word_list_files": WORD_LIST_FILES_SQL,
    "emit_log": EMIT_LOG_SQL, "pair_files": PAIR_FILES_SQL, "lag_files": LAG_FILES_SQL, "pcm_flags": PCM_FLAGS_SQL, "cleaned_bytes": CLEANED_BYTES_SQL, "filler_lines": FILLER_LINES_SQL, "loop_spans": LOOP_SPANS_SQL,
}
