"""Subtitle cues: roll-up tracks, segments, WebVTT and SRT bodies."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions.text import CJK, endonym, html_escape
from ..functions.times import TICKS, WRAP, srt_time, vtt_time
from .hot import run_islands, scanned
from .joins import overlap_join

#: Cues shorter than this many ticks (1 ms) aren't shown.
SHORTEST = 90


class CueTrack:
    """Roll-up cues of one caption lane. ``line`` gives the cue that ends, if any, as (start, end, text)."""

    def __init__(self, rows: int = 2, max_chars: int = 42, hold: int = 4 * TICKS):
        import re

        self.rows, self.max_chars, self.hold = rows, max_chars, hold
        self.lines: list[str] = []
        self.start: int | None = None
        self.until = 0
        self._cjk = re.compile("[" + CJK.replace(r"\x{", "\\u").replace("}", "") + "]")

    def _text(self) -> str:
        return "\n".join(self.lines)

    def close(self, at: int):
        """End what is shown at ``at`` or when its time is up."""
        if self.start is None:
            return None
        start, end, text = self.start, min(at, self.until), self._text()
        if at >= self.until:
            self.lines = []
        self.start = None
        return (start, end, text) if end > start else None

    def line(self, text: str, new_row: bool, due: int):
        text = " ".join(text.split())
        if not text:  # shows nothing; what is shown may be over by now
            return self.close(due) if self.start is not None and due >= self.until else None
        due = max(due, self.start) if self.start is not None else due
        ended = self.close(due)
        last = self.lines[-1] if self.lines else ""
        tight = bool(last and text and self._cjk.match(last[-1]) and self._cjk.match(text[0]))
        joined = last + ("" if tight or not last else " ") + text
        if self.lines and not new_row and len(joined) <= self.max_chars:
            self.lines[-1] = joined
        else:
            self.lines = [*self.lines, text][-self.rows :]
        self.start, self.until = due, due + self.hold
        return ended


def cue_track(lines: DataFrame, rows: int = 2, max_chars: int = 42, hold: int = 4 * TICKS) -> DataFrame:
    """Cues ``stream_id, lang, start, end, text`` of ``lines(stream_id, lang, seq, text, new_row, due)`` in ticks.

    A line that is due ``hold`` after all before it meets an empty track: there a lane is cut, and its parts are worked on
    at the same time."""
    kind = lines.schema["stream_id"].dataType
    schema = StructType([StructField("stream_id", kind), StructField("lang", StringType()), StructField("start", LongType()), StructField("end", LongType()), StructField("text", StringType())])

    class Track:
        def __init__(self):
            self.track, self.key = CueTrack(rows, max_chars, hold), None

        def _rows(self, cues: list) -> pd.DataFrame:
            return pd.DataFrame([(*self.key, *c) for c in cues if c], columns=schema.names)

        def take(self, pdf: pd.DataFrame) -> pd.DataFrame:
            self.key = (pdf["stream_id"].iloc[0], pdf["lang"].iloc[0])
            return self._rows([self.track.line(text or "", bool(new_row), int(due)) for text, new_row, due in zip(pdf["text"], pdf["new_row"], pdf["due"])])

        def end(self) -> pd.DataFrame:
            return self._rows([self.track.close(self.track.until)])

    keys = ["stream_id", "lang"]
    timed = scanned(lines.select(*keys, "seq", "text", "new_row", "due"), keys, ["seq"], {"before": ("max", F.col("due"))})
    return run_islands(timed, keys, ["seq"], F.col("due") >= F.col("before") + hold, Track, schema)


def simple_cues(lines: DataFrame, hold: int = 4 * TICKS) -> DataFrame:
    """S13 with one row and no appending: a cue ends at the next line or after ``hold``."""
    after = F.lead("due").over(Window.partitionBy("stream_id", "lang").orderBy("due", "seq"))
    end = F.least(F.coalesce(after, F.col("due") + hold), F.col("due") + hold)
    return lines.select("stream_id", "lang", F.col("due").alias("start"), end.alias("end"), "text").filter("end > start")


def cue_overlap(cues: DataFrame, segments: DataFrame, width: int = 2 * TICKS) -> DataFrame:
    """Cues clipped to the segments ``stream_id, seq, seg_start, seg_end`` that they overlap."""
    both = overlap_join(segments.select("stream_id", "seq", "seg_start", "seg_end"), cues.select("stream_id", "lang", "text", F.col("start").alias("cue_start"), F.col("end").alias("cue_end")), ["stream_id"], ("seg_start", "seg_end"), ("cue_start", "cue_end"), width)
    both = both.filter(F.col("overlap_end") - F.col("overlap_start") >= SHORTEST)
    return both.select("stream_id", "lang", "seq", "seg_start", F.col("overlap_start").alias("start"), F.col("overlap_end").alias("end"), "text")


def vtt_segments(cues: DataFrame, segments: DataFrame, langs: DataFrame, width: int = 2 * TICKS) -> DataFrame:
    """K1: ``stream_id, lang, seq, body``: a WebVTT body for each language (``langs(lang)``) and segment."""
    clipped = cue_overlap(cues, segments, width)
    rel = lambda c: vtt_time(F.col(c) - F.col("seg_start"))
    block = F.concat(rel("start"), F.lit(" --> "), rel("end"), F.lit("\n"), html_escape(F.col("text")), F.lit("\n"))
    bodies = clipped.groupBy("stream_id", "lang", "seq").agg(F.sort_array(F.collect_list(F.struct("start", block.alias("block")))).alias("blocks"))
    every = segments.crossJoin(F.broadcast(langs))  # a few languages
    head = F.concat(F.lit("WEBVTT\nX-TIMESTAMP-MAP=MPEGTS:"), F.pmod("seg_start", F.lit(WRAP)).cast("string"), F.lit(",LOCAL:00:00:00.000\n"))
    text = F.coalesce(F.transform("blocks", lambda b: b["block"]), F.array().cast("array<string>"))
    return every.join(bodies, ["stream_id", "lang", "seq"], "left").select("stream_id", "lang", "seq", F.concat_ws("\n", head, F.array_join(text, "\n")).alias("body"))


def subtitle_playlists(segments: DataFrame, langs: DataFrame) -> DataFrame:
    """K2: per stream and language the playlist of its subtitle segments ``seq, dur``."""
    line = F.concat(F.format_string("#EXTINF:%.5f,\n", F.col("dur")), F.lit("{lang}_"), F.col("seq").cast("string"), F.lit(".vtt"))
    each = segments.groupBy("stream_id").agg(F.min("seq").alias("first"), F.ceil(F.max("dur")).cast("string").alias("target"), F.sort_array(F.collect_list(F.struct("seq", line.alias("line")))).alias("lines"))
    head = F.concat(F.lit("#EXTM3U\n#EXT-X-VERSION:3\n#EXT-X-TARGETDURATION:"), F.col("target"), F.lit("\n#EXT-X-MEDIA-SEQUENCE:"), F.col("first").cast("string"), F.lit("\n"))
    body = F.concat(head, F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), F.lit("\n"))
    return each.crossJoin(F.broadcast(langs)).select("stream_id", "lang", F.replace(body, F.lit("{lang}"), F.col("lang")).alias("body"))


def master_playlist(streams: DataFrame, languages: DataFrame) -> DataFrame:
    """K2: per stream the master playlist; the source language comes first and is the default."""
    flag = F.when(F.col("source"), "YES").otherwise("NO")
    media = F.concat(F.lit('#EXT-X-MEDIA:TYPE=SUBTITLES,GROUP-ID="subs",NAME="'), endonym(F.col("code")), F.lit('",LANGUAGE="'), F.col("code"), F.lit('",DEFAULT='), flag, F.lit(',AUTOSELECT=YES,URI="'), F.col("code"), F.lit('.m3u8"'))
    lines = languages.agg(F.sort_array(F.collect_list(F.struct((~F.col("source")).alias("o"), "position", media.alias("m")))).alias("l"))
    body = F.concat(F.lit("#EXTM3U\n"), F.array_join(F.transform("l", lambda x: x["m"]), "\n"), F.lit('\n#EXT-X-STREAM-INF:BANDWIDTH=1,SUBTITLES="subs"\nvideo.m3u8\n'))
    return streams.select("stream_id").distinct().crossJoin(F.broadcast(lines)).select("stream_id", body.alias("body"))


def srt_body(cues: DataFrame) -> DataFrame:
    """K3: per stream the numbered SRT blocks of ``cues(stream_id, start, end, text)`` in seconds."""
    w = Window.partitionBy("stream_id").orderBy("start", "end", "text")
    n = F.row_number().over(w)
    end = F.greatest("end", F.col("start") + 0.001)
    block = F.concat(F.col("n").cast("string"), F.lit("\n"), srt_time(F.col("start")), F.lit(" --> "), srt_time(end), F.lit("\n"), F.col("text"), F.lit("\n"))
    rows = cues.withColumn("n", n)
    return rows.groupBy("stream_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", block.alias("b")))), lambda x: x["b"]), "\n").alias("body"))


def emission_cues(words: DataFrame, n: int = 16, last_s: float = 4.0) -> DataFrame:
    """A cue for each emission of ``words(stream_id, seq, text, emit_s)``: the last n words, until the next
    emission, the last one for ``last_s``."""
    w = Window.partitionBy("stream_id").orderBy("seq")
    rows = words.withColumn("tail", F.collect_list("text").over(w.rowsBetween(1 - n, 0)))
    shown = rows.groupBy("stream_id", "emit_s").agg(F.max_by(F.concat_ws(" ", "tail"), "seq").alias("text"))
    after = F.lead("emit_s").over(Window.partitionBy("stream_id").orderBy("emit_s"))
    return shown.select("stream_id", F.col("emit_s").alias("start"), F.coalesce(after, F.col("emit_s") + last_s).alias("end"), "text")
