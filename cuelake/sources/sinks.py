"""Writers of subtitle bodies, reports, word logs and event feeds (K1-K7)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import named
from .staging import staged


def write_bodies(bodies: DataFrame, path: str, by: list[str], mode: str = "overwrite") -> None:
    """K1-K3: text bodies (``body``) in a folder for each key; each body is a file of its own."""
    bodies.select(*by, "body").repartition(*by).write.mode(mode).option("lineSep", "\n").option("maxRecordsPerFile", 1).partitionBy(*by).text(path)


def write_pairs(pairs: DataFrame, path: str) -> None:
    """K4."""
    out = pairs.select("stream_id", "in_seq", "out_seq", "in_pts", "out_pts", "in_wall_ns", F.format_string("%.3f", "delay_ms").alias("delay_ms"))
    out.write.mode("overwrite").option("header", True).partitionBy("stream_id").csv(path)


def write_lag(lags: DataFrame, path: str) -> None:
    """K5: a missing appearance is empty."""
    out = lags.select("stream_id", "loop", "utt", "utt_start_s", "utt_end_s", "ref_end_s", "appear_s", "lag_s", "words_matched", F.concat_ws(" ", "target").alias("target"))
    out.write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").partitionBy("stream_id").csv(path)


def word_files(words: DataFrame, seconds: int = 3600) -> DataFrame:
    """K6: ``stream_id, file, body``: word, t0_s, t1_s, emit_s by tabs, a file for each stream and ``seconds`` of its time, so that no
    body grows with its stream. Files are named ``<part>/<stream>.tsv``; a null or empty stream is %."""
    columns = ("t0_s", "t1_s", "emit_s", "word")
    part = F.coalesce(F.floor(F.col("t0_s") / seconds), F.lit(-1)).cast("string")
    rows = words.select("stream_id", part.alias("part"), F.struct("t0_s", "t1_s", "emit_s", F.col("text").alias("word")).alias("w"))
    line = lambda w: F.concat_ws("\t", *[F.coalesce(w[c].cast("string"), F.lit("")) for c in (columns[3], *columns[:3])])
    body = F.array_join(F.concat(F.array(F.lit("\t".join((columns[3], *columns[:3])))), F.transform(F.sort_array(F.collect_list("w")), line)), "\n")
    # a name that begins with _ or . would be hidden from readers of the folder
    name = F.coalesce(F.nullif(named.folder(F.col("stream_id")), F.lit("")), F.lit("%"))
    name = F.regexp_replace(F.regexp_replace(name, "^_", "%5F"), r"^\.", "%2E")
    files = rows.groupBy("stream_id", "part").agg(body.alias("body"))
    return files.select("stream_id", F.concat("part", F.lit("/"), name, F.lit(".tsv")).alias("file"), "body")


def write_words(words: DataFrame, path: str) -> DataFrame:
    """K6: the files of :func:`word_files` in a new folder below ``path``, all or none; returns ``stream_id, file``, by which
    :func:`readers.read_word_files` finds them without listing folders. ``path`` is a URI that Python can open on every executor."""
    folder = uuid.uuid4().hex
    files = staged(word_files(words), "word-files")
    named.write_named(files.select("file", "body"), f"{path}/{folder}")
    return files.select("stream_id", F.concat(F.lit(f"{folder}/"), "file").alias("file"))


def event_feed(rows: DataFrame, kind: str) -> DataFrame:
    """K7: ``value``: tagged JSON of each row; the same for batches and streams."""
    return rows.select(F.to_json(F.struct(F.lit(kind).alias("type"), *rows.columns)).alias("value"))


def publish_events(lines: DataFrame, stats: DataFrame, path: str) -> None:
    """K7: caption lines and snapshots as JSON lines."""
    event_feed(lines, "line").unionByName(event_feed(stats, "stats")).write.mode("append").text(path)
