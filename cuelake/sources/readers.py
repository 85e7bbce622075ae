"""Readers of word logs, messages, taps, subtitles, playlists, runs, lists (R1-R10). Schemas are always given."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import strip_tags
from ..functions.times import parse_time
from .named import read_named

MESSAGES = (
    "type string, words array<struct<text:string,start_ms:long,end_ms:long>>, clause struct<id:long,text:string,start_ms:long,end_ms:long>, langs array<string>, "
    "translation struct<clause_id:long,lang:string,text:string,elapsed_ms:int>, worker string, version string, seq long, message string"
)
RUNS = "label string, pass int, id string, kind string, lang string, ctx int, src string, out string, ms double, req_ms double, ttft_ms double, n_out int, cap string"
EMIT_LOG = "wall_ns long, lane int, clause long, pts_ns long, wait_ms double, text string"


def _stem():
    return F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:\.[^./]*)?$", 1)


def _fields(spark: SparkSession, path: str, n: int) -> DataFrame:
    """Lines of tab-separated files cut into at most n fields, the last with what is left."""
    return spark.read.option("recursiveFileLookup", True).text(path).select(_stem().alias("stream_id"), F.split("value", "\t", n).alias("f"))


def read_words(spark: SparkSession, path: str, layout: str) -> DataFrame:
    """``stream_id, text, start_ms, end_ms, emit_s`` of one of three layouts: ``emit`` (emit_s, start_ms, end_ms,
    text), ``reference`` (word, start_s, end_s), ``engine`` (word, t0_s, t1_s, emit_s). The stream is the file's name;
    lines whose numbers can't be read (headers) are left out. Seconds are cut to ms."""
    return _word_rows(_fields(spark, path, 4), layout)


def read_word_files(files: DataFrame, path: str, layout: str) -> DataFrame:
    """:func:`read_words` of the files ``file`` of ``files(stream_id, file)`` below ``path``, opened by their names."""
    lines = read_named(files.select("stream_id", "file"), path).select("stream_id", F.explode(F.split("value", "\r\n|\r|\n")).alias("value"))
    return _word_rows(lines.select("stream_id", F.split("value", "\t", 4).alias("f")), layout)


def _word_rows(rows: DataFrame, layout: str) -> DataFrame:
    ms = lambda c: (F.try_multiply(c.try_cast("double"), F.lit(1000.0))).cast("long")
    f = lambda i: F.get("f", F.lit(i))
    if layout == "emit":
        out = rows.select("stream_id", f(3).alias("text"), f(1).try_cast("long").alias("start_ms"), f(2).try_cast("long").alias("end_ms"), f(0).try_cast("double").alias("emit_s"))
    else:
        emit = f(3).try_cast("double") if layout == "engine" else F.lit(None).cast("double")
        out = rows.select("stream_id", f(0).alias("text"), ms(f(1)).alias("start_ms"), ms(f(2)).alias("end_ms"), emit.alias("emit_s"))
    return out.filter("start_ms is not null and end_ms is not null and text is not null")


def parse_messages(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """R2: messages of JSON lines (``value``), and the lines that aren't one. Works on streams, too."""
    rows = lines.withColumn("m", F.from_json("value", MESSAGES))
    good = F.col("m.type").isNotNull()
    return rows.filter(good).select(*[c for c in lines.columns if c != "value"], "m.*"), rows.filter(~F.coalesce(good, F.lit(False))).drop("m")


def read_messages(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_messages(spark.read.text(path).select(_stem().alias("stream_id"), "value"))


def message_words(messages: DataFrame) -> DataFrame:
    """R2: a row for each word of words messages."""
    return messages.filter("type = 'words'").select("stream_id", "seq", F.posexplode("words").alias("pos", "w")).select("stream_id", "seq", "pos", "w.*")


def read_tap(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Frames of a tap CSV (wall ns, pts, seq, hash), and per stream the number of bad lines: fewer than three fields,
    or no number for time or sequence. A header isn't bad. An empty PTS is null, a bad hash 0."""
    rows = spark.read.text(path).select(_stem().alias("stream_id"), "value").filter("value not like 'wallclock%' and trim(value) <> ''")
    f = F.split("value", ",")
    g = lambda i: F.trim(F.get(f, F.lit(i)))
    hash_ = F.when(g(3).rlike("^[0-9a-fA-F]{1,16}$"), F.lower(F.lpad(g(3), 16, "0"))).otherwise("0" * 16)
    rows = rows.select("stream_id", g(0).try_cast("long").alias("wall_ns"), g(1).try_cast("long").alias("pts_90k"), g(2).try_cast("long").alias("seq"), hash_.alias("tail_hash"), F.size(f).alias("n"))
    ok = (F.col("n") >= 3) & F.col("wall_ns").isNotNull() & F.col("seq").isNotNull()
    return rows.filter(ok).drop("n"), rows.groupBy("stream_id").agg(F.count_if(~ok).alias("bad"))


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """``stream_id, start, end, text`` in seconds; the text may hold tabs."""
    f = lambda i: F.get("f", F.lit(i))
    rows = _fields(spark, path, 3).select("stream_id", f(0).try_cast("double").alias("start"), f(1).try_cast("double").alias("end"), f(2).alias("text"))
    return rows.filter("start is not null and end is not null")


def parse_srt(files: DataFrame) -> DataFrame:
    """Cues ``stream_id, position, start, end, text`` of whole SRT texts (``stream_id, value``), sorted by start."""
    blocks = files.select("stream_id", F.posexplode(F.split(F.regexp_replace("value", "\r\n", "\n"), "\n{2,}")).alias("position", "b"))
    lines = blocks.withColumn("l", F.split("b", "\n")).withColumn("at", F.array_position(F.transform("l", lambda x: F.contains(x, F.lit("-->"))), True))
    times = F.split(F.element_at("l", F.col("at").cast("int")), "-->")
    rows = lines.filter("at > 0").select("stream_id", "position", parse_time(F.get(times, F.lit(0))).alias("start"), parse_time(F.regexp_extract(F.get(times, F.lit(1)), r"^\s*(\S+)", 1)).alias("end"), F.slice("l", F.col("at").cast("int") + 1, F.size("l")).alias("body"))
    said = F.filter(F.transform("body", lambda x: F.trim(strip_tags(x))), lambda x: x != "")
    return rows.filter("start is not null and end is not null").select("stream_id", "position", "start", "end", F.array_join(said, " ").alias("text")).orderBy("stream_id", "start", "position")


def read_srt(spark: SparkSession, path: str) -> DataFrame:
    return parse_srt(spark.read.text(path, wholetext=True).select(_stem().alias("stream_id"), "value"))


def parse_playlist(files: DataFrame) -> DataFrame:
    """Segments ``stream_id, target, seq, dur, uri`` of media playlists. Every URI line counts up; one without a
    duration of its own isn't given."""
    lines = files.select("stream_id", F.posexplode(F.split(F.regexp_replace("value", "\r\n", "\n"), "\n")).alias("pos", "line")).filter("trim(line) <> ''")
    tag = lambda name: F.regexp_extract("line", rf"^#{name}:([0-9.]+)", 1).try_cast("double")
    uri = ~F.col("line").startswith("#")
    order = Window.partitionBy("stream_id").orderBy("pos")
    rows = lines.withColumns({"uri_no": F.sum(uri.cast("int")).over(order), "first": F.last(tag("EXT-X-MEDIA-SEQUENCE"), ignorenulls=True).over(order), "target": F.last(tag("EXT-X-TARGETDURATION"), ignorenulls=True).over(order), "inf": tag("EXTINF"), "is_uri": uri})
    # lines up to a URI line belong to it
    part = Window.partitionBy("stream_id", F.when(F.col("is_uri"), F.col("uri_no") - 1).otherwise(F.col("uri_no"))).orderBy("pos")
    rows = rows.withColumn("dur", F.last("inf", ignorenulls=True).over(part)).filter("is_uri and dur is not null")
    return rows.select("stream_id", "target", (F.coalesce("first", F.lit(0)) + F.col("uri_no") - 1).cast("long").alias("seq"), "dur", F.col("line").alias("uri"))


def read_playlist(spark: SparkSession, path: str) -> DataFrame:
    return parse_playlist(spark.read.text(path, wholetext=True).select(_stem().alias("stream_id"), "value"))


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """First passes of translation runs; the run is the file's name. Summaries and soaks are left out."""
    rows = spark.read.schema(RUNS).json(path).select(_stem().alias("run"), "*", F.monotonically_increasing_id().alias("line"))
    return rows.filter("pass = 0").filter(~F.col("run").rlike(r"(^summaries$|\.soak(\+asr)?$)"))


def read_corpus(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Clauses ``id, doc, kind, text``; lines of another number of fields fail. With ``limit`` the first by id."""
    rows = spark.read.schema("id string, doc string, kind string, text string").option("sep", "\t").option("header", True).option("mode", "FAILFAST").option("quote", "").csv(path)
    return rows if limit is None else rows.orderBy("id").limit(limit)


def read_wordlists(spark: SparkSession, path: str, kind: str = "block") -> DataFrame:
    """Entries ``lang, entry, list`` of one file for each language, whose name ends in the language's code."""
    lang = F.regexp_extract(F.col("_metadata.file_path"), r"([a-z]{2,3})\.[^./]+$", 1)
    return spark.read.text(path).select(lang.alias("lang"), F.trim("value").alias("entry"), F.lit(kind).alias("list")).filter("entry <> '' and entry not like '#%'")


def read_emit_log(spark: SparkSession, path: str) -> DataFrame:
    """R10."""
    return spark.read.schema(EMIT_LOG).option("sep", "\t").option("header", True).option("quote", "").csv(path)
