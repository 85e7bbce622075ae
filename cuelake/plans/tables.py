"""The engine's tables from the star-schema test tables, by fixed rules (the same as in the SQL of the queries)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.staging import shared_path, staged  # noqa: F401  for the queries


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """Rows over as many tasks as shuffles have, for work that costs more than the shuffle: a file may be one row group, and
    so one task. Equal rows alone stay together."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(*df.columns))


#: Bytes of text whose words a task puts in order at a time, about 400,000 words.
TASK_BYTES = 2_000_000


def word_tasks(spark: SparkSession, sf_dir: str) -> int:
    """Tasks for the words of all conversations: more text makes more tasks, not larger ones."""
    size = table(spark, sf_dir, "conversations").agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))


def words(spark: SparkSession, sf_dir: str, tasks: int | None = None) -> DataFrame:
    """``stream_id, seq, text, start_ms, end_ms, arrival_ms``: a stream for each conversation, dealt over ``tasks``."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("stream_id"), "turn", "text").repartition(tasks or word_tasks(spark, sf_dir), "stream_id")
    each = turns.select("stream_id", "turn", F.posexplode(F.filter(F.split("text", r"\s+"), lambda w: w != "")).alias("pos", "text"))
    seq = (F.row_number().over(Window.partitionBy("stream_id").orderBy("turn", "pos")) - 1).cast("long")
    rows = each.select("stream_id", seq.alias("seq"), "text")
    start = F.col("seq") * 300 + 400 * F.floor(F.col("seq") / 41) + 1200 * F.floor(F.col("seq") / 97)
    rows = rows.withColumn("start_ms", start.cast("long")).withColumn("end_ms", F.col("start_ms") + 200)
    return rows.withColumn("arrival_ms", ((F.floor(F.col("end_ms") / 560) + 1) * 560 + 60).cast("long"))


WORDS_SQL = r"""
each AS (SELECT conv_id AS stream_id, turn, generate_subscripts(w, 1) AS pos, unnest(w) AS text
         FROM (SELECT conv_id, turn, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM conversations)),
words AS (SELECT *, start_ms + 200 AS end_ms, ((start_ms + 200) // 560 + 1) * 560 + 60 AS arrival_ms
          FROM (SELECT *, seq * 300 + 400 * (seq // 41) + 1200 * (seq // 97) AS start_ms
                FROM (SELECT stream_id, row_number() OVER (PARTITION BY stream_id ORDER BY turn, pos) - 1 AS seq, text FROM each)))"""


def taps(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Frames of the input and output tap of a stream for each event type: ``stream_id, wall_ns, pts_90k, seq, tail_hash``."""
    e = table(spark, sf_dir, "events")
    ns = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    hash_ = F.lower(F.lpad(F.hex(F.col("event_id") + 1), 16, "0"))
    pts = F.pmod(F.col("event_id") * 3000, F.lit(1 << 33))
    one = e.select(F.col("event_type").alias("stream_id"), ns.alias("wall_ns"), pts.alias("pts_90k"), F.col("event_id").alias("seq"), hash_.alias("tail_hash"))
    late = (30 + F.col("event_id") % 7) * 1_000_000
    two = e.filter("event_id % 37 <> 0").select(F.col("event_type").alias("stream_id"), (ns + late).alias("wall_ns"), F.pmod(pts + 90000, F.lit(1 << 33)).alias("pts_90k"), F.col("event_id").alias("seq"), hash_.alias("tail_hash"))
    return one, two


TAPS_SQL = """
tap_in AS (SELECT event_type AS stream_id, epoch_us(ts) * 1000 AS wall_ns, (event_id * 3000) % 8589934592 AS pts, event_id AS seq FROM events),
tap_out AS (SELECT stream_id, wall_ns + (30 + seq % 7) * 1000000 AS wall_ns, (pts + 90000) % 8589934592 AS pts, seq FROM tap_in WHERE seq % 37 <> 0)"""


def word_lists(spark: SparkSession) -> DataFrame:
    """A dozen entries over the words that the test texts are made of."""
    rows = [(x, e, k) for x, k, entries in (("en", "block", ("the", "ha*", "of the", "hand")), ("en", "allow", ("hand",)), ("fr", "block", ("le", "eau*", "de la")), ("fr", "allow", ("eaux",)), ("de", "block", ("die", "zu*", "in der")), ("es", "block", ("el", "de*"))) for e in entries]
    return spark.createDataFrame(rows, "lang string, entry string, list string")


LANGUAGES = (("en", True, 0, 0), ("es", False, 1, 1), ("fr", False, 2, 2), ("de", False, 2, 3))


def languages(spark: SparkSession) -> DataFrame:
    """``code, source, priority, position``: larger priority numbers are paused first."""
    return spark.createDataFrame(list(LANGUAGES), "code string, source boolean, priority int, position int")
