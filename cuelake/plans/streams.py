"""Queries that read the tables as streams. A stream's output is a table in the shared folder, read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming.machines import stream_counters
from .tables import shared_path, table


def run_available(stream, path: str):
    """Work on what is there, then end; gives the written table."""
    query = stream.writeStream.format("parquet").outputMode("append").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")


def event_counters(spark, sf_dir):
    """Events by type and hour. Windows that the watermark hasn't passed at the end stay open."""
    # a stream reads a folder: the table's file is picked by its name
    events = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return run_available(stream_counters(events.withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["event_type"], "1 hour"), shared_path(spark, "event-counters"))


COUNTERS_SQL = """
SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2
HAVING date_trunc('hour', min(ts)) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 SECOND FROM events)"""

QUERIES = {"event_counters": event_counters}
SQL = {"event_counters": COUNTERS_SQL}
