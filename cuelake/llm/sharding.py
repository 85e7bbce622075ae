"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring has 65,536 cells. Every shard stands on it with many virtual nodes, and a document's key falls into one
cell; it belongs to the next virtual node clockwise. A shard that has its full load takes no more: the keys that
overflow continue clockwise to the next shard that has room. Loads are bounded by rows: with n documents a shard
holds floor(n / shards) or one more, so counts are at most one apart.

Only the counts of the cells (a number fixed by the ring, not by the data) reach the driver, where the ring is
filled; the plan that comes back has at most one row for each cell and shard border.

Keys of a cell are ranked in parts, dealt by a hash of the whole row: a key with a third of all rows (no key at all,
say) makes a cell of many parts, each ranked by a task of its own.
"""

from __future__ import annotations

import bisect
import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, materialize

CELL_BITS = 16
CELLS = 1 << CELL_BITS
#: Parts of a cell.
PARTS = 4096


def _hash(*parts) -> int:
    return int.from_bytes(hashlib.blake2b(":".join(map(str, parts)).encode(), digest_size=8).digest())


def ring(shards: int, virtual_nodes: int = 128) -> list[tuple[int, int]]:
    """(cell, shard) of all virtual nodes, in clockwise order."""
    return sorted((_hash("node", s, v) % CELLS, s) for s in range(shards) for v in range(virtual_nodes))


def fill_ring(counts: dict[int, int], shards: int, virtual_nodes: int = 128) -> list[tuple[int, int, int, int, int]]:
    """Rows (cell, from, to, shard, first_slot): ranks from..to-1 of the keys of a cell go to a shard.

    Cells are filled in an order of their own hash, so that what overflows comes from everywhere on the ring."""
    nodes, total = ring(shards, virtual_nodes), sum(counts.values())
    at = [c for c, _ in nodes]
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used, plan = [0] * shards, []
    for cell in sorted(counts, key=lambda c: (_hash("cell", c), c)):
        done, k = 0, bisect.bisect_left(at, cell)
        while done < counts[cell]:
            shard = nodes[k % len(nodes)][1]
            if n := min(counts[cell] - done, room[shard] - used[shard]):
                plan.append((cell, done, done + n, shard, used[shard]))
                used[shard] += n
                done += n
            k += 1
    return plan


def shard_documents(docs: DataFrame, shards: int = 16, virtual_nodes: int = 128, key: str = "doc_id") -> DataFrame:
    """``docs`` with ``shard`` (0 to shards - 1) and ``slot`` (its place in the shard, gapless from 0).

    Rows with the same key fall into the same cell; equal rows are told apart by nothing, so which of them has which
    slot doesn't matter. A null key is a key. Null and very long texts are columns like any other. An empty table gives
    an empty table. Columns named shard or slot are replaced, all others pass through."""
    spark = docs.sparkSession
    docs = docs.drop("shard", "slot")
    hashed = [F.col(f.name) for f in docs.schema if f.dataType.typeName() not in ("map", "variant")]
    keyed = docs.withColumns({"__h": F.xxhash64(key), "__row": F.xxhash64(*hashed)})
    keyed = keyed.withColumns({"__cell": F.shiftrightunsigned("__h", 64 - CELL_BITS).cast("int"), "__part": F.pmod("__row", F.lit(PARTS)).cast("int")})
    sizes = materialize(keyed.groupBy("__cell", "__part").agg(F.count("*").alias("n")), "cells")
    counts = {r[0]: r[1] for r in sizes.groupBy("__cell").agg(F.sum("n")).collect()}  # CELLS rows at most
    plan = spark.createDataFrame(fill_ring(counts, shards, virtual_nodes), "__cell int, __from long, __to long, shard int, __slot long")
    earlier = Window.partitionBy("__cell").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    begins = sizes.select("__cell", "__part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__begin"))
    nth = F.row_number().over(Window.partitionBy("__cell", "__part").orderBy("__h", F.col(key), "__row")) - 1
    ranked = keyed.withColumn("__nth", nth).join(begins, ["__cell", "__part"]).withColumn("__r", F.col("__begin") + F.col("__nth"))
    placed = ranked.join(F.broadcast(plan), "__cell").filter("__r >= __from and __r < __to")  # the plan is bounded by CELLS + shards
    return placed.withColumn("slot", F.col("__slot") + F.col("__r") - F.col("__from")).drop("__h", "__row", "__cell", "__part", "__nth", "__begin", "__r", "__from", "__to", "__slot")


def op5_shard_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    return shard_documents(docs, 16).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
