"""Ordered work on a stream of any size by many tasks.

``scanned`` gives running values in two levels: rows are cut into blocks by ranges of stream and order (a written table,
so that a row keeps its block), each block is summed up, the summaries are scanned, and what a block is entered with is added
to the running values within it. ``run_islands`` runs a state machine from the places on at which its state is known
whatever came before, so the islands in between are worked on at the same time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.staging import staged
from .ordered import run_ordered, run_rows


def scanned(df: DataFrame, by: list[str], order: list[str], running: dict[str, tuple[str, Column]], blocks: int | None = None) -> DataFrame:
    """``df`` with a column for each of ``running`` (name: kind, value) over the rows of a key in order: ``sum`` up to and
    including the row (nulls count as 0), ``max`` and ``last`` of the values before it that aren't null (null if there are none).
    Null keys are a key; rows of equal order are in one block, in any order."""
    blocks = blocks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = {f"__{name}": value for name, (_, value) in running.items()}
    rows = staged(df.withColumns(values).repartitionByRange(blocks, *by, *order).withColumn("__block", F.spark_partition_id()), "blocks")
    inside, across = Window.partitionBy(*by, "__block").orderBy(*order), Window.partitionBy(*by).orderBy("__block")
    before = Window.unboundedPreceding, -1
    local, whole, entered = {}, [], {}
    for name, (kind, _) in running.items():
        v, own, into = F.col(f"__{name}"), f"__l_{name}", F.col(f"__e_{name}")
        local[own] = {"sum": F.sum(v).over(inside.rowsBetween(Window.unboundedPreceding, 0)), "max": F.max(v).over(inside.rowsBetween(*before)), "last": F.last(v, ignorenulls=True).over(inside.rowsBetween(*before))}[kind]
        whole.append({"sum": F.sum(v), "max": F.max(v), "last": F.max_by(v, F.when(v.isNotNull(), F.struct(*order)))}[kind].alias(f"__w_{name}"))
        carried = F.col(f"__w_{name}")
        entered[f"__e_{name}"] = {"sum": F.sum(carried), "max": F.max(carried), "last": F.last(carried, ignorenulls=True)}[kind].over(across.rowsBetween(*before))
        running[name] = kind, {"sum": F.coalesce(into, F.lit(0)) + F.coalesce(F.col(own), F.lit(0)), "max": F.greatest(into, F.col(own)), "last": F.coalesce(F.col(own), into)}[kind]
    keys = [F.col(k).alias(f"__k{i}") for i, k in enumerate(by)]
    summed = rows.groupBy(*by, "__block").agg(*whole).withColumns(entered).select(*keys, F.col("__block").alias("__b"), *entered)
    same = F.col("__block") == F.col("__b")
    for i, k in enumerate(by):
        same &= F.col(k).eqNullSafe(F.col(f"__k{i}"))
    out = rows.withColumns(local).join(summed, same)  # a row for each block and key in it
    return out.withColumns({name: value for name, (_, value) in running.items()}).select(*[c for c in df.columns if c not in running], *running)


def run_islands(df: DataFrame, keys: list[str], order: list[str], cut: Column, make: Callable[[], object], schema: StructType | str, blocks: int | None = None, inputs: list[str] | None = None) -> DataFrame:
    """:func:`run_ordered` (with ``inputs`` :func:`run_rows`), beginning anew at the rows where ``cut`` holds: there the machine's
    state must not depend on what came before, and ``end()`` must give what the next row would have ended."""
    islands = scanned(df.withColumn("__cut", cut), keys, order, {"__island": ("sum", F.coalesce(F.col("__cut"), F.lit(False)).cast("long"))}, blocks)
    islands = islands.drop("__cut")
    return run_rows(islands, [*keys, "__island"], order, inputs, make, schema) if inputs else run_ordered(islands, [*keys, "__island"], order, make, schema)
