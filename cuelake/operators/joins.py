"""Joins that Spark has no operator for: as-of and interval joins, as equi joins and windows.

Neither plans a nested loop: an as-of join is one sort of both sides, an interval join an equi join on time bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, take: list[str], tie: str | None = None, first_if_none: bool = False, tasks: int | None = None) -> DataFrame:
    """``left`` with the columns ``take`` of the latest row of ``right`` at or before it, by key.

    Of right rows at the same time the one with the largest ``tie`` counts. With ``first_if_none`` a left row before
    all right ones gets the earliest. Columns are null where there is none. Names of ``take`` mustn't be on the left. Both sides
    are sorted by ``tasks`` tasks, else by as many as shuffles have."""
    kinds = dict(left.dtypes)
    time = lambda c: F.col(c).cast("double")
    one = left.select(*by, time(left_time).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast("long").alias("__tie"), F.struct(*left.columns).alias("__l"), F.lit(None).cast(f"struct<{', '.join(f'{c}:{dict(right.dtypes)[c]}' for c in take)}>").alias("__r"))
    two = right.select(*by, time(right_time).alias("__t"), F.lit(0).alias("__side"), (F.col(tie).cast("long") if tie else F.lit(None).cast("long")).alias("__tie"), F.lit(None).cast(one.schema["__l"].dataType).alias("__l"), F.struct(*take).alias("__r"))
    order = Window.partitionBy(*by).orderBy("__t", "__side", "__tie")
    found = F.last("__r", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    if first_if_none:
        found = F.coalesce(found, F.first("__r", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing)))
    both = one.unionByName(two)
    out = (both.repartition(tasks, *by) if tasks else both).withColumn("__r", found).filter("__side = 1")
    return out.select(*[F.col(f"__l.{c}").cast(kinds[c]).alias(c) for c in left.columns], *[F.col(f"__r.{c}").alias(c) for c in take])


def bins(low: Column, high: Column, width) -> Column:
    """Numbers of the bins of ``width`` that an interval touches."""
    return F.sequence(F.floor(low / width).cast("long"), F.floor(high / width).cast("long"))


def range_join(points: DataFrame, intervals: DataFrame, by: list[str], point: str, low: str, high: str, width, how: str = "inner", closed: bool = True) -> DataFrame:
    """Pairs of a row of ``points`` and a row of ``intervals`` with the same key and low <= point <= high (< high if
    not ``closed``). ``width``: size of a bin, about the length of an interval. With ``how="left_interval"``
    intervals without a point stay, once. Other columns' names must differ."""
    p = points.filter(F.col(point).isNotNull()).withColumn("__bin", F.floor(F.col(point) / width).cast("long"))
    if how == "left_interval":
        i = intervals.withColumn("__id", F.monotonically_increasing_id())
        b = i.filter(F.col(low) <= F.col(high)).withColumn("__bin", F.explode(bins(F.col(low), F.col(high), width)))
    else:
        b = intervals.filter(F.col(low) <= F.col(high)).withColumn("__bin", F.explode(bins(F.col(low), F.col(high), width)))
    upper = F.col(point) <= F.col(high) if closed else F.col(point) < F.col(high)
    return b.join(p, [*by, "__bin"]).filter((F.col(point) >= F.col(low)) & upper).drop("__bin", "__id")


def overlap_join(left: DataFrame, right: DataFrame, by: list[str], left_span: tuple[str, str], right_span: tuple[str, str], width) -> DataFrame:
    """Pairs whose half-open intervals overlap, with ``overlap_start`` and ``overlap_end``. Each pair comes once:
    from the bin in which the overlap begins."""
    (a, z), (s, e) = left_span, right_span
    span = lambda df, x, y: df.filter(F.col(x) < F.col(y)).withColumn("__bin", F.explode(bins(F.col(x), F.col(y), width)))
    both = span(left, a, z).join(span(right, s, e), [*by, "__bin"]).filter((F.col(z) > F.col(s)) & (F.col(a) < F.col(e)))
    both = both.withColumns({"overlap_start": F.greatest(a, s), "overlap_end": F.least(z, e)})
    return both.filter(F.floor(F.col("overlap_start") / width).cast("long") == F.col("__bin")).drop("__bin")


def state_asof(events: DataFrame, changes: DataFrame, by: list[str], event_time: str, change_time: str, state: str, default=False) -> DataFrame:
    """Events with the state that holds at their time, by a log of its changes."""
    return asof_join(events, changes, by, event_time, change_time, [state]).withColumn(state, F.coalesce(state, F.lit(default)))
