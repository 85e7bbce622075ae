"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of documents in a shuffled order, offered up to ``max_repeats`` times over. A copy's virtual
finish time is the words of its source up to and including it, divided by the source's weight. All copies of all
sources are ordered by that time, and the queue is cut where the word budget is used up: what comes before the cut is
the mix. So each source gives words in proportion to its weight until it has given all its repeats, and the rest is
shared by the others. ``target`` is what a source would give if documents could be split at will; its words in the mix
are at most one document away from it.

The global order is a range-sort by buckets of virtual time: words are added up by bucket, the bucket in which the budget
runs out is cut into buckets again until it has few copies, and only those are sorted one by one. All other copies
are known to lie before or behind the cut.

Running sums over a source go through fixed buckets of its shuffled order (sums for each bucket first, then within
the bucket), and rows with the same key and size, which nothing tells apart, are dealt over salts: neither a source
nor a key with a third of all rows is ever in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, materialize, word_count

WEIGHTS = (5, 2, 1)
#: Tasks that rows with the same key and size are dealt over, at most.
SALTS = 4096
#: Buckets of virtual time in a round; a bucket with so many copies or fewer is sorted.
TIME_BUCKETS, SORTED = 1 << 16, 1_000_000


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_repeats: int = 3) -> DataFrame:
    """``sizes(source, source_size)`` with each source's weight and ``target``: all words together, shared by
    weight; no target is above ``max_repeats`` times its source's size, and what that cuts off is shared again.

    Weights are dealt over the sources in code-point order, null last. Sources are ordered by the level at which
    they are used up (size / weight), and one running sum gives the level that all others reach."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    rank = (F.row_number().over(by_name) - 1) % len(weights)
    ranked = sizes.withColumn("rank", F.row_number().over(by_name)).withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank + 1).cast("int")))
    ranked = ranked.withColumn("most", (F.col("source_size") * max_repeats).cast("double"))
    by_level = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.sum(F.col("source_size").cast("double")).over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    used_up = ranked.withColumn("used_up", level >= F.col("most") / F.col("weight"))
    left = F.sum(F.col("source_size").cast("double")).over(everything) - F.coalesce(F.sum(F.when(F.col("used_up"), F.col("most"))).over(everything), F.lit(0.0))
    share = F.col("weight") * left / F.sum(F.when(~F.col("used_up"), F.col("weight"))).over(everything)
    return used_up.withColumn("target", F.when(F.col("used_up"), F.col("most")).otherwise(share)).drop("most", "used_up")


OWN = ("size", "source_size", "target", "weight", "taken", "first_finish")


def find_cut(copies: DataFrame, budget: int, last: float, buckets: int = TIME_BUCKETS, most: int = SORTED) -> tuple[float, int, int] | None:
    """(finish, rank, words) of the copy in which the budget of words runs out, and how many of its words still fit.

    ``copies(finish, rank, n)`` have different (finish, rank); ``last`` is no less than any finish. None if
    all copies together have fewer words."""
    inside, low, high, before = copies, 0.0, last, 0
    while True:
        width = (high - low) / buckets
        if width <= 0 or low + width == low:
            break
        at = F.least(F.floor((F.col("finish") - low) / width), F.lit(buckets - 1))
        sums = inside.groupBy(at.alias("b")).agg(F.sum("n").alias("n"), F.count("*").alias("copies"))  # buckets rows at most
        run = sums.withColumn("up_to", F.sum("n").over(Window.orderBy("b")))
        found = run.filter(F.col("up_to") >= budget - before).orderBy("b").first()
        if not found:
            return None
        inside, before = inside.filter(at == found.b), before + found.up_to - found.n
        low, high = low + found.b * width, low + (found.b + 1) * width
        if found.copies <= most:
            break
    run = inside.withColumn("up_to", F.sum("n").over(Window.orderBy("finish", "rank")))  # SORTED copies, or ties of one time
    found = run.filter(F.col("up_to") >= budget - before).orderBy("finish", "rank").first()
    return (found.finish, found["rank"], budget - before - found.up_to + found.n) if found else None


def mix_sources(docs: DataFrame, size: Column, weights=WEIGHTS, max_repeats: int = 3, key: str = "doc_id", source: str = "source", seed: str = "mix", prefix: str = "") -> DataFrame:
    """``docs`` with ``{prefix}size``, ``source_size``, ``target``, ``weight``, ``taken`` (words of the document in the mix,
    repeats counted) and ``first_finish`` (virtual finish time of its first copy).

    The copy at the cut gives only its first words, so the words taken add up to the words of all documents. Null
    texts have size 0 and give nothing; a null source is a source, a null key a key; copies that finish at the
    same time are ordered by source; of rows with the same key, size, and source it is open which comes first, and any
    order takes the same words; an empty table gives an empty table. Very long texts are a size like any other. Other
    columns pass through; of the columns added here an older one with the same name is replaced (see ``prefix``).
    The order depends on the key, the size, and ``seed`` alone, so reruns agree."""
    own = {n: f"{prefix}{n}" for n in OWN}
    docs = docs.drop(*own.values(), "__s", "__o", "__b", "__n", "__k", "__salt")
    rows = docs.withColumns({"__n": size.cast("long"), "__s": F.struct(F.col(source).isNull(), F.coalesce(F.col(source), F.lit(""))), "__k": F.coalesce(F.col(key).cast("string"), F.lit("")), "__salt": F.monotonically_increasing_id()})
    rows = rows.withColumn("__o", F.md5(F.concat("__k", F.lit(f":{seed}:"), F.col("__n").cast("string"))))
    rows = materialize(rows.withColumns({"__b": F.substring("__o", 1, 3), "__salt": F.pmod(F.xxhash64("__salt"), F.lit(SALTS))}), "sizes")  # sizes are counted once
    group = ["__s", "__b", "__o", "__k", "__n", "__salt"]
    groups = rows.groupBy(*group).agg(F.first(source).alias("source"), F.count("*").alias("c"))
    sums = materialize(groups.groupBy("__s", "__b").agg(F.first("source").alias("source"), F.sum(F.col("__n") * F.col("c")).alias("in_bucket")), "bucket-sizes")
    targets = source_targets(sums.groupBy("__s").agg(F.first("source").alias("source"), F.sum("in_bucket").alias("source_size")), weights, max_repeats)
    targets = materialize(targets.select("__s", F.col("source_size").alias("__ss"), F.col("target").alias("__t"), F.col("weight").alias("__w"), F.col("rank").alias("__rank")), "targets")
    before = Window.unboundedPreceding, -1
    earlier = Window.partitionBy("__s").orderBy("__b").rowsBetween(*before)
    buckets = sums.select("__s", "__b", F.coalesce(F.sum("in_bucket").over(earlier), F.lit(0)).alias("__base")).join(targets, "__s")
    in_bucket = Window.partitionBy("__s", "__b").orderBy("__o", "__k", "__n", "__salt").rowsBetween(*before)
    begins = groups.withColumn("__in", F.coalesce(F.sum(F.col("__n") * F.col("c")).over(in_bucket), F.lit(0))).join(buckets, ["__s", "__b"])
    nth = F.row_number().over(Window.partitionBy(*group).orderBy(F.lit(1))) - 1
    placed = rows.join(begins.drop("source", "c"), group).withColumn("__at", F.col("__base") + F.col("__in") + nth * F.col("__n"))
    placed = materialize(placed.drop("__b", "__o", "__k", "__salt", "__base", "__in"), "queues")
    finish = lambda e: (F.lit(e) * F.col("__ss") + F.col("__at") + F.col("__n")).cast("double") / F.col("__w")
    copies = placed.filter("__n > 0").select(F.explode(F.array(*[finish(e) for e in range(max_repeats)])).alias("finish"), F.col("__rank").alias("rank"), F.col("__n").alias("n"))
    whole = targets.agg(F.sum("__ss"), F.max(F.col("__ss") * max_repeats / F.col("__w"))).first()
    cut = find_cut(copies, whole[0], whole[1]) if whole[0] else None
    taken = F.lit(0)
    for e in range(max_repeats) if cut else ():
        now = F.struct(finish(e), F.col("__rank"))
        at = F.struct(F.lit(cut[0]), F.lit(cut[1]))
        taken = taken + F.when(now < at, F.col("__n")).when(now == at, F.lit(cut[2])).otherwise(0)
    taken = F.when(F.col("__n") > 0, taken).otherwise(0)
    out = {"size": F.col("__n"), "source_size": F.col("__ss"), "target": F.col("__t"), "weight": F.col("__w"), "taken": taken.cast("long"), "first_finish": finish(0)}
    return placed.withColumns({own[n]: c for n, c in out.items()}).drop("__s", "__n", "__ss", "__t", "__w", "__rank", "__at")


def mixed_order(mixed: DataFrame, partitions: int) -> DataFrame:
    """A row for each copy that the mix takes, with ``words`` (how many of its first words) and ``finish``, range-sorted by
    virtual finish time: the order in which to read them. ``mixed`` is what :func:`mix_sources` returns."""
    full = F.floor(F.col("taken") / F.col("size")).cast("int")
    words = F.concat(F.array_repeat("size", full), F.when(F.col("taken") % F.col("size") > 0, F.array(F.col("taken") % F.col("size"))).otherwise(F.array().cast("array<bigint>")))
    each = mixed.filter("taken > 0").select("*", F.posexplode(words).alias("copy", "words"))
    each = each.withColumn("finish", F.col("first_finish") + F.col("copy") * F.col("source_size") / F.col("weight"))
    return each.repartitionByRange(partitions, "finish").sortWithinPartitions("finish")


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return mix_sources(docs.withColumnRenamed("size", "n"), F.col("n")).select("doc_id", "size", "source_size", "target", "taken", "first_finish")


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[\x09-\x0D\x20]+'), lambda x: x <> '')) AS BIGINT) AS size
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank, CAST([5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1] AS DOUBLE) AS weight,
             CAST(source_size * 3 AS DOUBLE) AS most FROM s),
l AS (SELECT *, (sum(CAST(source_size AS DOUBLE)) OVER () - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
                >= most / weight AS used_up FROM r),
t AS (SELECT source, source_size, weight, rank, CASE WHEN used_up THEN most ELSE weight
        * (sum(CAST(source_size AS DOUBLE)) OVER () - coalesce(sum(most) FILTER (WHERE used_up) OVER (), 0))
        / sum(weight) FILTER (WHERE NOT used_up) OVER () END AS target FROM l),
o AS (SELECT *, coalesce(CAST(doc_id AS VARCHAR), '') AS k, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':mix:' || size) AS o FROM d),
c AS (SELECT o.doc_id, o.size, t.source_size, t.target, t.weight, t.rank, row_number() OVER () AS rid,
             CAST(coalesce(sum(o.size) OVER (PARTITION BY o.source ORDER BY o.o, o.k, o.size
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos
      FROM o JOIN t ON o.source IS NOT DISTINCT FROM t.source),
q AS (SELECT rid, size, rank, CAST(e * source_size + pos + size AS DOUBLE) / weight AS finish FROM c, (SELECT unnest([0, 1, 2]) AS e) WHERE size > 0),
u AS (SELECT rid, greatest(0, least(size, (SELECT sum(size) FROM d) - coalesce(sum(size) OVER (ORDER BY finish, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS taken FROM q),
v AS (SELECT rid, sum(taken) AS taken FROM u GROUP BY rid)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken, CAST(pos + size AS DOUBLE) / weight AS first_finish
FROM c LEFT JOIN v USING (rid)"""
