"""Documents to training shards in five stages: quality rules, near-duplicates, benchmark decontamination, mixing of
sources, sharding. Each stage takes what its predecessor kept, as a table, and all but the last return the columns
of documents. A stage's result has to be written before the next stage is called, as run() does: the scratch tables that it
reads are deleted then.

near_duplicates, decontaminated and mixed_sources number the rows of their input and decide by that number: a doc_id may
be null or stand at different texts.

Null and blank texts fail the quality rules. Handed to a later stage as they are, they are one group of near-duplicates,
hold no benchmark passage, have no words to take (the mix leaves them out), and are sharded like any other row. Very
long texts are looked at whole. Repeated rows are one group; of ties the row with the smaller hash of its columns stays.
An empty table gives an empty table, and columns beside those of documents pass through all stages.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.llm import decontaminate, mixing, quality, sharding, simhash
from cuelake.llm.common import discard, documents, materialize, materialize_at, scratch_tables, word_count

SHARDS = 16
#: Scratch tables of the stages so far, which results that aren't written yet may read.
_left: list[str] = []


def clear_scratch(spark: SparkSession, docs: DataFrame | None = None) -> None:
    """Delete the scratch tables of earlier stages, unless ``docs`` reads one of them."""
    read = set() if docs is None or not _left else {f.rsplit("/", 2)[-2] for f in docs.inputFiles()}
    if not read & {path.rsplit("/", 1)[-1] for path in _left}:
        for path in _left:
            discard(spark, path)
        _left.clear()


def stage(f: Callable) -> Callable:
    """A stage's scratch tables stay until the next stage begins: by then its result, which reads them, has been written."""

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        clear_scratch(spark, docs)
        with scratch_tables() as made:
            out = f(spark, docs, sf_dir)
        _left.extend(made)
        return out

    return run_stage


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and lie within the fences of their language and source. A row goes through the
    rules as one value, so a column with the name of a signal keeps what it holds."""
    rows = docs.select(F.struct(*docs.columns).alias("__doc"), "text", "lang", "source")
    return quality.score_quality(rows, ["__doc"]).filter("kept").select("__doc.*")


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a number of each row, ``__row``, as a written table, so that a row keeps its number."""
    return materialize(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the row with the smallest doc_id (null comes last); of several with it, the
    one whose columns have the smallest hash."""
    rows = numbered(docs)
    groups = simhash.near_duplicates(rows, "__row").select("__row", "component_id")
    order = rows.select("__row", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64(*docs.columns).alias("hash"), "__row").alias("order"))
    first = groups.join(order, "__row").groupBy("component_id").agg(F.min("order").alias("order")).select(F.col("order.__row").alias("__row"))
    return rows.join(first, "__row", "left_semi").select(*docs.columns)


@stage
def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    rows = numbered(docs)
    found = decontaminate.find_items(rows, documents(spark, sf_dir, "benchmark"), key="__row")
    return rows.join(found.filter(F.size("spans") > 0).select("__row"), "__row", "left_anti").select(*docs.columns)


@stage
def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, at most three times. The document at the cut of the queue is
    taken whole. Rows of equal key, source, and size are taken alike but for one at the cut."""
    rows = numbered(docs)
    sizes = rows.select("__row", "doc_id", "source", word_count(F.col("text")).alias("words"))
    mixed = mixing.mix_sources(sizes, F.col("words")).filter("taken > 0")
    copies = F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))
    taken = mixed.select("__row", F.explode(copies).alias("__copy"))
    return rows.join(taken, "__row").select(*docs.columns)


@stage
def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard and slot."""
    return sharding.shard_documents(docs, SHARDS)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_duplicates", near_duplicates),
    ("benchmark_decontamination", decontaminated),
    ("mixed_sources", mixed_sources),
    ("consistent_hash_shards", sharded),
]

#: SQL can't express the bounded-load ring or the fingerprints; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), None
    for name, step in STAGES:
        docs, path = materialize_at(step(spark, docs, sf_dir), name)
        if before:
            discard(spark, before)
        before = path
    clear_scratch(spark)
    return docs
