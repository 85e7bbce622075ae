"""Audit of how far the sources of a language differ in their use of terms, with a frequent-pattern tree of term rows.

A source's share of a term is p = 1 + floor(scale * (count + smoothing) / (N + smoothing * V)); the divergence of two
sources is the sum of abs(p - q) over all V terms that the language keeps. Most counts are 0, and a source gives every
term that it doesn't have the same p, its base. So the sum is made of

* V times the distance of the two bases,
* for each source, what its own terms change if the other has none of them (running sums over its different p),
* for terms that both have, a correction for each pair of sources.

The corrections come from the tree: the row of a term is the list of its sources, in order, with their p; rows are
inserted with their multiplicities, so rows that begin alike share nodes, and each pair of a node and an ancestor gives
its correction once, times the number of rows through the node. Rows are range-sorted first, so that what is alike
meets in one task; a task's tree is emptied at ``NODES`` nodes, and what it has added up by pair of sources goes on.

A term's row has at most one entry for each source of the language, and the result has a row for each pair of them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, materialize

LEAST_DOCS, SMOOTHING, SCALE, TOP = 30, 5, 1_000_000_000, 50
#: Different terms that a task counts before it hands them on; nodes of a tree before it is emptied.
TERMS, NODES = 500_000, 1 << 20
#: Bytes of a text that are split together.
SLICE = 1 << 20
#: Groups (language and source) whose totals are broadcast; more are joined by a shuffle, with the same result.
BROADCAST_GROUPS = 100_000
#: Entries of a row by which rows are dealt out in ranges.
PREFIX = 3
#: A-Z become a-z, the rest of ASCII white space.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))
_ONE_DOC = 1 << 44


def term_counts(text: bytes) -> Counter:
    """Occurrences of the terms of a text: runs of ASCII letters (A-Z lower-cased) and characters beyond ASCII."""
    if len(text) <= SLICE:
        return Counter(text.translate(_LETTERS).split())
    out, at = Counter(), 0
    while at < len(text):
        piece = text[at : at + SLICE].translate(_LETTERS)
        to = len(piece)
        while at + to < len(text) and (gap := piece.rfind(b" ")) < 0:
            piece += text[at + to : at + to + SLICE].translate(_LETTERS)
            to = len(piece)
        if at + to < len(text):
            piece, to = piece[:gap], gap + 1
        out.update(piece.split())
        at += to
    return out


def _count(batches: Iterator) -> Iterator:
    import pyarrow as pa

    names = ["lang", "source", "term", "n", "docs"]
    held: dict[tuple, dict[bytes, int]] = {}
    size = 0

    def rows() -> pa.RecordBatch:
        """All that is held, with a row without term for each group."""
        keys, terms, packed = [], [], []
        for k, (group, counts) in enumerate(held.items()):
            keys.append(np.full(len(counts) + 1, k))
            terms += [None, *counts]
            packed += [0, *counts.values()]
        at, packed = np.concatenate(keys), np.array(packed, np.int64)
        groups = list(held)
        langs, sources = (pa.array([g[i] for g in groups], pa.string()).take(pa.array(at)) for i in (0, 1))
        return pa.RecordBatch.from_arrays([langs, sources, pa.array(terms, pa.binary()).cast(pa.string()), pa.array(packed % _ONE_DOC), pa.array(packed // _ONE_DOC)], names=names)

    for batch in batches:
        for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text"))):
            counts = held.setdefault((lang, source), {})
            before = len(counts)
            for term, n in term_counts(text).items():
                counts[term] = counts.get(term, 0) + n + _ONE_DOC
            size += len(counts) - before
            if size >= TERMS:
                yield rows()
                held, size = {}, 0
    if held:
        yield rows()


class Tree:
    """Rows of (source, p, base), inserted with multiplicities; ``totals`` has the corrections by pair of sources."""

    def __init__(self):
        self.children: dict[tuple[int, int, int], int] = {}
        self.source, self.p, self.base, self.parent, self.rows = [], [], [], [], []

    def insert(self, path: list[tuple[int, int, int]], times: int) -> None:
        at = -1
        for source, p, base in path:
            key = at, source, p
            if key not in self.children:
                self.children[key] = len(self.source)
                for column, value in ((self.source, source), (self.p, p), (self.base, base), (self.parent, at), (self.rows, 0)):
                    column.append(value)
            at = self.children[key]
            self.rows[at] += times

    def totals(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(source, later source, sum of corrections): each node with each of its ancestors, once."""
        source, p, base, parent, rows = (np.array(x, np.int64) for x in (self.source, self.p, self.base, self.parent, self.rows))
        keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        node, up = np.arange(len(source)), parent.copy()
        while len(node := node[(on := up >= 0)]):
            up = up[on]
            change = np.abs(p[node] - p[up]) - np.abs(p[node] - base[up]) - np.abs(base[node] - p[up]) + np.abs(base[node] - base[up])
            keys = np.concatenate((keys, (source[up] << 32) | source[node]))
            sums = np.concatenate((sums, change * rows[node]))
            keys, at = np.unique(keys, return_inverse=True)
            total = np.zeros(len(keys), np.int64)
            np.add.at(total, at, sums)
            sums, up = total, parent[up]
        return keys >> 32, keys & 0xFFFFFFFF, sums


def _corrections(batches: Iterator) -> Iterator:
    """Rows (lang, path, times), sorted."""
    import pyarrow as pa

    def out(lang: str, tree: Tree) -> pa.RecordBatch:
        a, b, sums = tree.totals()
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(a), pa.string()), pa.array(a), pa.array(b), pa.array(sums)], names=["lang", "a", "b", "value"])

    lang, tree = None, Tree()
    for batch in batches:
        for own, path, times in zip(*(batch.column(c).to_pylist() for c in ("lang", "path", "times"))):
            if own != lang or len(tree.source) >= NODES:
                yield out(lang, tree)
                lang, tree = own, Tree()
            tree.insert([(x["number"], x["p"], x["base"]) for x in path], times)
    yield out(lang, tree)


def source_divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS, smoothing: int = SMOOTHING, scale: int = SCALE, top: int = TOP) -> DataFrame:
    """``lang, source, part, item, value, rank``: for every group of language and source, its divergence from each other
    source of the language (part ``pair``, all of them), and the ``top`` terms that it uses more than its language
    does (part ``term``), by falling value, then item.

    A language keeps the terms of at least ``least_docs`` of its documents. Null texts, languages and sources are read as
    ''; empty texts make their group known but count nothing. Very long texts are counted whole, in slices. Repeated rows
    are documents each. Ties are ordered by the UTF-8 bytes of the item. A language that keeps no term has pairs with
    value 0. An empty table gives an empty table; other columns don't matter."""
    spark = docs.sparkSession
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    given = docs.select(blank(lang).alias("lang"), blank(source).alias("source"), blank(text).cast("binary").alias("text"))
    counted = given.mapInArrow(_count, "lang string, source string, term string, n long, docs long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    each = counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("of"))
    rows = materialize(each.filter(f"term is null or docs >= {least_docs}").select("lang", "term", "of"), "term-rows")

    # totals of groups and languages; a group's number is its place among the sources of its language
    kept = rows.filter("term is not null").select("lang", "term", F.explode("of").alias("x"), F.aggregate("of", F.lit(0).cast("long"), lambda s, x: s + x["n"]).alias("all")).select("lang", "term", "x.*", "all")
    by_lang = rows.filter("term is not null").groupBy("lang").agg(F.count("*").alias("v"), F.sum(F.aggregate("of", F.lit(0).cast("long"), lambda s, x: s + x["n"])).alias("n_lang"))
    groups = rows.filter("term is null").select("lang", F.explode("of.source").alias("source"))
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("n_group"), F.count("*").alias("own"))
    share = lambda n, whole: F.expr(f"CAST(1 + (CAST({scale} AS DECIMAL(19,0)) * (CAST({n} AS DECIMAL(18,0)) + {smoothing})) div (CAST({whole} AS DECIMAL(18,0)) + {smoothing} * v) AS LONG)")
    groups = groups.join(sums, ["lang", "source"], "left").join(by_lang, "lang", "left").na.fill(0, ["n_group", "own", "v", "n_lang"])
    groups = groups.withColumn("base", F.when(F.col("v") > 0, share("0", "n_group")).otherwise(0).cast("long"))
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long")
    groups = materialize(groups.withColumn("number", number), "groups")

    small = F.broadcast(groups) if groups.count() <= BROADCAST_GROUPS else groups
    cells = kept.join(small, ["lang", "source"]).withColumns({"p": share("n", "n_group"), "q": share("all", "n_lang")})
    cells = materialize(cells.select("lang", "source", "number", "term", "p", "q", "base"), "cells")

    # what the terms of g add to its pair with h if h has none of them: F(x) = sum of abs(p - x) at h's base, from
    # running sums over the p of g
    one, two = groups.alias("g"), groups.alias("h")
    pairs = one.join(two, F.col("g.lang") == F.col("h.lang")).filter("g.number <> h.number")
    points = pairs.select("g.lang", F.col("g.number").alias("g"), F.col("h.base").alias("x"), F.lit(0).cast("long").alias("m"), F.col("h.number").alias("h"), F.col("g.base").alias("own_base"))
    steps = cells.groupBy("lang", F.col("number").alias("g"), F.col("p").alias("x")).agg(F.count("*").alias("m"), F.lit(None).cast("long").alias("h"), F.lit(None).cast("long").alias("own_base"))
    whole = Window.partitionBy("lang", "g")
    up_to = whole.orderBy("x").rangeBetween(Window.unboundedPreceding, 0)
    mass = F.col("m") * F.col("x")
    at = steps.unionByName(points).withColumns({"m_le": F.sum("m").over(up_to), "s_le": F.sum(mass).over(up_to), "m_all": F.sum("m").over(whole), "s_all": F.sum(mass).over(whole)}).filter("h is not null")
    change = F.col("x") * (2 * F.col("m_le") - F.col("m_all")) - 2 * F.col("s_le") + F.col("s_all") - F.col("m_all") * F.abs(F.col("own_base") - F.col("x"))
    ends = lambda a, b: [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]
    single = at.select("lang", *ends("g", "h"), change.alias("value"))
    base = pairs.filter("g.number < h.number").select("g.lang", F.col("g.number").alias("a"), F.col("h.number").alias("b"), (F.col("g.v") * F.abs(F.col("g.base") - F.col("h.base"))).alias("value"))

    paths = cells.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("number", "p", "base"))).alias("path"))
    paths = paths.groupBy("lang", "path").agg(F.count("*").alias("times"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    begin = F.transform(F.slice("path", 1, PREFIX), lambda x: F.struct(x["number"], x["p"]))  # keeps the rows that are sampled for the ranges small
    both = paths.repartitionByRange(parts, "lang", begin).sortWithinPartitions("lang", "path").mapInArrow(_corrections, "lang string, a long, b long, value long")
    value = single.unionByName(base).unionByName(both).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(F.struct(F.col("a").alias("g"), F.col("b").alias("h")), F.struct(F.col("b").alias("g"), F.col("a").alias("h")))).alias("w")
    name = lambda k, c: groups.select("lang", F.col("number").alias(k), F.col("source").alias(c))
    apart = value.select("lang", "value", ways).select("lang", "value", "w.*").join(name("g", "source"), ["lang", "g"]).join(name("h", "item"), ["lang", "h"])

    above = cells.filter("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    part = lambda df, kind: df.select("lang", "source", F.lit(kind).alias("part"), "item", "value", rank.alias("rank"))
    return part(apart, "pair").unionByName(part(above, "term").filter(F.col("rank") <= top))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(documents(spark, sf_dir).select("text", "lang", "source"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n_all FROM t GROUP BY ALL HAVING count(DISTINCT id) >= 30),
lv AS (SELECT lang, count(*) AS v, sum(n_all) AS n_lang FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
gn AS (SELECT lang, source, sum(n) AS n_group FROM c GROUP BY ALL),
cells AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
                 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (coalesce(gn.n_group, 0) + 5 * lv.v) AS p,
                 1 + (1000000000::HUGEINT * (k.n_all + 5)) // (lv.n_lang + 5 * lv.v) AS q
          FROM g JOIN k USING (lang) JOIN lv USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
          LEFT JOIN gn ON gn.lang = g.lang AND gn.source = g.source),
ab AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
       FROM cells a JOIN cells b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(ab.value, 0) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN ab ON ab.lang = a.lang AND ab.source = a.source AND ab.item = b.source),
u AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs
      UNION ALL SELECT lang, source, 'term', term, p - q FROM cells WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM u)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 50"""
