"""Benchmark decontamination with a distributed positional inverted index.

The index is cut by documents into segments of about ``SEGMENT`` bytes of text; a segment has a row for each
document (its first position and number of words) and for each term (its number of occurrences and its positions,
as gaps). It is a table in the shared folder. If the test set has at most ``MAX_TERMS`` different words, only those
are indexed; beyond that every word is.

A test item is looked up window by window. The words of a window are ordered by their number in the whole corpus,
rarest first: the positions of the rarest one, less its offset in the window, are the candidates, and each further
word keeps those that it also stands at. What is left are exact matches; with ``slop`` a word may stand up to so
many places off (proximity matches). Segments hold whole documents, so a passage that stands in very many
documents is found where they are and nothing is shuffled for it. Test items are taken in blocks of ``BLOCK_WORDS``
words, each of which is broadcast; results of blocks are merged for each document.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialize

SEGMENT = 16 << 20
MAX_TERMS = 1_000_000
BLOCK_WORDS = 2_000_000
WINDOW = 10
#: Places between two documents of a segment; more than a window and its slop.
GAP = 128
#: Candidates looked at at once.
AT_ONCE = 1 << 21

#: ASCII bytes that aren't letters or digits become spaces, capitals small letters.
_TABLE = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in (x + 32 if 65 <= x <= 90 else x for x in range(256)))


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TABLE).split()


class _Numbers(dict):
    """Gives each new word the next number."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


_INDEX = "segment long, doc long, term binary, n long, gaps array<int>"


def _indexer(terms):
    """terms: broadcast set of the words to index, or None for all."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        known = None if terms is None else terms.value

        def emit(keys, counts, numbers, ids):
            segment = random.SystemRandom().getrandbits(63)
            counts = np.array(counts, np.int64)
            starts = np.cumsum(counts + GAP) - counts  # a gap stands before each document
            yield pa.RecordBatch.from_arrays([pa.array([segment] * len(keys), pa.int64()), pa.array(keys, pa.int64()), pa.nulls(len(keys), pa.binary()), pa.array(counts), pa.ListArray.from_arrays(np.arange(len(keys) + 1, dtype=np.int32), pa.array(starts.astype(np.int32)))], names=["segment", "doc", "term", "n", "gaps"])
            ids = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            at = np.arange(len(ids)) + np.repeat(starts - (np.cumsum(counts) - counts), counts)
            if known is not None:
                at, ids = at[ids >= 0], ids[ids >= 0]
            order = np.argsort(ids, kind="stable")
            ids, at = ids[order], at[order]
            cuts = np.flatnonzero(np.diff(ids, prepend=-1))
            gaps = np.diff(at, prepend=0)
            gaps[cuts] = at[cuts]
            vocabulary = list(numbers)
            found = [vocabulary[i] for i in ids[cuts].tolist()]
            size = np.diff(np.append(cuts, len(ids)))
            for k in range(0, len(found), 20_000):
                e = min(len(found), k + 20_000)
                own, last = cuts[k:e], cuts[e] if e < len(found) else len(ids)
                lists = pa.ListArray.from_arrays(np.append(own - own[0], last - own[0]).astype(np.int32), pa.array(gaps[own[0] : last].astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array([segment] * (e - k), pa.int64()), pa.nulls(e - k, pa.int64()), pa.array(found[k:e], pa.binary()), pa.array(size[k:e]), lists], names=["segment", "doc", "term", "n", "gaps"])

        def fresh():
            return {w: i for i, w in enumerate(known)} if known is not None else _Numbers()

        keys, counts, ids, size, numbers = [], [], [], 0, fresh()
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = words(text.as_py())
                if known is None:
                    ids.append(np.fromiter(map(numbers.__getitem__, own), np.int32, len(own)))
                else:
                    ids.append(np.fromiter((numbers.get(w, -1) for w in own), np.int32, len(own)))
                keys.append(key)
                counts.append(len(own))
                size += 8 + sum(map(len, own)) + len(own)
                if size >= SEGMENT:
                    yield from emit(keys, counts, numbers, ids)
                    keys, counts, ids, size, numbers = [], [], [], 0, fresh()
        if keys:
            yield from emit(keys, counts, numbers, ids)

    return run


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text", terms: list[bytes] | None = None) -> DataFrame:
    """The index of ``docs`` as a written table: ``segment, doc, term, n, gaps``. Rows without a term are documents:
    key, words, and first position."""
    own = docs.sparkSession.sparkContext.broadcast(sorted(terms)) if terms is not None else None  # MAX_TERMS at most
    given = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("binary").alias("body"))
    return materialize(given.mapInArrow(_indexer(own), _INDEX), "positions")


def _item_words(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([words(t) for t in batch.column(1).to_pylist()], pa.list_(pa.binary()))], names=["item", "words"])


def _searcher(block, window: int, slop: int):
    """block: broadcast (terms, their numbers in the corpus, [(item, term ids)])."""
    prepared = []

    def prepare():
        """The windows of the block, sorted by their rarest term."""
        import numpy as np

        terms, freq, items = block.value
        rows, places, sizes, owner = [], [], [], []
        for item, (_, ids) in enumerate(items):
            for k in range(max(1, len(ids) - window + 1)):
                own = ids[k : k + window]
                by = sorted(range(len(own)), key=lambda i: (freq[own[i]], i))
                if not own or not freq[own[by[0]]]:  # its rarest word is in no document
                    continue
                fill = window - len(own)
                rows.append([own[i] for i in by] + [-1] * fill)
                places.append(by + [0] * fill)
                sizes.append(len(own))
                owner.append(item)
        rows, places = np.array(rows, np.int32).reshape(-1, window), np.array(places, np.int32).reshape(-1, window)
        order = np.argsort(rows[:, 0], kind="stable")
        return {w: i for i, w in enumerate(terms)}, rows[order], places[order], np.array(sizes, np.int64)[order], np.array(owner, np.int64)[order]

    def run(table):
        import numpy as np
        import pyarrow as pa

        if not prepared:
            prepared.append(prepare())
        numbers, rows, places, sizes, owner = prepared[0]
        terms = table.column("term").to_pylist()
        keys, n, lists = table.column("doc").to_pylist(), table.column("n").to_numpy(), table.column("gaps").combine_chunks()
        values, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
        docs = np.array([i for i, t in enumerate(terms) if t is None], np.int64)
        begin = values[offsets[docs]].astype(np.int64)
        order = np.argsort(begin, kind="stable")
        docs, begin = docs[order], begin[order]
        length = int(begin[-1] + n[docs[-1]]) if len(docs) else 0
        pad = GAP
        token = np.full(length + 2 * pad, -2, np.int32)
        spots = {}
        for i, t in enumerate(terms):
            if t is not None and (k := numbers.get(t)) is not None:
                spots[k] = at = np.cumsum(values[offsets[i] : offsets[i + 1]], dtype=np.int64)
                token[at + pad] = k
        starts, which = [], []

        def search(candidates, w):
            """Keep what the further terms of the windows also stand at, rarest first."""
            for r in range(1, window):
                if not len(candidates):
                    break
                need, off = rows[w, r], places[w, r]
                at = candidates + off + pad
                ok = need == -1
                for d in range(-slop, slop + 1):
                    ok |= token[np.clip(at + d, 0, len(token) - 1)] == need
                candidates, w = candidates[ok], w[ok]
            starts.append(candidates)
            which.append(w)

        edges = np.searchsorted(rows[:, 0], np.arange(len(numbers) + 1))
        waiting, held = [], 0
        for k, at in spots.items():
            lo, hi = int(edges[k]), int(edges[k + 1])
            step = max(1, AT_ONCE // max(1, hi - lo))
            for s in range(0, len(at) if hi > lo else 0, step):
                part = at[s : s + step]
                w = np.tile(np.arange(lo, hi), len(part))
                waiting.append((np.repeat(part, hi - lo) - places[w, 0], w))
                held += len(w)
                if held >= AT_ONCE:
                    search(*(np.concatenate(x) for x in zip(*waiting)))
                    waiting, held = [], 0
        if waiting:
            search(*(np.concatenate(x) for x in zip(*waiting)))
        at, w = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, which))
        doc = np.searchsorted(begin, at, side="right") - 1
        if slop:  # a loose match may start before its document or end after it
            inside = (doc >= 0) & (at < begin[np.maximum(doc, 0)] + n[docs[np.maximum(doc, 0)]])
            at, w, doc = at[inside], w[inside], doc[inside]
        order = np.lexsort((at, doc))
        at, w, doc = at[order], w[order], doc[order]
        low, high = np.searchsorted(doc, np.arange(len(docs))), np.searchsorted(doc, np.arange(len(docs)), side="right")
        froms, tos, items = [], [], []
        for d in range(len(docs)):
            if low[d] == high[d]:
                froms.append(()), tos.append(()), items.append(())
                continue
            s = at[low[d] : high[d]] - begin[d]
            e = np.maximum.accumulate(s + sizes[w[low[d] : high[d]]])
            new = np.flatnonzero(np.append(True, s[1:] > e[:-1]))
            froms.append(s[new].tolist())
            tos.append(e[np.append(new[1:] - 1, len(e) - 1)].tolist())
            items.append([block.value[2][i][0] for i in np.unique(owner[w[low[d] : high[d]]]).tolist()])
        longs = pa.list_(pa.int64())
        segment = table.column("segment")[0].as_py()
        return pa.table({"segment": pa.array([segment] * len(docs), pa.int64()), "first": pa.array(begin), "key": pa.array([keys[i] for i in docs], pa.int64()), "n_words": pa.array(n[docs]), "froms": pa.array(froms, longs), "tos": pa.array(tos, longs), "items": pa.array(items, longs)})

    return run


def find_items(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, slop: int = 0) -> DataFrame:
    """For every document ``key, n_words, spans, items``: the runs of its words (from, to) that stand in an
    occurrence of a window of an item, merged, and the ids of the items with such a window.

    A window is ``window`` consecutive words of an item, or all its words if there are fewer. With ``slop`` the
    matches are by proximity: each word of the window may stand up to ``slop`` places off, and a span still has the
    window's length. Keys and item ids are integers. Null and empty texts have no words and no matches; an item
    without words has no window; items with a null id are one item, null in ``items``; repeated items and rows are all reported; an empty table on either side gives no
    matches; other columns don't matter."""
    if window + slop >= GAP // 2:
        raise ValueError("documents stand too close in the index for this window and slop")
    spark = docs.sparkSession
    tests = materialize(items.select(F.col(item).cast("long").alias("item"), F.col(item_text).cast("binary").alias("body")).mapInArrow(_item_words, "item long, words array<binary>").filter("size(words) > 0"), "items")
    terms = materialize(tests.select(F.explode("words").alias("term")).distinct(), "terms")
    small = terms.count() <= MAX_TERMS
    index = build_index(docs, key, text, [bytes(r[0]) for r in terms.collect()] if small else None)
    counts = materialize(index.filter("term is not null").groupBy("term").agg(F.sum("n").alias("freq")).join(terms, "term", "left_semi"), "frequencies")
    total = tests.agg(F.sum(F.size("words"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_WORDS))
    found = None
    for b in range(blocks):
        own = tests.filter(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == b) if blocks > 1 else tests
        freq = {bytes(r[0]): r[1] for r in own.select(F.explode("words").alias("term")).distinct().join(counts, "term").collect()}  # a block's words
        names = sorted(freq)
        at = {w: i for i, w in enumerate(names)}
        at_none = len(names)  # a word that no document has
        rows = [(r[0], [at.get(bytes(w), at_none) for w in r[1]]) for r in own.collect()]  # a block
        block = spark.sparkContext.broadcast((names, [freq[w] for w in names] + [0], rows))
        wanted = index.filter(F.col("term").isNull()).unionByName(index.join(F.broadcast(spark.createDataFrame([(bytearray(w),) for w in names], "term binary")), "term", "left_semi").select(index.columns)) if not small else index
        out = wanted.groupBy("segment").applyInArrow(_searcher(block, window, slop), "segment long, first long, key long, n_words long, froms array<long>, tos array<long>, items array<long>")
        found = out if found is None else found.unionByName(out)
    if blocks > 1:
        join = lambda c: F.flatten(F.collect_list(c)).alias(c)  # noqa: E731  of one document
        found = found.groupBy("segment", "first").agg(F.first("key").alias("key"), F.first("n_words").alias("n_words"), join("froms"), join("tos"), join("items"))
    return found.select(F.col("key").alias(key), "n_words", F.sort_array(F.arrays_zip(F.col("froms").alias("from"), F.col("tos").alias("to"))).alias("spans"), F.array_distinct("items").alias("items"))


def words_in(spans):
    """Words in the union of spans that are sorted by their start."""
    step = lambda a, x: F.struct((a.n + F.greatest(x["to"] - F.greatest(x["from"], a.end), F.lit(0))).alias("n"), F.greatest(a.end, x["to"]).alias("end"))
    return F.aggregate(spans, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")), step, lambda a: a.n)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_items(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", words_in(F.col("spans")).alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP10_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT DISTINCT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS k, list_slice(w, i, i + least(len(w), {WINDOW}) - 1) AS g
       FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - {WINDOW - 1}, 1))) AS i FROM b WHERE len(w) > 0)),
k AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT rid, k, i, list_slice(w, i, i + k - 1) AS g
       FROM (SELECT rid, k, w, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d, k WHERE len(w) >= k)),
m AS (SELECT rid, i, dw.k AS k, item_id FROM dw JOIN bw ON dw.g = bw.g),
h AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(generate_series(i, i + k - 1)) AS p FROM m) GROUP BY rid),
t AS (SELECT rid, count(*) AS n, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, h.n IS NOT NULL AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN t USING (rid)"""
