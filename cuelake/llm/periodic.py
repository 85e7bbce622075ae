"""Periodic runs of words by descending-LCP Kruskal, and texts with their repeats collapsed.

A run is a stretch of words with smallest period q that no neighbouring word extends. Let s be its start: the suffixes
at s and s + q share exactly length - q words, and no suffix between them shares as many (it would give a smaller
period). So, when suffixes are united in order of decreasing common prefix (Kruskal over the neighbours in suffix
order, with union-find over ordered sets of positions), s and s + q become neighbours in one set just when it is
united at length - q. Every pair that becomes neighbours at a distance within the common prefix is looked at as
the seed of a run, and kept if the word before doesn't extend it to the left.

A run of at least ``least`` words and ``times`` periods has a common prefix of at least least - least // times words;
suffixes with a shorter one are never united, and a text in which no such stretch of words occurs twice is done after
one sort of hashes. Suffix order is made by prefix doubling in numpy. Texts are independent, so nothing is shuffled.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, let, text_words
from .words import hash_words, mix

LEAST, TIMES = 24, 3
#: Columns that :func:`periodic_runs` adds.
OWN = ("n_words", "runs", "collapsed")


class Positions:
    """An ordered set of positions, in blocks, so that an insertion into a large set moves few of them."""

    BLOCK = 1024

    def __init__(self, x: int):
        self.size, self.blocks, self.first = 1, [[x]], [x]

    def add(self, x: int) -> tuple[int, int]:
        """The positions before and after x, -1 where there is none."""
        k = max(0, bisect_left(self.first, x) - 1)
        block = self.blocks[k]
        i = bisect_left(block, x)
        before = block[i - 1] if i else -1
        after = block[i] if i < len(block) else self.first[k + 1] if k + 1 < len(self.first) else -1
        block.insert(i, x)
        self.first[k] = block[0]
        self.size += 1
        if len(block) > 2 * self.BLOCK:
            self.blocks[k : k + 1] = [block[: self.BLOCK], block[self.BLOCK :]]
            insort(self.first, block[self.BLOCK])
        return before, after

    def __iter__(self) -> Iterator[int]:
        for block in self.blocks:
            yield from block


def suffix_order(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of ``h`` in the order of their suffixes, and the common prefix of each with the next."""
    n, width = len(h), 1
    rank = np.unique(h, return_inverse=True)[1].astype(np.int64)
    levels = [rank]
    while True:
        tail = np.zeros(n, np.int64)
        tail[: max(0, n - width)] = rank[width:] + 1
        pair = rank * (n + 1) + tail
        order = np.argsort(pair, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.diff(pair[order], prepend=pair[order[0]]) != 0)
        rank, width = new, 2 * width
        if rank[order[-1]] == n - 1:
            break
        levels.append(rank)
    a, b = order[:-1].copy(), order[1:].copy()
    common = np.zeros(n - 1, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        inside = np.flatnonzero((a < n) & (b < n))
        same = inside[levels[k][a[inside]] == levels[k][b[inside]]]
        common[same] += 1 << k
        a[same] += 1 << k
        b[same] += 1 << k
    return order, common


def find_runs(h: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs in a sequence of word numbers, by start, then period."""
    order, common = suffix_order(h)
    shortest = least - least // times
    edges = np.flatnonzero(common >= shortest)
    edges = edges[np.argsort(-common[edges], kind="stable")]
    up: dict[int, int] = {}
    sets: dict[int, Positions] = {}

    def find(x: int) -> int:
        if x not in up:
            up[x], sets[x] = x, Positions(x)
            return x
        while (p := up[x]) != x:
            up[x] = x = up[p]
        return x

    best: dict[tuple[int, int], int] = {}
    for a, b, shared in zip(order[edges].tolist(), order[edges + 1].tolist(), common[edges].tolist()):
        large, small = find(a), find(b)
        if sets[large].size < sets[small].size:
            large, small = small, large
        up[small] = large
        into, last = sets[large], -1
        for x in sets.pop(small):
            before, after = into.add(x)
            for i, j in ((before, x), (x, after)):
                if i < 0 or j < 0 or i == last and j == x:  # both came from the smaller set
                    continue
                q = j - i
                if (times - 1) * q <= shared and q + shared >= least and (i == 0 or h[i - 1] != h[j - 1]):
                    span = i, q + shared
                    best[span] = min(q, best.get(span, q))
            last = x
    return sorted((start, length, q) for (start, length), q in best.items())


def _repeats(h: np.ndarray, bounds: np.ndarray, width: int) -> list[int]:
    """Texts in which some stretch of ``width`` words stands twice."""
    if len(h) < width:
        return []
    w, size = h, 1
    while 2 * size <= width:
        w, size = mix(w[: len(w) - size] * np.uint64(3) + w[size:]), 2 * size
    if size < width:
        w = mix(w[: len(w) - (width - size)] * np.uint64(5) + w[width - size :])
    out = []
    for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), (bounds[1:] - width + 1).tolist())):
        if b - a > 1:
            s = np.sort(w[a:b])
            if (s[1:] == s[:-1]).any():
                out.append(i)
    return out


def runs_of(text: bytes, h: np.ndarray, least: int, times: int) -> tuple[list[tuple[int, int, int]], list[bytes]]:
    """Runs and words of a text with the hashes ``h`` of its words; hashes that clash are found out, and words numbered."""
    words = text.split()  # at the six ASCII white-space bytes
    found = find_runs(h, least, times)
    if any(words[s : s + n - q] != words[s + q : s + n] for s, n, q in found):
        numbers: dict[bytes, int] = {}
        found = find_runs(np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64), least, times)
    return found, words


def _finder(least: int, times: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            texts = batch.column("__text")
            h, bounds = hash_words(texts)
            runs: list[list] = [[] for _ in range(len(texts))]
            changed: dict[int, bytes] = {}
            for i in _repeats(h, bounds, least - least // times):
                found, words = runs_of(texts[i].as_py(), h[bounds[i] : bounds[i + 1]], least, times)
                runs[i] = [dict(start=s, length=n, period=q) for s, n, q in found]
                if found:
                    drop = np.zeros(len(words) + 1, np.int64)
                    for s, n, q in found:
                        drop[s + q] += 1
                        drop[s + n] -= 1
                    keep = np.flatnonzero(np.cumsum(drop[:-1]) == 0).tolist()
                    changed[i] = b" ".join([words[k] for k in keep])
            collapsed = [changed[i] if i in changed else b" ".join((t.as_py() or b"").split()) for i, t in enumerate(texts)]
            rest = [c for c in batch.schema.names if c != "__text"]
            arrays = [*(batch.column(c) for c in rest), pa.array(np.diff(bounds)), pa.array(runs, kind), pa.array(collapsed, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*rest, *OWN])

    return run


def periodic_runs(docs: DataFrame, keep: list[str], text: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """The columns ``keep`` with ``n_words``, ``runs`` (array of start, length, period in words, by start, then period) and
    ``collapsed``: the text's words joined by one space, without those that any run holds after its first period.

    Runs have at least ``least`` words and ``times`` (2 at least) periods. Null, empty and blank texts have no words, no
    runs and an empty ``collapsed``. Texts are looked at whole, whatever their length. Repeated rows, null keys and ties
    give a row each, as rows are independent; an empty table gives an empty table. A column of ``keep`` that is
    called n_words, runs or collapsed is replaced."""
    if times < 2 or least < 2 * times:
        raise ValueError("a run has two periods or more, and least is at least twice as many words")
    given = docs.select(*[c for c in keep if c not in OWN], F.col(text).cast("binary").alias("__text"))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in given.drop("__text").schema)
    runs = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return given.mapInArrow(_finder(least, times), schema + runs)


def with_tail(text, doc_id):
    """For one doc_id in ten, the words of ``text`` with everything from word a on repeating the p words from there."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")

    def repeat(w):
        n = F.size(w)
        a = F.pmod(g, F.greatest(n, F.lit(1)).cast("long")).cast("int")
        p = (1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))).cast("int")
        times = F.ceil((n - a) / p).cast("int")
        tail = F.slice(F.flatten(F.array_repeat(F.slice(w, a + 1, p), times)), 1, n - a)
        return F.when(n > 0, F.concat_ws(" ", F.slice(w, 1, a), tail)).otherwise("")

    return F.when(h % 10 == 0, let(text_words(text), repeat)).otherwise(text)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", with_tail(F.col("text"), F.col("doc_id")).alias("text"))
    found = periodic_runs(docs, ["doc_id"])
    longer = lambda x, y: y["length"] * x["period"] > x["length"] * y["period"]
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda x, y: F.when(longer(x, y), y).otherwise(x))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    out = found.withColumns({"best": best, "runs_sha256": F.sha2(listed, 256), "collapsed_sha256": F.sha2("collapsed", 256)})
    milli = F.expr("1000 * best.length div best.period")
    return out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
