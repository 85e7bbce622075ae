"""Near-duplicates by SimHash, linked with BK-trees.

Fingerprints are computed per document (whole texts, shingles with repeats) and equal fingerprints are brought
together first, so exact copies and documents with one fingerprint cost one row. Two fingerprints with at most
``radius`` differing bits agree on at least ``BLOCKS - radius`` of ``BLOCKS`` bit blocks; each pair of blocks makes
a shard key, and all links are found inside shards. A shard's tree is a BK-tree: children stand under the Hamming
distance to their parent, and a search follows only the edges within the radius.

A tree remembers for each subtree whether all of it is in one group already; a search skips subtrees of its own
group. A dense shard (thousands of near copies) so costs a few steps for each member and gives a spanning forest,
never all pairs. Shards above ``TREE`` fingerprints are cut into chunks, and each pair of chunks is a task of its
own. Trees travel to the tasks by the shuffle, not by a broadcast from the driver: together they hold every
fingerprint, which must not be collected there, and each is bounded by ``TREE``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, materialize
from .components import connected_components

RADIUS = 4
#: Bit blocks (first bit, bits).
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
TREE = 1 << 17


def fingerprint(words: list[bytes], n: int = 4) -> int:
    """SimHash of the n-word shingles of the words, as an unsigned 64-bit number."""
    import numpy as np
    from xxhash import xxh64_intdigest

    if not words:
        return 0
    text = b" ".join(words)
    if len(words) <= n:
        hashes = [xxh64_intdigest(text, 42)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = np.concatenate(([0], ends[: -n] + 1)).tolist()
        hashes = [xxh64_intdigest(text[a:b], 42) for a, b in zip(starts, ends[n - 1 :].tolist())]
    total = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[k : k + (1 << 16)], "<u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * total > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def _fingerprints(batches: Iterator) -> Iterator:
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        texts = batch.column("__text").to_pylist()
        # bytes.lower() changes A-Z only, bytes.split() splits at the six ASCII white-space bytes
        prints = np.array([fingerprint((t or b"").lower().split()) for t in texts], np.uint64).view(np.int64)
        rest = [batch.column(i) for i, n in enumerate(batch.schema.names) if n != "__text"]
        names = [n for n in batch.schema.names if n != "__text"]
        yield pa.RecordBatch.from_arrays([*rest, pa.array(prints)], names=[*names, "fp"])


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` and ``fp``, the fingerprint as a signed long. Null and blank texts have 0."""
    given = docs.select(*keep, F.col(text).cast("binary").alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.drop("__text").schema)
    return given.mapInArrow(_fingerprints, f"{schema}, fp long")


class Forest:
    """Groups of numbers, joined by union."""

    def __init__(self):
        self.up = {}

    def find(self, x: int) -> int:
        up = self.up
        while (p := up[x]) != x:
            up[x] = x = up[p]
        return x

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


class BKTree:
    """Nodes are [fingerprint, group that the whole subtree is in or None, {distance: child}]."""

    def __init__(self, radius: int, forest: Forest):
        self.radius, self.forest, self.root = radius, forest, None

    def link(self, fp: int) -> None:
        """Join ``fp`` to the groups of all members within the radius."""
        forest, radius, stack = self.forest, self.radius, [self.root] if self.root else []
        while stack:
            node = stack.pop()
            if node[1] is not None and forest.find(node[1]) == forest.find(fp):
                continue
            d = (node[0] ^ fp).bit_count()
            if d <= radius:
                forest.union(node[0], fp)
            for edge in sorted(node[2], key=lambda e: -abs(e - d)):
                if d - radius <= edge <= d + radius:
                    stack.append(node[2][edge])

    def insert(self, fp: int) -> None:
        own = self.forest.find(fp)
        if self.root is None:
            self.root = [fp, own, {}]
            return
        node = self.root
        while True:
            if node[1] is not None and self.forest.find(node[1]) != own:
                node[1] = None
            d = (node[0] ^ fp).bit_count()
            if d == 0:
                return
            if d not in node[2]:
                node[2][d] = [fp, own, {}]
                return
            node = node[2][d]


def shard_links(left: list[int], right: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links (member, group's smallest member) that connect what is within the radius in ``left`` (all of it goes
    into the tree) and between ``left`` and ``right`` (it only searches)."""
    forest = Forest()
    tree = BKTree(radius, forest)
    for fp in left:
        forest.up.setdefault(fp, fp)
        tree.link(fp)
        tree.insert(fp)
    for fp in right:
        forest.up.setdefault(fp, fp)
        tree.link(fp)
    return [(x, r) for x in forest.up if (r := forest.find(x)) != x]


def _linker(radius: int):
    def run(batches: Iterator) -> Iterator:
        """Rows (key, a, b, chunk, fp, id), sorted by key, a, b, chunk: one shard, or pair of its chunks, after another."""
        import numpy as np
        import pyarrow as pa

        def links(rows: list[tuple]) -> list[tuple[int, int]]:
            ids = {r[1]: r[2] for r in rows}
            first = rows[0][0]
            found = shard_links([r[1] for r in rows if r[0] == first], [r[1] for r in rows if r[0] != first], radius)
            return [(ids[x], ids[r]) for x, r in found]

        open_key, open_rows = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            key, a, b, chunk, fp, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1
            starts = np.concatenate(([0], cuts))
            ends = np.concatenate((cuts, [len(key)]))
            out, fp = [], fp.view(np.uint64)
            last = len(starts) - 1
            for k in np.flatnonzero((ends - starts > 1) | (np.arange(last + 1) == 0) | (np.arange(last + 1) == last)).tolist():
                s, e = int(starts[k]), int(ends[k])
                own = (int(key[s]), int(a[s]), int(b[s]))
                rows = list(zip(chunk[s:e].tolist(), fp[s:e].tolist(), ids[s:e].tolist()))
                if k == 0 and own == open_key:
                    open_rows.extend(rows)
                    rows = open_rows
                elif k == 0 and len(open_rows) > 1:
                    out += links(open_rows)
                if k == last:
                    open_key, open_rows = own, rows
                else:
                    out += links(rows) if len(rows) > 1 else []
            if out:
                u, v = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])
        if len(open_rows) > 1 and (out := links(open_rows)):
            u, v = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


def link_fingerprints(prints: DataFrame, radius: int = RADIUS, tree: int = TREE) -> DataFrame:
    """Edges (u, v) between the ids of ``prints(fp, id)`` (one row for each fingerprint) that connect every pair of
    fingerprints within ``radius`` of each other, through others or directly. ``radius`` is at most 4."""
    if radius > len(BLOCKS) - 2:
        raise ValueError("the shard keys find every link up to a radius of 4")
    keys = []
    for n, ((a, x), (b, y)) in enumerate(combinations(BLOCKS, 2)):
        one, two = (F.shiftrightunsigned("fp", s).bitwiseAND((1 << w) - 1) for s, w in ((a, x), (b, y)))
        keys.append(F.shiftleft(F.lit(n).cast("long"), 32) + F.shiftleft(one, 16) + two)
    rows = prints.select("fp", "id", F.explode(F.array(*keys)).alias("key"))
    sizes = rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    rows = rows.join(sizes, "key").withColumn("chunks", F.ceil(F.col("n") / tree).cast("int"))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = rows.select("key", F.least("chunk", "other").alias("a"), F.greatest("chunk", "other").alias("b"), "chunk", "fp", "id")
    parts = max(1, int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(parts, "key", "a", "b").sortWithinPartitions("key", "a", "b", "chunk").mapInArrow(_linker(radius), "u long, v long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """``key, fp, component_id`` for every row of ``docs``; the key is an integer, the component's id the smallest
    key that is reachable by links.

    Null, empty and blank texts share fingerprint 0 and are linked like any other. Rows with an equal key and text
    give equal rows. Rows with a null key keep their fingerprint but take part in no link of others, and get the
    component of their fingerprint. An empty table gives an empty table. Other columns don't matter."""
    rows = materialize(fingerprints(docs.select(F.col(key).alias("__key"), F.col(text).alias("__body")), ["__key"], "__body"), "fingerprints")
    prints = materialize(rows.filter("__key is not null").groupBy("fp").agg(F.min("__key").cast("long").alias("id")), "distinct-fingerprints")
    parts = connected_components(link_fingerprints(prints, radius))
    owner = prints.join(parts, prints.id == parts.node, "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    return rows.join(owner, "fp", "left").select(F.col("__key").alias(key), "fp", "component_id")


def op3_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(documents(spark, sf_dir))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
