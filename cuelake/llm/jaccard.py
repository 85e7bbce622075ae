"""N-gram Jaccard join: documents whose sets of word n-grams are at least ``percent`` percent alike, as components.

Sets are hashed n-grams (64 bits). Equal sets are one class, found by a 128-bit digest, and only classes are compared.
N-grams are ordered rare first, by counts of all documents in a sketch of fixed size: n-grams whose counter stands out of
the noise are frequent, the others rare; the hash decides among equals. Two sets that are alike share an n-gram of
their prefixes (the first n - ceil(t n) + 1 in this order), so classes are joined on prefix n-grams, and candidates pass

* the length filter: the smaller set has at least t times the size of the larger,
* the positional filter: what follows the shared n-gram is enough for the overlap that is needed,
* the suffix filter: what follows is cut into ``CELLS`` parts by fixed pivots of the hash; differences in the sizes of the
  parts, and all that stands before, are n-grams that only one of the two has (sizes count to 255, so it is weak for long sets).

Each filter holds for the first n-gram that two alike sets share, so no link is lost. What passes is made distinct and
held against signatures: the parities of the number of n-grams in as many parts of the hash as the set has n-grams, which differ
in no more parts than the sets have n-grams apart. The rest is verified once on the whole sets, which are made again from
the texts of the classes concerned.

A group of thousands of near copies is not compared all with all: in star rounds each class meets one centre for each
of its n-grams and sizes, verified links make components, and after that only classes of different components
meet. Ranges of sizes move by half their width from round to round, so no boundary keeps a group in two, and after the first
round, in which the n-grams of a group mostly have the same centre, each n-gram has a centre of its own, from the largest
component that it stands in: what is alike to that and not to others is met there. What meets at last is
held against signatures at once: those of ``BITS`` parts, and for longer sets those of half as many parts as the whole
signature, since in 256 parts two strange texts of 2,000 words are no farther apart than alike ones may be. N-grams in very
many prefixes are cut into blocks; the largest component of such an n-gram isn't compared with itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from .common import discard, documents, materialize, materialize_at
from .components import connected_components
from .words import hash_words, mix

PERCENT, SHINGLE = 90, 3
#: Counters of the sketch, and how many deviations above the mean make an n-gram frequent.
SLOTS, NOISE = 1 << 18, 4
#: Parts of a suffix; their sizes count to 255 and are the bytes of a long.
CELLS = 8
STARS = 3
#: Parts of the smallest signature. Blocks of so few rows are looked at together.
BITS, FEW = 256, 12
#: Classes of a block of an n-gram; documents' keys that are broadcast (more are joined by shuffle, with the same result).
BLOCK, BROADCAST_KEYS = 1 << 14, 500_000


def shingle_sets(texts, size: int) -> Iterator[np.ndarray]:
    """For each text of an Arrow array the sorted distinct hashes of its ``size``-word shingles; a text of fewer words has one,
    of the whole sequence; one without words none."""
    h, bounds = hash_words(texts, lower=True)
    grams = h
    for k in range(1, size):
        grams = mix(grams[: len(h) - k] + np.uint64(k)) + h[k:]
    grams = mix(grams)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= size:
            s = np.sort(grams[a : b - size + 1])
            yield s[np.concatenate(([True], s[1:] != s[:-1]))]
        elif b > a:
            one = np.full(1, b - a, np.uint64)
            for k in range(a, b):
                one = mix(one) + h[k]
            yield mix(one)
        else:
            yield h[:0]


def digest(s: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit numbers that name a set."""
    from xxhash import xxh3_128_digest

    return tuple(np.frombuffer(xxh3_128_digest(s.tobytes()), "<i8").tolist())


def _counter(size: int):
    def run(batches: Iterator) -> Iterator:
        """A row for each document, and at the end one for each counter of the sketch that isn't 0."""
        import pyarrow as pa

        counts, kind = np.zeros(SLOTS, np.int64), None
        names = ["key", "n", "d1", "d2", "slot", "docs"]
        empty = lambda n, t: pa.nulls(n, t)
        for batch in batches:
            key = batch.column("key")
            kind = key.type
            sets = list(shingle_sets(batch.column("text"), size))
            if sets:
                every = np.concatenate(sets)
                counts += np.bincount((every >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64), minlength=SLOTS)
            d = np.array([digest(s) for s in sets], np.int64).reshape(-1, 2)
            arrays = [key, pa.array([len(s) for s in sets], pa.int64()), pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy()), empty(len(sets), pa.int64()), empty(len(sets), pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=names)
        slots = np.flatnonzero(counts)
        if len(slots):
            n = len(slots)
            yield pa.RecordBatch.from_arrays([empty(n, kind), *(empty(n, pa.int64()) for _ in range(3)), pa.array(slots), pa.array(counts[slots])], names=names)

    return run


def frequency(counts: np.ndarray) -> np.ndarray:
    """A class for each counter of the sketch: 0 within the noise of the mean, else by the logarithm of what stands out."""
    mean = counts.mean()
    noise = max(NOISE * math.sqrt(mean), 1e-9)
    over = (counts - mean) / noise
    return np.where(over <= 1, 0, 1 + np.floor(np.log2(np.maximum(over, 1)))).astype(np.uint8)


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def prefix(s: np.ndarray, classes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The prefix of a set, rare first, and for each of its n-grams the sizes of the parts of what follows it."""
    length = prefix_length(len(s), percent)
    shift = np.uint64(64 - len(classes).bit_length() + 1)
    order = s[np.argsort(classes[(s >> shift).astype(np.int64)], kind="stable")]
    first = order[:length]
    part = lambda x: (x & np.uint64(CELLS - 1)).astype(np.int64)
    seen = np.cumsum(part(first)[:, None] == np.arange(CELLS), axis=0)
    left = np.bincount(part(s), minlength=CELLS) - seen
    return first, np.minimum(left, 255).astype(np.uint8).view("<i8").reshape(-1)


def signature(s: np.ndarray) -> bytes:
    """Parities of the number of hashes in each of a power of two of parts, as bits; BITS parts at least."""
    parts = max(BITS, 1 << (max(1, len(s)) - 1).bit_length())
    odd = np.bincount(((s >> np.uint64(3)) & np.uint64(parts - 1)).astype(np.int64), minlength=parts) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """A signature of so many bytes from a longer one."""
    return np.bitwise_xor.reduce(bits.reshape(-1, size), axis=0)


def half_signature(bits: bytes) -> bytes | None:
    """A signature folded to half its parts: it tells strange long sets apart as well, in half the bytes. None if that
    is no more than BITS."""
    return folded(np.frombuffer(bits, np.uint8), len(bits) // 2).tobytes() if len(bits) > BITS // 4 else None


def signatures_apart(u: bytes, v: bytes) -> int:
    x, y = np.frombuffer(u, np.uint8), np.frombuffer(v, np.uint8)
    size = min(len(x), len(y))
    return int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum())


def _near_signatures(percent: int):
    def run(batches: Iterator) -> Iterator:
        """Rows (u, v, nu, nv, su, sv): those whose signatures aren't too far apart."""
        import pyarrow as pa

        for batch in batches:
            u, v, nu, nv = (batch.column(c).to_numpy() for c in ("u", "v", "nu", "nv"))
            most = nu + nv - 2 * -(-percent * (nu + nv) // (100 + percent))
            apart = [signatures_apart(x, y) for x, y in zip(batch.column("su").to_pylist(), batch.column("sv").to_pylist())]
            near = np.flatnonzero(np.array(apart, np.int64) <= most)
            yield pa.RecordBatch.from_arrays([pa.array(u[near]), pa.array(v[near])], names=["u", "v"])

    return run


def _prefixes(size: int, percent: int, classes: np.ndarray):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            d, grams, sizes, lengths, marks = [], [], [], [], []
            for s in shingle_sets(batch.column("text"), size):
                d.append(digest(s))
                first, left = prefix(s, classes, percent) if len(s) else (s, np.zeros(0, np.int64))
                grams.append(first.view(np.int64))
                sizes.append(left)
                lengths.append(len(first))
                marks.append(signature(s))
            d = np.array(d, np.int64).reshape(-1, 2)
            ends = pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x) if x else np.zeros(0, np.int64))) for x in (grams, sizes)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy()), *lists, pa.array(marks, pa.binary())], names=["key", "d1", "d2", "grams", "lefts", "signature"])

    return run


def _sets(size: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            sets = list(shingle_sets(batch.column("text"), size))
            d = np.array([digest(s) for s in sets], np.int64).reshape(-1, 2)
            ends = pa.array(np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32))
            flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy()), pa.ListArray.from_arrays(ends, pa.array(flat))], names=["d1", "d2", "grams"])

    return run


def may_link(one: str, two: str, percent: int) -> Column:
    """Length, positional and suffix filter of two rows (n, pos, left) that share an n-gram."""
    x, y = (lambda c, a=a: F.col(f"{a}.{c}") for a in (one, two))
    n = x("n") + y("n")
    need = F.ceil(F.lit(percent) * n / (100 + percent))
    lengths = 100 * F.least(x("n"), y("n")) >= percent * F.greatest(x("n"), y("n"))
    positions = 1 + F.least(x("n") - x("pos") - 1, y("n") - y("pos") - 1) >= need
    cell = lambda c, k: F.shiftright(c, 8 * k).bitwiseAND(255)
    apart = sum((F.abs(cell(x("left"), k) - cell(y("left"), k)) for k in range(1, CELLS)), F.abs(cell(x("left"), 0) - cell(y("left"), 0)))
    return lengths & positions & (x("pos") + y("pos") + apart <= n - 2 * need)


def near_rows(rows: dict[str, np.ndarray], i, j, percent: int) -> np.ndarray:
    """Which of the pairs of rows i and j (arrays, or one row and an array) pass the filters, in different components."""
    n, pos = rows["n"], rows["pos"]
    total = n[i] + n[j]
    most = total - 2 * -(-percent * total // (100 + percent))
    ok = (rows["part"][i] != rows["part"][j]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
    ok &= 2 * np.minimum(n[i] - pos[i], n[j] - pos[j]) >= total - most
    at = np.flatnonzero(ok)
    i, j = (i[at] if isinstance(i, np.ndarray) else i), j[at]
    apart = np.abs(rows["left"][i].astype(np.int16) - rows["left"][j]).sum(axis=-1)
    near = (pos[i] + pos[j] + apart <= most[at]) & (np.bitwise_count(rows["bits"][i] ^ rows["bits"][j]).sum(axis=-1) <= most[at])
    ok[at] = near
    at, i, j = at[near], (i[near] if isinstance(i, np.ndarray) else i), j[near]
    long = rows.get("long", [None] * len(n))
    for k, u, v in zip(at.tolist(), i.tolist() if isinstance(i, np.ndarray) else [i] * len(j), j.tolist()):
        if long[u] is not None and long[v] is not None:
            ok[k] = signatures_apart(long[u], long[v]) <= most[k]
    return ok


def block_pairs(rows: dict[str, np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i, j) of the rows of a block that pass the filters; rows of two chunks meet only across. Rows of the largest
    component are met, but look for nobody."""
    part, chunk = rows["part"], rows["chunk"]
    names, size = np.unique(part, return_counts=True)
    look = np.flatnonzero(part != names[size.argmax()]) if len(names) > 1 else np.zeros(0, np.int64)
    across = chunk.min() != chunk.max()
    place = np.full(len(part), -1)
    place[look] = np.arange(len(look))
    out_i, out_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in look.tolist():
        j = np.flatnonzero((place < place[i]) & (chunk != chunk[i])) if across else np.flatnonzero(place < place[i])
        j = j[near_rows(rows, i, j, percent)]
        out_i.append(np.full(len(j), i))
        out_j.append(j)
    return np.concatenate(out_i), np.concatenate(out_j)


def small_pairs(rows: dict[str, np.ndarray], block: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for all blocks of few rows at once (``block`` is the number of each row's block, -1 for others)."""
    out_i, out_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for step in range(1, FEW):
        i = np.flatnonzero((block[:-step] == block[step:]) & (block[step:] >= 0)) if step < len(block) else np.zeros(0, np.int64)
        if not len(i):
            break
        i = i[near_rows(rows, i, i + step, percent)]
        out_i.append(i)
        out_j.append(i + step)
    return np.concatenate(out_i), np.concatenate(out_j)


def _blocks(percent: int):
    def run(batches: Iterator) -> Iterator:
        """Rows sorted by gram, a, b; a block is all rows of one of these, at most two chunks."""
        import pyarrow as pa

        def pairs(rows: dict, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
            u, v = rows["node"][i], rows["node"][j]
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["u", "v"])

        def all_pairs(rows: dict, cuts: list[int]) -> Iterator[pa.RecordBatch]:
            sizes = np.diff(cuts)
            few = sizes <= FEW
            if few.any():
                block = np.repeat(np.where(few & (sizes > 1), np.arange(len(sizes)), -1), sizes)
                own = {c: x[cuts[0] : cuts[-1]] for c, x in rows.items()}
                yield pairs(own, *small_pairs(own, block, percent))
            for k in np.flatnonzero(~few).tolist():
                own = {c: x[cuts[k] : cuts[k + 1]] for c, x in rows.items()}
                yield pairs(own, *block_pairs(own, percent))

        plain = ("gram", "a", "b", "node", "n", "pos", "part", "chunk", "long")
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in plain}
            rows["left"] = np.ascontiguousarray(batch.column("left").to_numpy(zero_copy_only=False)).view(np.uint8).reshape(-1, CELLS)
            rows["bits"] = np.frombuffer(b"".join(batch.column("bits").to_pylist()), np.uint64).reshape(-1, BITS // 64)
            if held:
                rows = {c: np.concatenate((held[c], rows[c])) for c in rows}
            cut = np.flatnonzero((rows["gram"][1:] != rows["gram"][:-1]) | (rows["a"][1:] != rows["a"][:-1]) | (rows["b"][1:] != rows["b"][:-1])) + 1
            cuts = [0, *cut.tolist()]
            yield from all_pairs(rows, cuts) if len(cuts) > 1 else ()
            held = {c: x[cuts[-1] :] for c, x in rows.items()}
        if held:
            yield from all_pairs(held, [0, len(held["n"])])

    return run


class Join:
    """What the steps of one join share: ``docs(key, text)``, ``classes(node, key, n, d1, d2)``,
    ``signatures(node, n, signature)``."""

    def __init__(self, docs: DataFrame, classes: DataFrame, signatures: DataFrame, size: int, percent: int):
        self.docs, self.classes, self.signatures, self.size, self.percent = docs, classes, signatures, size, percent
        self.parts: DataFrame | None = None
        self.done: DataFrame | None = None

    def verify(self, pairs: DataFrame) -> bool:
        """Joins the components of the links among ``pairs(u, v)`` that weren't verified before; whether there are any."""
        pairs = pairs.distinct()
        if self.done is not None:
            pairs = pairs.join(self.done, ["u", "v"], "left_anti")
        one, two = (self.signatures.select(F.col("node").alias(k), F.col("n").alias(f"n{k}"), F.col("signature").alias(f"s{k}")) for k in "uv")
        marked = pairs.join(one, "u").join(two, "v").select("u", "v", "nu", "nv", "su", "sv")
        pairs = materialize(marked.mapInArrow(_near_signatures(self.percent), "u long, v long"), "candidates")
        self.done = pairs if self.done is None else self.done.unionByName(pairs)
        nodes = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
        known = materialize(self.classes.join(nodes, "node", "left_semi").select("node", "key", "n", "d1", "d2"), "candidate-classes")
        keys = known.select(F.col("key").alias("__k")).distinct()
        keys = F.broadcast(keys) if known.count() <= BROADCAST_KEYS else keys
        texts = self.docs.join(keys, F.col("key").eqNullSafe(F.col("__k")), "left_semi")
        sets = texts.mapInArrow(_sets(self.size), "d1 long, d2 long, grams array<bigint>")
        sets, sets_at = materialize_at(sets.join(known.select("node", "n", "d1", "d2"), ["d1", "d2"]).select("node", "n", "grams").dropDuplicates(["node"]), "candidate-sets")
        one, two = (sets.select(F.col("node").alias(k), F.col("n").alias(f"n{k}"), F.col("grams").alias(f"g{k}")) for k in "uv")
        both = F.size(F.array_intersect("gu", "gv"))
        links = pairs.join(one, "u").join(two, "v").filter(100 * both >= self.percent * (F.col("nu") + F.col("nv") - both)).select("u", "v")
        for k in "uv":
            links = _with_parts(links.withColumnRenamed(k, "node"), self.parts).drop("node", "size").withColumnRenamed("part", k)
        links = materialize(links.filter("u <> v").distinct(), "links")  # of components, one for however many of their classes
        discard(links.sparkSession, sets_at)
        if links.isEmpty():
            return False
        joined = materialize(connected_components(links), "joined").select(F.col("node").alias("part"), F.col("component").alias("now"))
        known = joined.select(F.col("part").alias("node"), "part")
        if self.parts is not None:
            known = self.parts.select("node", F.col("component").alias("part")).unionByName(known.join(self.parts, "node", "left_anti"))
        known = known.join(joined, "part", "left").select("node", F.coalesce("now", "part").alias("component"))
        self.parts = materialize(known.join(known.groupBy("component").agg(F.count("*").alias("size")), "component").select("node", "component", "size"), "parts")
        return True


def _with_parts(rows: DataFrame, parts: DataFrame | None) -> DataFrame:
    """``rows`` with ``part``, the component of their node so far, and its ``size``."""
    if parts is None:
        return rows.withColumns({"part": F.col("node"), "size": F.lit(1).cast("long")})
    return rows.join(parts, "node", "left").withColumns({"part": F.coalesce("component", "node"), "size": F.coalesce("size", F.lit(1))}).drop("component")


def _stars(rows: DataFrame, round_: int, percent: int) -> DataFrame:
    """Candidates (u, v) of each row and the centre of its n-gram and size, which is in another component."""
    cell = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent) + round_ % 2 / 2).cast("int") if percent < 100 else F.lit(0)
    rows = rows.withColumn("cell", cell)
    who = F.struct((-F.col("size")).alias("most"), F.xxhash64("node", F.lit(round_), *(["gram"] if round_ else [])).alias("h"), "node", "part", "n", "pos", "left")
    centres = rows.groupBy("gram", "cell").agg(F.min(who).alias("c"), F.count("*").alias("k")).filter("k > 1").select("gram", "cell", "c.*")
    found = rows.alias("x").join(centres.alias("c"), ["gram", "cell"]).filter(F.col("x.part") != F.col("c.part")).filter(may_link("x", "c", percent))
    return found.select(F.least("x.node", "c.node").alias("u"), F.greatest("x.node", "c.node").alias("v"))


@F.arrow_udf(BinaryType())
def longer_signature(signatures):
    """Signatures of half as many parts, null if these are BITS or fewer."""
    import pyarrow as pa

    return pa.array([half_signature(x) for x in signatures.to_pylist()], pa.binary())


@F.arrow_udf(BinaryType())
def shortest_signature(signatures):
    """Signatures of BITS parts."""
    import pyarrow as pa

    return pa.array([folded(np.frombuffer(x, np.uint8), BITS // 8).tobytes() for x in signatures.to_pylist()], pa.binary())


def _rest(rows: DataFrame, signatures: DataFrame, percent: int) -> DataFrame:
    """Candidates (u, v) of different components, all of them."""
    counts = rows.groupBy("gram", "part").agg(F.count("*").alias("k"))
    mixed = counts.groupBy("gram").agg(F.max(F.struct("k", "part")).alias("most"), F.sum("k").alias("all"), F.count("*").alias("parts")).filter("parts > 1")
    mixed = mixed.select("gram", F.col("most.part").alias("main"), F.when(F.col("all") <= BLOCK, 0).otherwise(F.ceil(F.col("most.k") / BLOCK)).alias("d"), F.when(F.col("all") <= BLOCK, 1).otherwise(F.ceil((F.col("all") - F.col("most.k")) / BLOCK)).alias("m"))
    rows = rows.join(mixed, "gram").join(signatures.select("node", shortest_signature("signature").alias("bits"), longer_signature("signature").alias("long")), "node")
    own = (F.col("part") == F.col("main")) & (F.col("d") > 0)
    h = F.xxhash64("node")
    rows = rows.withColumn("chunk", F.when(own, F.pmod(h, F.greatest("d", F.lit(1)))).otherwise(F.col("d") + F.pmod(h, F.col("m"))))
    rows = rows.withColumn("other", F.explode(F.sequence(F.when(own, F.col("d")).otherwise(0), F.col("d") + F.col("m") - 1)))
    rows = rows.select("gram", F.least("chunk", "other").alias("a"), F.greatest("chunk", "other").alias("b"), "node", "n", "pos", "left", "bits", "long", "part", "chunk")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "gram", "a", "b").sortWithinPartitions("gram", "a", "b").mapInArrow(_blocks(percent), "u long, v long")


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT, stars: int = STARS) -> DataFrame:
    """``key, n_shingles, component_id`` for every row of ``docs``: the size of its set of ``size``-word shingles (words cut at
    ASCII white space, A-Z lower-cased), and the smallest key that is reachable by links of at least ``percent``
    percent Jaccard similarity, itself included.

    Fewer words than ``size`` make one shingle; null, empty and blank texts have an empty set, are linked with nothing and keep
    their own key. Very long texts are sets like any other. Equal sets are linked whatever their keys; a row is
    linked by its set, so equal keys at different texts are told apart. Rows with a null key are linked and have the smallest key
    of others as component, null if there is none. An empty table gives an empty table; other columns don't matter. Sets are
    compared by 64-bit hashes of shingles."""
    if not 0 < percent <= 100 or size < 1:
        raise ValueError("percent is from 1 to 100, and size at least 1")
    spark = docs.sparkSession
    given = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text"))
    kind = given.schema["key"].dataType.simpleString()
    seen = materialize(given.mapInArrow(_counter(size), f"key {kind}, n long, d1 long, d2 long, slot long, docs long"), "sets")
    rows = seen.filter("slot is null").select("key", "n", "d1", "d2")
    classes = rows.filter("n > 0").groupBy("d1", "d2").agg(F.min("key").alias("key"), F.first("n").alias("n"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    counts = np.zeros(SLOTS, np.int64)
    for slot, n in seen.filter("slot is not null").groupBy("slot").agg(F.sum("docs")).collect():  # SLOTS rows at most
        counts[slot] = n

    # a row for each n-gram of a class's prefix that stands in another class's prefix too
    made = given.mapInArrow(_prefixes(size, percent, frequency(counts)), f"key {kind}, d1 long, d2 long, grams array<bigint>, lefts array<bigint>, signature binary")
    own = made.alias("m").join(classes.alias("c"), (F.col("m.d1") == F.col("c.d1")) & (F.col("m.d2") == F.col("c.d2")) & F.col("m.key").eqNullSafe(F.col("c.key")))
    own, own_at = materialize_at(own.select("c.node", "c.n", "m.grams", "m.lefts", "m.signature"), "prefixes")
    signatures = materialize(own.select("node", "n", "signature").dropDuplicates(["node"]), "signatures")
    each = own.select("node", "n", F.posexplode(F.arrays_zip("grams", "lefts")).alias("pos", "x")).select("node", "n", F.col("pos").cast("long").alias("pos"), F.col("x.grams").alias("gram"), F.col("x.lefts").alias("left"))
    shared = own.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("k")).filter("k > 1").select("gram")
    each = materialize(each.join(shared, "gram"), "shared-prefixes")
    discard(spark, own_at)

    join = Join(given, classes, signatures, size, percent)
    for k in range(stars):
        if not join.verify(_stars(_with_parts(each, join.parts), k, percent)):
            break
    join.verify(_rest(_with_parts(each, join.parts), signatures, percent))
    named = _with_parts(classes, join.parts)
    least = named.groupBy("part").agg(F.min("key").alias("component_id"))
    owner = named.join(least, "part").select("d1", "d2", "component_id")
    return rows.join(owner, ["d1", "d2"], "left").select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component_id", "key").alias("component_id"))


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir).select("doc_id", "text"))


OP11_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x09-\x0D\x20]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS g FROM d),
n AS (SELECT doc_id, CAST(len(g) AS BIGINT) AS n FROM s),
e AS MATERIALIZED (SELECT doc_id, unnest(g) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 90 * (x.n + y.n - o)),
r AS (SELECT doc_id, doc_id AS c FROM n UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id)
SELECT n.doc_id, n.n AS n_shingles, min(r.c) AS component_id FROM n JOIN r USING (doc_id) GROUP BY ALL"""
