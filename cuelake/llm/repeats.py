"""Removal of long repeated strings: every byte covered by a string of ``length`` bytes that also starts elsewhere.

No suffix array is built: external induced sorting holds a tuple for every byte of the corpus on disk, which the
disk budget doesn't allow (figures in the README). Instead content decides what is compared with what. Of all
``GRAM``-byte grams that start in a window of ``length`` bytes the one with the least hash is the window's anchor (the
leftmost of equal ones), so equal windows have equal anchors at equal offsets. Consecutive windows with one anchor make
a block (some 80 windows), and only blocks are shuffled and grouped, by Spark's sorts and joins that spill to disk:

1. An anchor gram that stands once in the corpus: no window of its blocks is repeated. Most blocks end here.
2. A block whose bytes stand twice: all its windows are repeated. Copies of whole passages end here.
3. Blocks with a shared gram but different bytes (the ends of a passage, places where near copies differ): the
   windows of one representative of each different block are compared, by gram.

Grams that stand very often are taken out before anything is shuffled by gram and are counted by aggregates. Blocks
are told apart by 128 bits of hash (gram and bytes), windows by 128 bits, too; rows by a written number.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, documents, materialize, materialize_at

LENGTH = 200
GRAM = 32
#: A gram that stands more often is counted by aggregates over many tasks, all others each in one task.
HOT = 100_000
#: Hot grams at most, as they are broadcast: in a large corpus a gram is hot if it has more than this part of all blocks.
HOT_GRAMS = 1_000_000
#: Tasks that the copies of a block of a hot gram are dealt over.
SALTS = 64
#: Window starts looked at at once.
PIECE = 1 << 20
_PLACE = (1 << 24) - 1


def _powers(n: int, seed: int = 7):
    """Powers of an odd base modulo 2**64 and of its inverse, and a number for each byte."""
    import numpy as np

    base = int(np.random.default_rng(seed + 100).integers(1 << 62, 1 << 63)) | 1
    up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    table = np.random.default_rng(seed).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return np.multiply.accumulate(up), np.multiply.accumulate(down), table


def blocks(text: bytes, length: int, gram: int, powers):
    """(first window, windows, anchor's offset in the first window, anchor's hash) as arrays, for all windows of the
    text. ``text`` has at most PIECE windows."""
    import numpy as np

    up, down, table = powers
    n = len(text)
    value = table[np.frombuffer(text, np.uint8)] * up[:n]
    run = np.zeros(n + 1, np.uint64)
    np.cumsum(value, out=run[1:])
    h = (run[gram:] - run[:-gram]) * down[: n - gram + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    least = (h & np.uint64(~_PLACE & (1 << 64) - 1)) | np.arange(len(h), dtype=np.uint64)
    width, have = length - gram + 1, 1
    while 2 * have <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if width > have:
        least = np.minimum(least[: len(least) - (width - have)], least[width - have :])
    anchor = (least & np.uint64(_PLACE)).astype(np.int64)
    first = np.flatnonzero(np.diff(anchor, prepend=-1))
    return first, np.diff(np.append(first, len(anchor))), anchor[first] - first, h[anchor[first]].view(np.int64)


def _pieces(text: bytes, length: int, piece: int) -> Iterator[tuple[int, bytes]]:
    for k in range(0, len(text) - length + 1, piece):
        yield k, text[k : k + piece + length - 1]


def _number(data: bytes) -> int:
    return int.from_bytes(blake2b(data, digest_size=8).digest(), "little", signed=True)


def _blocks_of(length: int, gram: int, most: int):
    """most: windows of a piece."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        powers = _powers(most + length)
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                for at, piece in _pieces(text, length, most):
                    first, windows, offset, grams = blocks(piece, length, gram, powers)
                    same = [_number(piece[f : f + w + length - 1] + o.to_bytes(2, "little")) for f, w, o in zip(first.tolist(), windows.tolist(), offset.tolist())]
                    # place, number of windows and anchor's offset in one number: 40, 12 and 12 bits
                    where = ((first + at) << 24) | (windows << 12) | offset
                    for k in range(0, len(first), 1 << 16):
                        e = k + (1 << 16)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first[k:e]), row, np.int64)), pa.array(where[k:e]), pa.array(grams[k:e]), pa.array(same[k:e], pa.int64())], names=["row", "place", "gram", "same"])

    return run


def _contexts_of(length: int):
    """Rows (packed text, [(row, place, gram, same, times)]) to a row for each block, with its bytes."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        schema = pa.schema([("row", pa.int64()), ("place", pa.int64()), ("gram", pa.int64()), ("same", pa.int64()), ("times", pa.int64()), ("body", pa.binary())])
        for batch in batches:
            out, size = [], 0
            for packed, wanted in zip(batch.column(0), batch.column(1)):
                text = unpack.decompress(packed.as_py())
                for b in wanted.as_py():
                    at, n = b["place"] >> 24, b["place"] >> 12 & 0xFFF
                    out.append({**b, "body": text[at : at + n + length - 1]})
                    size += n + length
                if size > 8 << 20:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def shared_windows(texts: list[bytes], grams, offsets, times, length: int, powers) -> list[list[int]]:
    """For each block the numbers of its windows that stand in another block of the same gram, at the same offset of
    the anchor, or in a block that stands ``times`` > 1. Compared by 128 bits."""
    import numpy as np

    size = np.array([len(t) for t in texts], np.int64)
    body = np.frombuffer(b"".join(texts), np.uint8)
    count = size - length + 1
    block = np.repeat(np.arange(len(texts)), count)
    i = np.arange(len(block)) - np.repeat(np.cumsum(count) - count, count)
    at = np.repeat(np.cumsum(size) - size, count) + i
    keys = []
    for up, down, table in powers:
        run = np.zeros(len(body) + 1, np.uint64)
        np.cumsum(table[body] * up[: len(body)], out=run[1:])
        h = (run[at + length] - run[at]) * down[at]
        h ^= grams[block].view(np.uint64) * np.uint64(0x9FB21C651E98DF25) + (offsets[block] - i).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        keys.append(h)
    order = np.lexsort((keys[1], keys[0]))
    a, b = keys[0][order], keys[1][order]
    first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
    sums = np.add.reduceat(times[block][order], first)
    found = np.zeros(len(block), bool)
    found[order] = np.repeat(sums > 1, np.diff(np.append(first, len(block))))
    edges = np.concatenate(([0], np.cumsum(count)))
    return [i[x:y][found[x:y]].tolist() for x, y in zip(edges[:-1].tolist(), edges[1:].tolist())]


def _shared_windows(length: int, flush: int = 2 << 20):
    """Blocks sorted by gram to (row, place, windows)."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        powers, most = [], 0

        def done(rows):
            nonlocal powers, most
            size = sum(len(r["body"]) for r in rows)
            if size > most:
                most = max(size, 2 * flush)
                powers = [_powers(most, seed) for seed in (11, 12)]
            number = lambda c: np.array([r[c] for r in rows], np.int64)
            found = shared_windows([r["body"] for r in rows], number("gram"), number("place") & 0xFFF, number("times"), length, powers)
            out = [{"row": r["row"], "place": r["place"], "windows": w} for r, w in zip(rows, found) if w and r["times"] == 1]
            return pa.RecordBatch.from_pylist(out, schema=pa.schema([("row", pa.int64()), ("place", pa.int64()), ("windows", pa.list_(pa.int32()))]))

        rows, size = [], 0
        for batch in batches:
            for r in batch.to_pylist():
                if size >= flush and r["gram"] != rows[-1]["gram"]:
                    yield done(rows)
                    rows, size = [], 0
                rows.append(r)
                size += len(r["body"])
        if rows:
            yield done(rows)

    return run


def _window_rows(length: int):
    """Blocks to a row for each window."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for r in batch.to_pylist():
                n, offset = r["place"] >> 12 & 0xFFF, r["place"] & 0xFFF
                windows = [_number(r["body"][i : i + length] + (offset - i).to_bytes(2, "little")) for i in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array([r["gram"]] * n, pa.int64()), pa.array(windows, pa.int64()), pa.array([r["same"]] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array([r["times"]] * n, pa.int64())], names=["gram", "window", "same", "i", "times"])

    return run


def _packed(batches: Iterator) -> Iterator:
    """The texts, compressed for the shuffle."""
    import pyarrow as pa
    import zstandard

    pack = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        names = batch.schema.names
        body = pa.array([pack.compress(t.as_py()) for t in batch.column(names.index("__body"))], pa.binary())
        yield pa.RecordBatch.from_arrays([body if n == "__body" else batch.column(i) for i, n in enumerate(names)], names=names)


def _cut(length: int, texts: bool):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            names = batch.schema.names
            out = [[], [], [], []]
            for packed, found in zip(batch.column(names.index("__body")), batch.column(names.index("spans"))):
                text = unpack.decompress(packed.as_py())
                spans = []
                for b in found.as_py() or ():
                    at = b["place"] >> 24
                    if b["windows"] is None:
                        spans.append((at, at + (b["place"] >> 12 & 0xFFF) - 1 + length))
                    else:
                        spans += [(at + i, at + i + length) for i in b["windows"]]
                merged, kept, end = 0, [], 0
                for a, z in sorted(spans):
                    if a > end or not merged:
                        merged += 1
                        kept.append(text[end:a])
                    end = max(end, z)
                kept = b"".join([*kept, text[end:]])
                for x, v in zip(out, (len(text), len(text) - len(kept), merged, kept if texts else sha256(kept).hexdigest())):
                    x.append(v)
            rest = [n for n in names if n not in ("__body", "spans")]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary() if texts else pa.string())
            yield pa.RecordBatch.from_arrays([*[batch.column(names.index(n)) for n in rest], *[pa.array(x, k) for x, k in zip(out, kinds)]], names=[*rest, "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def _packed_texts(rows: DataFrame, length: int) -> DataFrame:
    return rows.filter(F.octet_length("body") >= length).select("row", F.col("body").alias("__body")).mapInArrow(_packed, "row long, __body binary")


def _contexts(rows: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The blocks ``wanted(row, place, gram, same, times)`` with their bytes."""
    lists = wanted.groupBy("row").agg(F.collect_list(F.struct("row", "place", "gram", "same", "times")).alias("wanted"))
    return _packed_texts(rows, length).join(lists, "row").select("__body", "wanted").mapInArrow(_contexts_of(length), "row long, place long, gram long, same long, times long, body binary")


def _hot_blocks(rows: DataFrame, blocks_: DataFrame, length: int) -> DataFrame:
    """As :func:`repeated_blocks`, for grams that stand too often for one task: everything is counted by aggregates
    that combine before the shuffle, and each window is a row of its own."""
    kinds = materialize(blocks_.groupBy("gram", "same").agg(F.count("*").alias("times"), F.min(F.struct("row", "place")).alias("one")), "hot-kinds")
    several = kinds.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1").select("gram")
    wanted = kinds.join(several, "gram", "left_semi").select("one.row", "one.place", "gram", "same", "times")
    windows = materialize(_contexts(rows, wanted, length).mapInArrow(_window_rows(length), "gram long, window long, same long, i long, times long").distinct(), "hot-windows")
    twice = windows.groupBy("gram", "window").agg(F.sum("times").alias("n")).filter("n > 1").select("gram", "window")
    partly = windows.join(twice, ["gram", "window"]).groupBy("gram", "same").agg(F.collect_list(F.col("i").cast("int")).alias("windows"))
    verdict = kinds.select("gram", "same", "times").join(partly, ["gram", "same"], "left").filter("times > 1 or windows is not null")
    verdict = verdict.select("gram", "same", F.when(F.col("times") == 1, F.col("windows")).alias("windows"))
    # one block may be most of a hot gram's: its copies are dealt over salts
    verdict = verdict.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return blocks_.withColumn("salt", F.pmod(F.xxhash64("row", "place"), F.lit(SALTS)).cast("int")).join(verdict, ["gram", "same", "salt"]).select("row", "place", "windows")


def repeated_blocks(rows: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """``row, place, windows`` of the blocks of ``rows(row, body)`` with repeated windows; ``windows`` are the
    numbers of those that are, null for all."""
    spark = rows.sparkSession
    every, at = materialize_at(rows.filter(F.octet_length("body") >= length).mapInArrow(_blocks_of(length, gram, PIECE), "row long, place long, gram long, same long"), "blocks")
    shared = materialize(every.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1"), "shared-grams")
    hot = max(hot, every.count() // HOT_GRAMS)
    often = F.broadcast(shared.filter(F.col("n") > hot).select("gram"))  # HOT_GRAMS at most
    of_gram, of_kind = Window.partitionBy("gram"), Window.partitionBy("gram", "same")
    # the windows use the partitions that the join has made
    common = every.join(often, "gram", "left_anti").join(shared.filter(F.col("n") <= hot).select("gram"), "gram").select(
        "row", "place", "gram", "same",
        F.count("*").over(of_kind).alias("times"),
        F.row_number().over(of_kind.orderBy("row", "place")).alias("nth"),
        (F.min("same").over(of_gram) != F.max("same").over(of_gram)).alias("mixed"),
    )
    common = materialize(common.filter("times > 1 or mixed"), "shared-blocks")
    hot_ones = None if shared.filter(F.col("n") > hot).isEmpty() else materialize(every.join(often, "gram"), "hot-blocks")
    discard(spark, at)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    contexts = _contexts(rows, common.filter("mixed and nth = 1").select("row", "place", "gram", "same", "times"), length)
    partly = contexts.repartition(parts, "gram").sortWithinPartitions("gram").mapInArrow(_shared_windows(length), "row long, place long, windows array<int>")
    found = common.filter("times > 1").select("row", "place", F.lit(None).cast("array<int>").alias("windows")).unionByName(partly)
    return found if hot_ones is None else found.unionByName(_hot_blocks(rows, hot_ones, length))


def remove_repeats(docs: DataFrame, keep: list[str], text: str = "text", length: int = LENGTH, gram: int = GRAM, texts: bool = True) -> DataFrame:
    """The columns ``keep`` of every row with n_bytes, n_removed, n_spans and ``kept``: the bytes that are left, or
    with ``texts=False`` their SHA-256 in hex.

    Matches never cross documents. Null texts are empty; texts shorter than ``length`` bytes lose nothing; very long
    texts are looked at in pieces that overlap, so nothing is missed between them; a row that is there twice is all
    repeated (if long enough); an empty table gives an empty table; other columns don't matter. ``kept`` is binary, as a cut may fall within a character."""
    if not 0 < length - gram + 1 < 1 << 12:
        raise ValueError("a block's windows and the offset of its anchor are 12-bit numbers")
    body = F.coalesce(F.col(text).cast("binary"), F.lit("").cast("binary"))
    rows = materialize(docs.select(*keep, body.alias("__body"), F.monotonically_increasing_id().alias("__row")), "numbered-texts")
    found = repeated_blocks(rows.select(F.col("__row").alias("row"), F.col("__body").alias("body")), length, gram)
    spans = found.groupBy("row").agg(F.collect_list(F.struct("place", "windows")).alias("spans")).withColumnRenamed("row", "__row")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    packed = rows.mapInArrow(_packed, f"{kinds}, __body binary, __row long")
    out = packed.join(spans, "__row", "left").drop("__row")
    return out.mapInArrow(_cut(length, texts), f"{kinds}, n_bytes long, n_removed long, n_spans long, kept {'binary' if texts else 'string'}")


def op7_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir), ["doc_id"], texts=False).withColumnRenamed("kept", "kept_sha256")
