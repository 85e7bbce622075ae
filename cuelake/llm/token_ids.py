"""Token ids of documents in Huffman-coded files.

Texts are range-sorted by document id, tokenized once, and coded with a canonical length-limited Huffman code made
from the counts of all ids. The files are Parquet tables of independent blocks (documents in ascending id order,
numbers of ids, bits, bit offsets) beside a table of code lengths; any block can be decoded alone, and a document
from the checkpoint before it.

Texts are cut where one space stands between two characters that aren't white space. The byte-level vocabulary never
joins bytes across such a place, so the library encodes each different piece once and recent pieces are remembered;
the ids are those of the whole text. Pieces of plain words and marks go to the library's merges without its regex, if the
vocabulary shows that they can't differ.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, materialize, scratch
from .huffman import Code, code_lengths

VOCABULARY = "byte_bpe_50k.json"
END = 2
#: Ids of a block.
BLOCK = 1 << 18
#: Pieces that a worker remembers, and bytes of them; a longer piece than LONGEST isn't remembered.
REMEMBERED, REMEMBERED_BYTES, LONGEST = 1_200_000, 64 << 20, 1 << 10
#: Pieces that are encoded as one text.
TOGETHER = 2_000
#: Bytes of texts that are encoded at a time, unless one text has more.
PART_BYTES = 16 << 20
_CUT = re.compile(r"(?<=\S) (?=\S)")
_LETTERS, _MARKS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff", r"!-&(-/:-@\[-`{-~"
#: Words of Latin letters, with marks after them (no apostrophe), on a line each.
_SIMPLE = re.compile(f"[{_LETTERS}]+[{_MARKS}]*(?:\n[{_LETTERS}]+[{_MARKS}]*)*")
#: A token, as Latin-1, that a merge could make across the places where the regex of the vocabulary cuts simple pieces.
_ACROSS = re.compile(f"(?s:(?:[A-Za-z]|(?:^|\xc3)[\x80-\xbf])[{_MARKS}\n ]|[{_MARKS}][\n ]|\n[A-Za-z\xc3])")


def _shown_bytes() -> list[str]:
    """The character by which a byte-level vocabulary shows each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return [chr(b) if b in set(plain) else chr(256 + other.index(b)) for b in range(256)]


def _merges_alone(path: str, shown: list[str]) -> bool:
    """Whether simple pieces have the ids that merges alone give: the regex only cuts them where no merge can join, and
    no added token can stand in them."""
    with open(path, encoding="utf-8") as f:
        given = json.load(f)
    model, before = given["model"], given["pre_tokenizer"] or {}
    plain = not (given["normalizer"] or given["post_processor"] or given["truncation"] or given["padding"])
    plain = plain and model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    plain = plain and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)
    foreign = re.compile(f"[^{_LETTERS}{_MARKS}\n ]|[{_MARKS}][{_LETTERS}]")
    if not plain or not all(foreign.search(t["content"]) for t in given["added_tokens"]):
        return False
    number = {c: b for b, c in enumerate(shown)}
    merged = ("".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"])
    return not any(_ACROSS.search(bytes(map(number.__getitem__, m)).decode("latin-1")) for m in merged)


class Encoder:
    """Ids of texts as bytes of unsigned 16-bit little-endian numbers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import numpy as np
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.begins = np.zeros(1 << 16, bool)  # tokens whose first byte is a space
        for token, number in self.library.get_vocab().items():
            self.begins[number] = token.startswith("\u0120")
        shown = _shown_bytes()
        self.shown = np.array([ord(c) for c in shown], "<u2")
        self.merges = Tokenizer(self.library.model) if _merges_alone(path, shown) else None  # no regex, no added tokens
        self._forget()

    def _forget(self) -> None:
        import numpy as np

        self.pieces: dict[str, int] = {}  # with a space before, to their places in:
        self.starts, self.sizes = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.ids, self.used, self.places = np.zeros(1 << 14, np.uint16), 0, 0
        self.size = 0  # bytes of the pieces

    def _plain(self, texts: list[str]) -> list:
        import numpy as np

        return [np.array(e.ids, np.uint16) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _remember(self, pieces: list[str], ids, sizes) -> None:
        import numpy as np

        n, more = self.places, len(pieces)
        while n + more > len(self.starts):
            self.starts, self.sizes = np.concatenate([self.starts, self.starts]), np.concatenate([self.sizes, self.sizes])
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, self.ids])
        self.ids[self.used : self.used + len(ids)] = ids
        self.sizes[n : n + more] = sizes
        self.starts[n : n + more] = self.used + np.cumsum(sizes) - sizes
        self.used += len(ids)
        self.places += more
        self.pieces.update(zip(pieces, range(n, n + more)))
        self.size += sum(map(len, pieces))

    def _known(self, pieces: list[str]) -> tuple:
        """Places of pieces, below 0 for new ones, and these: simple ones, others."""
        import numpy as np

        places = np.fromiter(map(self.pieces.get, pieces, repeat(-1)), np.int64, len(pieces))
        simple, other = [], []
        for k in np.flatnonzero(places < 0).tolist():
            (simple if self.merges is not None and _SIMPLE.fullmatch(pieces[k]) else other).append(pieces[k])
        return places, (simple, other)

    def _new_pieces(self, simple: list[str], other: list[str]) -> None:
        """Encode new pieces, each with the space before it. Many are one text: a token with a space first begins a
        piece, unless a piece has a space of its own."""
        import numpy as np

        spaced = [p for p in other if " " in p]
        other = [p for p in other if " " not in p]
        for group, library in ((simple, self.merges), (other, self.library)):
            for k in range(0, len(group), TOGETHER):
                part = group[k : k + TOGETHER]
                text = f" {' '.join(part)}"
                if library is self.merges:
                    text = self.shown[np.frombuffer(text.encode(), np.uint8)].tobytes().decode("utf-16-le")
                ids = np.array(library.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint16)
                at = np.flatnonzero(self.begins[ids])
                if len(at) == len(part):
                    self._remember(part, ids, np.diff(at, append=len(ids)))
                else:
                    spaced += part
        for k in range(0, len(spaced), TOGETHER):
            part = self._plain([f" {p}" for p in spaced[k : k + TOGETHER]])
            self._remember(spaced[k : k + TOGETHER], np.concatenate(part), np.array([len(x) for x in part]))

    def _different(self, cut) -> tuple:
        """The different pieces of texts (an Arrow list array), without the first of each text, and all by their numbers."""
        import numpy as np
        import pyarrow as pa

        rest = np.ones(len(cut.values), bool)
        rest[cut.offsets.to_numpy()[:-1]] = False
        coded = cut.values.filter(pa.array(rest)).dictionary_encode()
        return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()  # to_pylist is ten times slower

    def encoded(self, texts, end: int):
        """Arrow texts to Arrow binaries."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        if self.places > REMEMBERED or max(self.size, 2 * self.used) > REMEMBERED_BYTES:
            self._forget()
        texts = pc.fill_null(texts, "")
        cut = pc.split_pattern(texts, " ")
        different, codes = self._different(cut)
        places, new = self._known(different)
        # a piece that is empty or has white space at its end or begin shows more than one space in a row
        odd = {p for p in new[1] if not p or p[0].isspace() or p[-1].isspace()}
        firsts = cut.values.take(cut.offsets[:-1]).to_pylist()
        if odd or any(x[-1:].isspace() for x in firsts):
            again = [x[-1:].isspace() or (bool(odd) and not odd.isdisjoint(c[1:])) for x, c in zip(firsts, cut.to_pylist())]
            cut = pa.array([_CUT.split(t) if a else t.split(" ") for t, a in zip(texts.to_pylist(), again)], pa.list_(pa.string()))
            different, codes = self._different(cut)
            places, new = self._known(different)
            firsts = cut.values.take(cut.offsets[:-1]).to_pylist()
        self._new_pieces(*new)
        missing = np.flatnonzero(places < 0).tolist()
        places[missing] = [self.pieces[different[k]] for k in missing]
        # pieces of the texts with their places: the first of each, others, the end id
        own = self._plain(firsts)
        bounds = cut.offsets.to_numpy().astype(np.int64)
        n = len(firsts)
        first_at, end_at = bounds[:-1] + np.arange(n), bounds[1:] + np.arange(n)
        starts, sizes = np.zeros(int(bounds[-1]) + n, np.int64), np.zeros(int(bounds[-1]) + n, np.int64)
        rest = np.ones(len(starts), bool)
        rest[first_at] = rest[end_at] = False
        starts[rest], sizes[rest] = self.starts[places][codes], self.sizes[places][codes]
        extra = np.concatenate([np.array([end], np.uint16), *own])
        sizes[first_at], sizes[end_at] = [len(x) for x in own], 1
        starts[first_at], starts[end_at] = self.used + 1 + np.cumsum(sizes[first_at]) - sizes[first_at], self.used
        source = np.concatenate([self.ids[: self.used], extra])
        ends = np.cumsum(sizes)
        ids = source[np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if n else 0)].astype("<u2", copy=False)
        offsets = np.concatenate([[0], 2 * ends[end_at]])
        if offsets[-1] >= 1 << 31:
            raise ValueError("ids of one batch are 2 GB or more")
        for p in chain(*new):
            if len(p) > LONGEST:
                self.size -= len(p)
                del self.pieces[p]
        return pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(ids)])

    def encode(self, texts: list[str], end: int) -> list[bytes]:
        import pyarrow as pa

        return self.encoded(pa.array(texts, pa.string()), end).to_pylist()


#: Encoders stay for the next task of a worker.
_ENCODERS: dict[str, Encoder] = {}


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _parts(batch) -> Iterator:
    """A batch in parts of at most 1,000 rows and ``PART_BYTES`` of text, or one row."""
    if batch.num_rows > 1 and (batch.num_rows > 1000 or batch.column(1).nbytes > PART_BYTES):
        half = batch.num_rows // 2
        yield from _parts(batch.slice(0, half))
        yield from _parts(batch.slice(half))
    elif batch.num_rows:
        yield batch


def _tokenize(path: str, end: int):
    def run(batches: Iterator) -> Iterator:
        """(key, ids, counts): a row for each document, and a last one with the counts of all ids of the task."""
        import numpy as np
        import pyarrow as pa

        if path not in _ENCODERS:
            _ENCODERS[path] = Encoder(path)
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for part in _parts(batch):
                ids = _ENCODERS[path].encoded(part.column(1), end)
                total += np.bincount(np.frombuffer(ids.buffers()[2], "<u2"), minlength=1 << 16)
                yield pa.RecordBatch.from_arrays([part.column(0), ids, pa.nulls(len(ids), pa.list_(pa.int64()))], names=["key", "ids", "counts"])
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([None], pa.binary()), pa.array([total.tolist()], pa.list_(pa.int64()))], names=["key", "ids", "counts"])

    return run


def _add_counts(batches: Iterator) -> Iterator:
    """Counts of several tasks to (id, n) of those that are there."""
    import numpy as np
    import pyarrow as pa

    total = np.zeros(1 << 16, np.int64)
    for batch in batches:
        for counts in batch.column(0):
            total += counts.values.to_numpy()
    found = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], names=["id", "n"])


_BLOCKS = "first long, keys array<long>, sizes array<int>, bits binary, checkpoints array<long>"


def _write_blocks(code):
    def run(batches: Iterator) -> Iterator:
        """Rows (at, key, ids). A block ends where the numbers ``at`` don't go on: a task may read parts of files."""
        import numpy as np
        import pyarrow as pa

        keys, ids, size, first, due = [], [], 0, None, None

        def coded():
            bits, starts = code.value.encode(np.frombuffer(b"".join(ids), "<u2").astype(np.int64))
            longs = pa.list_(pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), pa.array([keys], longs), pa.array([[len(x) // 2 for x in ids]], pa.list_(pa.int32())), pa.array([bits], pa.binary()), pa.array([starts], longs)], names=["first", "keys", "sizes", "bits", "checkpoints"])

        for batch in batches:
            for at, key, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if keys and (at != due or size >= BLOCK):
                    yield coded()
                    keys, ids, size = [], [], 0
                own = own.as_py()
                first, due = at if not keys else first, at + 1
                keys.append(key)
                ids.append(own)
                size += len(own) // 2
        if keys:
            yield coded()

    return run


def _read_blocks(code, digest: bool):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                sizes = np.array(row["sizes"], np.int64)
                ids = code.value.decode(row["bits"], row["checkpoints"], int(sizes.sum())).astype("<u4")
                ends = np.cumsum(sizes)
                each = [ids[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist())]
                last = pa.array([zlib.crc32(x.tobytes()) for x in each], pa.int64()) if digest else pa.array([x.astype(np.int32) for x in each], pa.list_(pa.int32()))
                n = len(each)
                yield pa.RecordBatch.from_arrays([pa.array([row["first"]] * n, pa.int64()), pa.array(row["keys"], pa.int64()), pa.array(ends - sizes), pa.array(sizes), last], names=["first", "key", "before", "n_tokens", "ids"])

    return run


def write_token_ids(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, end: int = END) -> None:
    """Tokenize ``text`` of all rows, append ``end`` to each, and write ``{path}/blocks`` and ``{path}/lengths``.

    The key is an integer; rows stand in ascending key order, null first, rows with the same key by their text. Null
    and empty texts have the end id alone. The vocabulary (a file that every executor can read, at most 65,536
    ids) is given by path. An empty table gives files without blocks; other columns don't matter."""
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    given = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    ordered = given.repartitionByRange(parts, "key").sortWithinPartitions("key", "text")
    # numbers in ascending order: they keep the rows' places when the table is read again
    numbered = ordered.mapInArrow(_tokenize(vocabulary or vocabulary_path(), end), "key long, ids binary, counts array<long>").withColumn("at", F.monotonically_increasing_id())
    tokens = materialize(numbered, "tokens")
    each = tokens.filter("counts is not null").select("counts").mapInArrow(_add_counts, "id int, n long")
    counts = {r[0]: r[1] for r in each.groupBy("id").agg(F.sum("n")).collect()}  # the vocabulary's size at most
    lengths = code_lengths(counts)
    spark.createDataFrame(sorted(lengths.items()), "id int, bits int").write.parquet(f"{path}/lengths")
    code = spark.sparkContext.broadcast(Code(lengths))
    tokens.filter("ids is not null").select("at", "key", "ids").mapInArrow(_write_blocks(code), _BLOCKS).write.option("compression", "uncompressed").parquet(f"{path}/blocks")


def read_token_ids(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """``key, start, n_tokens, ids`` of every document; with ``digest`` the CRC-32 of the ids instead (as
    little-endian unsigned 32-bit numbers)."""
    lengths = {r[0]: r[1] for r in spark.read.schema("id int, bits int").parquet(f"{path}/lengths").collect()}  # the vocabulary's size at most
    code = spark.sparkContext.broadcast(Code(lengths))
    blocks = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")
    part = F.shiftrightunsigned("first", 33).alias("part")
    sizes = blocks.select(part, "first", F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n")).select("part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base"))
    within = Window.partitionBy("part").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", "first", F.coalesce(F.sum("n").over(within), F.lit(0)).alias("earlier")).join(parts, "part").select("first", (F.col("base") + F.col("earlier")).alias("start"))
    each = blocks.mapInArrow(_read_blocks(code, digest), f"first long, key long, before long, n_tokens long, ids {'long' if digest else 'array<int>'}")
    return each.join(starts, "first").select("key", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids")


def op4_huffman_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-ids")
    write_token_ids(documents(spark, sf_dir), path)
    return read_token_ids(spark, path, digest=True).select(F.col("key").alias("doc_id"), "start", "n_tokens", F.col("ids").alias("ids_crc32"))
