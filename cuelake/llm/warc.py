"""WARC archives: records from a table, and a salvage reader for damaged archives.

Writing: a record is text (a version line, header lines, the block), made from built-in functions and written by
Spark's own text sink, so a lost task is run again and nothing half-written is left. Payloads that are equal are
written once; the others are revisit records that name the first.

Reading: an archive (plain, or gzip with one or more records in a member) is read whole, so archives are kept small:
records of like size share one, and it has about ``ARCHIVE`` bytes. A record that fails a check (version line, header lines,
length, its end, its block's or payload's digest) isn't believed: the reader searches for the next valid gzip member or
version line, goes on from there, and reports the bytes in between as a quarantined gap. Of a damaged gzip member the
records that can still be unpacked whole are kept. The work grows with the archive's length alone.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from hashlib import sha256

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialize, scratch

#: Payloads of fewer bytes are never revisits.
LEAST = 100
#: Bytes of an archive at most; records of an eighth of it or more are archives of their own.
ARCHIVE = 32 << 20
#: Bytes below which records share archives; those of each next class are up to eight times as long.
SMALL = 64 << 10
#: Digests of repeated payloads that are broadcast at most (about 100 bytes each).
BROADCAST_PAYLOADS = 200_000
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_MEMBER = b"\x1f\x8b\x08"


def revisits(pages: DataFrame, key: str = "page_id", payload: str = "html") -> DataFrame:
    """``pages`` with payload_bytes, payload_digest, record_type and refers_to.

    Of equal payloads of at least ``LEAST`` bytes the row with the smallest key is the response; if several rows have that
    key, all of them are. A null payload is empty. A row without a key is a response only if no row with a key has its
    payload."""
    p = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.withColumns({"payload_bytes": F.octet_length(p).cast("long"), "payload_digest": F.sha2(p.cast("binary"), 256)})
    first = rows.filter(F.col("payload_bytes") >= LEAST).groupBy("payload_digest").agg(F.min(key).alias("__first"), F.count("*").alias("n"))
    first = materialize(first.filter("n > 1").drop("n"), "repeated-payloads")
    if first.count() <= BROADCAST_PAYLOADS:  # then the payloads themselves aren't shuffled
        first = F.broadcast(first)
    rows = rows.join(first, "payload_digest", "left")
    again = F.col("__first").isNotNull() & ~F.col("__first").eqNullSafe(F.col(key))
    return rows.withColumns({"record_type": F.when(again, "revisit").otherwise("response"), "refers_to": F.when(again, F.col("__first"))}).drop("__first")


def record(key: Column, url: Column, payload: Column) -> Column:
    """The text of a record without its last line break, for a row of :func:`revisits`."""
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise("")
    uri = lambda x: F.concat(F.lit("<urn:page:"), x.cast("string"), F.lit(">"))
    again = F.col("record_type") == "revisit"
    block = F.when(again, F.lit(HTTP)).otherwise(F.concat(F.lit(HTTP), F.coalesce(payload, F.lit(""))))
    # a line break in a url would end the header
    clean = F.regexp_replace(url, r"[\r\n]+", " ")
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.col("record_type"), F.lit("\r\n"),
        line("WARC-Record-ID", uri(key)), line("WARC-Target-URI", clean), line("WARC-Refers-To", uri(F.col("refers_to"))),
        F.lit("WARC-Payload-Digest: sha256:"), F.col("payload_digest"),
        F.lit("\r\nWARC-Payload-Length: "), F.col("payload_bytes").cast("string"),
        F.when(again, F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")).otherwise(""),
        F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"),
        F.lit("\r\n\r\n"), block, F.lit("\r\n"),
    )


def write_archives(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html") -> None:
    """One record for each row, in archives under ``path``. Null keys and urls leave their header line out, null
    payloads are empty; repeated rows give repeated records; an empty table gives no archives; other columns
    don't matter."""
    rows = revisits(pages.select(F.col(key).alias("k"), F.col(url).alias("u"), F.col(payload).alias("p")), "k", "p")
    size = F.coalesce(F.octet_length("p"), F.lit(0)) + F.coalesce(F.octet_length("u"), F.lit(0))
    low, high = 0, SMALL
    while low < ARCHIVE:
        own = (size >= low) & (size < high) if high < ARCHIVE else size >= low
        # the sink ends each row with the line separator: the record's last line break
        text = rows.filter(own).select(record(F.col("k"), F.col("u"), F.col("p")).alias("value"))
        together = min(400, ARCHIVE // high) if high < ARCHIVE else 1
        text.write.option("lineSep", "\r\n").option("maxRecordsPerFile", max(1, together)).mode("append").text(path)
        low, high = high, 8 * high


def _headers(data: bytes, at: int, blank) -> tuple[dict[str, str], int] | None:
    """Header fields of the record at ``at``, names in lower case, and where its block begins."""
    if not (m := _VERSION.match(data, at)):
        return None
    end = blank(m.end() - 2)
    if end < 0:
        return None
    fields, key = {}, None
    for line in data[m.end() : end].split(b"\r\n"):
        if not line:
            continue
        if line[:1] in b" \t" and key:  # a folded line goes on with the field before it
            fields[key] += " " + line.strip().decode("utf-8", "replace")
            continue
        name, colon, value = line.partition(b":")
        if not colon or not re.fullmatch(rb"[!#-'*+.0-9A-Z^-z|~-]+", name):
            return None
        key = name.decode().lower()
        if key in fields and key != "warc-concurrent-to":  # the header of a cut record runs into the next one
            return None
        fields[key] = value.strip().decode("utf-8", "replace")
    return fields, end + 4


def digest_holds(told: str, data: bytes) -> bool | None:
    """Whether ``told`` (algorithm:value, the value in hex or base32) is the digest of ``data``; None if the algorithm
    isn't known."""
    kind, _, value = told.partition(":")
    name, value = kind.strip().lower().replace("-", ""), value.strip()
    if name not in ("md5", "sha1", "sha224", "sha256", "sha384", "sha512"):
        return None
    own = hashlib.new(name, data).digest()
    return value.lower() == own.hex() or value.upper().rstrip("=") == base64.b32encode(own).decode().rstrip("=")


def parse_record(data: bytes, at: int = 0, blank=None) -> tuple[dict, bytes, int] | str:
    """(fields, block, end) of the record at ``at``; the reason, if it fails a check. ``blank`` gives the next blank line
    from a place on."""
    if not (found := _headers(data, at, blank or _Markers(data).blank)):
        return "no version line and header"
    fields, begin = found
    if not re.fullmatch(r"\d{1,15}", fields.get("content-length", "")) or "warc-type" not in fields:
        return "no length or type"
    end = begin + int(fields["content-length"])
    if data[end : end + 4] != b"\r\n\r\n":
        return "the block doesn't end where it should"
    block = data[begin:end]
    for name, part in (("warc-block-digest", block), ("warc-payload-digest", block.partition(b"\r\n\r\n")[2])):
        if name == "warc-payload-digest" and fields["warc-type"] == "revisit":
            continue  # of the payload that it refers to
        if name in fields and digest_holds(fields[name], part) is False:
            return f"wrong {name}"
    return fields, block, end + 4


class _Markers:
    """The next place of a version line or gzip member; each is searched for once."""

    def __init__(self, data: bytes, members: bool = True):
        self.data, self.line, self.member = data, -1, -1 if members else len(data)
        self.asked, self.found = 0, -2

    def blank(self, at: int) -> int:
        """The first blank line (the line breaks before and of it) from ``at`` on, or -1."""
        if not self.asked <= at or (self.found != -1 and at > self.found):
            self.asked, self.found = at, self.data.find(b"\r\n\r\n", at)
        return self.found

    def after(self, at: int) -> int:
        """The first marker behind ``at``."""
        none = len(self.data)
        if self.line <= at:
            found = _VERSION.search(self.data, at + 1)
            self.line = found.start() if found else none
        if self.member <= at:
            found = self.data.find(_MEMBER, at + 1)
            self.member = found if found >= 0 else none
        return min(self.line, self.member)


def salvage(data: bytes, members: bool = True) -> Iterator[tuple]:
    """("record", from, to, fields, block) and ("gap", from, to, reason, None) of an archive, in order.

    Places of the outer archive's gaps and records cover every byte; records of one gzip member share its places, and
    a gap within a whole member has them, too. What a damaged member still gives comes before its gap, with the
    member's start as both places. ``members=False``: data within a member, where no member is looked for."""
    markers, at, lost, reason = _Markers(data, members), 0, None, ""
    while at < len(data):
        end, items, bad = at, [], None
        if members and data[at : at + 3] == _MEMBER:
            plain, end, bad = unpacked(data, at)
            for kind, a, z, about, block in salvage(plain, False):
                if kind == "record":
                    items.append(("record", at, at if bad else end, about, block))
                elif not bad:
                    items.append(("gap", at, end, f"bytes {a} to {z} of the member: {about}", None))
        elif data[at : at + 5] == b"WARC/":
            found = parse_record(data, at, markers.blank)
            if isinstance(found, str):
                bad = found
            else:
                end = found[2]
                items.append(("record", at, end, *found[:2]))
        else:
            bad = "no version line and header"
        if lost is not None and (items or not bad):
            yield "gap", lost, at, reason, None
            lost = None
        yield from items
        if not bad:
            at = end
            continue
        if lost is None:
            lost, reason = at, bad
        at = markers.after(at)
    if lost is not None:
        yield "gap", lost, len(data), reason, None


def unpacked(data: bytes, at: int, step: int = 1 << 16) -> tuple[bytes, int, str | None]:
    """(plain bytes, end, None) of the gzip member at ``at``; of a damaged one what can be unpacked and the reason."""
    unpack, out, view, place = zlib.decompressobj(31), [], memoryview(data), at
    while not unpack.eof and place < len(data):
        part = view[place : place + step]
        try:
            out.append(unpack.decompress(part))
        except zlib.error as e:
            # the same again in small steps gives what stands before the damage
            return b"".join([*out, *_before_damage(view[at:place], part)]), place, f"bad gzip member: {e}"
        place += len(part)
    if not unpack.eof:
        return b"".join(out), place, "gzip member without an end"
    return b"".join(out), place - len(unpack.unused_data), None


def _before_damage(good: memoryview, part: memoryview) -> Iterator[bytes]:
    unpack = zlib.decompressobj(31)
    for k in range(0, len(good), 1 << 16):
        unpack.decompress(good[k : k + (1 << 16)])
    for k in range(len(part)):
        try:
            yield unpack.decompress(part[k : k + 1])
        except zlib.error:
            return


_FOUND = "kind string, archive string, from long, to long, reason string, record_id string, page_id long, record_type string, refers_to long, url string, payload_bytes long, payload_digest string, payload binary"


def _reader(payloads: bool):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        number = lambda x: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", x or "")) else None
        schema = pa.schema([("kind", pa.string()), ("archive", pa.string()), ("from", pa.int64()), ("to", pa.int64()), ("reason", pa.string()), ("record_id", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = []
                for kind, a, z, about, block in salvage(data.as_py()):
                    row = {"kind": kind, "archive": path, "from": a, "to": z}
                    if kind == "gap":
                        row["reason"] = about
                    else:
                        payload = block.partition(b"\r\n\r\n")[2]
                        again = about["warc-type"] == "revisit"
                        told = about.get("warc-payload-length", "")
                        row |= {"record_id": about.get("warc-record-id"), "page_id": number(about.get("warc-record-id")), "record_type": about["warc-type"], "refers_to": number(about.get("warc-refers-to")), "url": about.get("warc-target-uri")}
                        row |= {"payload_bytes": (int(told) if told.isdigit() else None) if again else len(payload), "payload_digest": about.get("warc-payload-digest", "").partition(":")[2] or None if again else sha256(payload).hexdigest()}
                        if payloads and not again:
                            row["payload"] = payload
                    rows.append(row)
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """All records and quarantined gaps of the archives under ``path``: ``kind`` (record or gap), archive, from, to,
    reason, and the fields of a record. ``page_id`` is null where the record's id (``record_id``) isn't one of ours.

    An archive is read by one task and may have some hundred MB. Records that stand twice are given twice; an empty
    archive gives no row; what isn't a WARC archive at all is one gap; a null payload comes back empty, a payload of any
    length whole."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(_reader(payloads), _FOUND)


def op2_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "archives")
    write_archives(documents(spark, sf_dir, "pages"), path)
    found = read_archives(spark, path, payloads=False).filter("kind = 'record'")
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = f"""
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= {LEAST} THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first IS NOT NULL AND first IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first IS NOT NULL AND first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM f"""
