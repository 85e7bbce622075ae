"""Defined results for nulls, empty and long texts, ties, repeated rows, empty tables, and clashing columns."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from cuelake.llm import decontaminate, huffman, licenses, mixing, pitman_yor, quality, repeats, sharding, simhash, token_ids, warc
from cuelake.llm.common import scratch, word_count

VOCABULARY = "the of and to in is that for with on as by at from".split()


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) if r.random() < 0.4 else "".join(r.choice("abcdefgh") for _ in range(r.randint(3, 7))) for _ in range(n))


ODD = [None, "", " \t\n", "a", prose(60, 1), prose(60, 1), prose(5000, 2), "x" * 30_000, "word " * 400, "Ünï cödé " * 30]


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def ascii_lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def repeated(w, n=8):
    from collections import Counter

    grams = [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]
    count = Counter(grams)
    return len({i + j for i, g in enumerate(grams) if count[g] > 1 for j in range(n)})


# ---- 1: quality rules


def test_quality_base(make_docs):
    texts = [*ODD, "a b c\na b c\n\n" * 9, "p q r s t u v w x " * 3 + "z", "# $ % & |<> *"]
    found = {r.doc_id: r for r in quality.score_quality(make_docs(texts), ["doc_id"]).collect()}
    for i, t in enumerate(texts):
        w, r = words(t), found[i]
        lines = [x for x in (t or "").split("\n") if words(x)]
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), repeated(w)), i
        assert r.n_symbols == len(re.findall(r"[#*$%&|<>]", t or ""))
        assert r.base_failed == (len(w) < 20 or 100 * repeated(w) > 30 * len(w))
        assert not (r.base_failed and r.kept)


def test_quality_keeps_clean_and_drops_junk(make_docs):
    texts = [prose(100, k) for k in range(150)] + [" ".join(w + "%%%" for w in prose(100, 1000 + k).split()) for k in range(15)]
    kept = {r.doc_id: r.kept for r in quality.score_quality(make_docs(texts), ["doc_id"]).collect()}
    assert all(kept[i] for i in range(150)) and not any(kept[i] for i in range(150, 165))


def test_quality_of_nothing_and_of_clashing_names(spark, make_docs):
    docs = make_docs([prose(50, 3)]).withColumn("n_words", F.lit("other")).withColumn("kept", F.lit(9))
    row = quality.score_quality(docs, docs.columns).first()
    assert row.n_words == 50 and row.kept is True and row.text
    assert quality.score_quality(docs.limit(0), ["doc_id"]).count() == 0
    assert quality.score_quality(docs.withColumns({"lang": F.lit(None).cast("string"), "source": F.lit(None).cast("string")}), ["doc_id"]).count() == 1


def test_fences_follow_their_group(make_docs):
    """What is usual in one source is rejected in another; small groups are drawn to the others."""
    plain = [prose(100, k) for k in range(1300)]
    marked = [" ".join(w + ("#" if j % 12 == 0 else "") for j, w in enumerate(prose(100, 5000 + k).split())) for k in range(1300)]
    probe = " ".join(w + ("#" if j % 10 == 0 else "") for j, w in enumerate(prose(100, 9999).split()))
    docs = make_docs([*plain, *marked, probe, probe, probe], ["plain"] * 1300 + ["code"] * 1300 + ["plain", "code", "new"])
    kept = {r.doc_id: r.kept for r in quality.score_quality(docs, ["doc_id"]).collect()}
    assert (kept[2600], kept[2601]) == (False, True)
    assert sum(kept[k] for k in range(2600)) == 2600
    everyone = quality.fences(quality.sketch(quality.base_signals(docs, ["source"]).withColumns(quality.signal_values()), ["source"]), ["source"])
    most = {r.source: r.symbol_share_max for r in everyone.collect()}
    assert most["plain"] == 15 and most["code"] > 30
    with pytest.raises(ValueError):
        quality.score_quality(docs, ["doc_id"], prior=0)


def test_sketches_merge(spark, make_docs):
    docs = make_docs([prose(30 + k, k) for k in range(40)])
    rows = quality.base_signals(docs, ["doc_id"]).withColumns(quality.signal_values()).withColumn("k", F.lit(1))
    whole = quality.sketch(rows, ["k"])
    halves = quality.sketch(rows.filter("doc_id % 2 = 0"), ["k"]).unionByName(quality.sketch(rows.filter("doc_id % 2 = 1"), ["k"]))
    assert quality.fences(whole, ["k"]).collect() == quality.fences(halves, ["k"]).collect()


# ---- 2: WARC


def page_rows(spark, pages):
    return spark.createDataFrame(pages, "page_id long, url string, html string")


def test_warc_round_trip(spark):
    big, bad = "<p>" + "é" * 50_000, "x" * 120 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n"
    pages = [(1, "http://a", big), (2, None, big), (None, "u\nv", big), (3, "c", None), (4, "d", ""), (5, "e", "short"), (6, "f", "short"), (7, "g", bad), (8, "h", bad)]
    path = scratch(spark, "test-warc")
    warc.write_archives(page_rows(spark, pages).withColumn("payload_digest", F.lit("clash")), path)
    found = warc.read_archives(spark, path).collect()
    assert {r.kind for r in found} == {"record"} and len(found) == len(pages)
    by = {r.page_id: r for r in found}
    assert by[1].record_type == "response" and (by[2].record_type, by[2].refers_to) == ("revisit", 1) and by[None].refers_to == 1
    assert by[8].refers_to == 7 and by[6].record_type == by[5].record_type == by[3].record_type == "response"
    for i, _, html in pages:
        data = (html or "").encode()
        assert (by[i].payload_bytes, by[i].payload_digest) == (len(data), hashlib.sha256(data).hexdigest())


def test_warc_of_nothing(spark):
    path = scratch(spark, "test-warc")
    warc.write_archives(page_rows(spark, []), path)
    assert warc.read_archives(spark, path).count() == 0


def one_record(i, body=b"payload"):
    block = b"HTTP/1.1 200 OK\r\n\r\n" + body
    return b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:%d>\r\nWARC-Payload-Digest: sha256:%s\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (i, hashlib.sha256(body).hexdigest().encode(), len(block), block)


@pytest.mark.parametrize("gz", [False, True])
def test_salvage(gz):
    import gzip

    pack = gzip.compress if gz else bytes
    parts = [pack(one_record(i, b"%d" % i * 50)) for i in range(6)]
    broken = [*parts]
    broken[1] = bytes([parts[1][0] ^ 1]) + parts[1][1:]  # a spoilt start
    broken[3] = parts[3][: len(parts[3]) // 2]  # a lost end
    data = b"".join(broken) + b"trailing"
    found = list(warc.salvage(data))
    ids = [x[3]["warc-record-id"] for x in found if x[0] == "record"]
    assert ids == [f"<urn:page:{i}>" for i in (0, 2, 4, 5)]
    assert [x[0] for x in found] == ["record", "gap", "record", "gap", "record", "record", "gap"]
    at = 0
    for kind, a, z, *_ in found:
        assert a == at
        at = z
    assert at == len(data)


def test_salvage_keeps_whole_records_of_damaged_members():
    import gzip

    three = [one_record(i, bytes(random.Random(i).choices(range(256), k=3000))) for i in (1, 2, 3)]
    ids = lambda data: [int(x[3]["warc-record-id"][10:-1]) for x in warc.salvage(data) if x[0] == "record"]
    spoilt = gzip.compress(three[0] + three[1].replace(b"WARC-Type", b"WARC Type") + three[2]) + gzip.compress(one_record(4))
    assert ids(spoilt) == [1, 3, 4]
    gaps = [x for x in warc.salvage(spoilt) if x[0] == "gap"]
    assert len(gaps) == 1 and f"bytes {len(three[0])} to {len(three[0]) + len(three[1])} of the member" in gaps[0][3]
    cut = gzip.compress(b"".join(three))[:-30]  # without its end
    assert ids(cut + gzip.compress(one_record(4))) == [1, 2, 4] and ids(cut) == [1, 2]
    member = bytearray(gzip.compress(b"".join(three)))
    member[-1500:-1400] = b"\0" * 100  # damaged in the third record
    found = list(warc.salvage(bytes(member) + gzip.compress(one_record(4))))
    assert ids(bytes(member) + gzip.compress(one_record(4))) == [1, 2, 4]
    gap = next(x for x in found if x[0] == "gap")
    assert (gap[1], gap[2]) == (0, len(member))


def test_salvage_of_random_damage():
    """Bytes are spoilt at random: records that aren't touched come back, others don't, and the places cover all."""
    r = random.Random(6)
    for trial in range(60):
        parts = [one_record(i, bytes(r.choices(b"ab \r\n:", k=r.randint(0, 300)))) for i in range(8)]
        data, touched, at = bytearray(b"".join(parts)), set(), 0
        edges = [sum(map(len, parts[:i])) for i in range(9)]
        for k in r.sample(range(len(data)), 3):
            data[k] ^= 0x55
            touched.add(next(i for i in range(8) if edges[i] <= k < edges[i + 1]))
        found = list(warc.salvage(bytes(data)))
        known = {edges[i]: i for i in range(8)}
        whole = {known[x[1]] for x in found if x[0] == "record" and x[1] in known and bytes(data[x[1] : x[2]]) == parts[known[x[1]]]}
        assert whole == set(range(8)) - touched, trial
        for _, a, z, *_ in found:
            assert a == at
            at = z
        assert at == len(data)


def test_headers_and_digests_of_others():
    import base64

    body = b"HTTP/1.1 200 OK\r\n\r\nhello"
    record = lambda *lines: b"WARC/1.0\r\nWARC-Type: response\r\n" + b"\r\n".join(lines) + b"\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(body), body)
    kinds = lambda data: [x[0] for x in warc.salvage(data)]
    sha1 = hashlib.sha1(b"hello").digest()
    assert kinds(record(b"WARC-Payload-Digest: sha1:" + base64.b32encode(sha1))) == ["record"]
    assert kinds(record(b"WARC-Payload-Digest: sha1:" + sha1.hex().encode())) == ["record"]
    assert kinds(record(b"WARC-Payload-Digest: sha1:" + base64.b32encode(hashlib.sha1(b"other").digest()))) == ["gap"]
    assert kinds(record(b"WARC-Block-Digest: md5:" + hashlib.md5(body).hexdigest().encode())) == ["record"]
    assert kinds(record(b"WARC-Block-Digest: unheard-of:abc")) == ["record"]
    folded = list(warc.salvage(record(b"WARC-Target-URI: http://a/", b" b", b"\tc")))
    assert folded[0][0] == "record" and folded[0][3]["warc-target-uri"] == "http://a/ b c"


def test_salvage_work_grows_with_the_length():
    """Many members and many gaps: no search starts over."""
    import gzip
    import time

    def seconds(n):
        data = b"".join(gzip.compress(one_record(i)) + b"WARC/1.1\r\nbroken" for i in range(n))
        began = time.process_time()
        assert sum(x[0] == "record" for x in warc.salvage(data)) == n
        return time.process_time() - began

    seconds(100)
    assert seconds(8000) < 12 * seconds(2000) + 0.5


def test_archives_of_large_records(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE", 400_000)
    monkeypatch.setattr(warc, "SMALL", 1000)
    pages = [(i, "u", chr(97 + i % 7) * (10 + 37 * i * i)) for i in range(120)]
    path = scratch(spark, "test-large")
    warc.write_archives(page_rows(spark, pages).repartition(1), path)
    sizes = [r.length for r in spark.read.format("binaryFile").load(path).select("length").collect()]
    assert max(sizes) < 700_000 and len(sizes) < 100
    found = {r.page_id: r for r in warc.read_archives(spark, path).collect()}
    assert len(found) == 120 and all(bytes(found[i].payload).decode() == t for i, _, t in pages)


def test_salvage_checks_digests():
    data = one_record(1).replace(b"payload\r\n", b"pAyload\r\n") + one_record(2)
    assert [x[0] for x in warc.salvage(data)] == ["gap", "record"]


# ---- 3: SimHash


def test_fingerprints(make_docs):
    from xxhash import xxh64_intdigest

    texts = [*ODD, "One TWO three", "a b c d", "a b c d e É"]
    found = {r.doc_id: r.fp % (1 << 64) for r in simhash.fingerprints(make_docs(texts), ["doc_id"]).collect()}
    for i, t in enumerate(texts):
        w = words(ascii_lower(t))
        grams = [" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
        hashes = [xxh64_intdigest(g.encode(), 42) for g in grams]
        assert found[i] == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)), i


@pytest.mark.parametrize("tree", [simhash.TREE, 7])
def test_components_equal_brute_force(spark, tree):
    r = random.Random(5)
    base = [r.getrandbits(64) for _ in range(12)]
    fps = list({b ^ sum(1 << r.randrange(64) for _ in range(r.randrange(6))) & ((1 << 64) - 1) for b in base for _ in range(40)})
    up = list(range(len(fps)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    signed = [(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(fps)]
    edges = simhash.link_fingerprints(spark.createDataFrame(signed, "fp long, id long"), tree=tree)
    assert edges.count() < 15 * 4 * len(fps)
    found = dict(simhash.connected_components(edges).collect())
    assert [found.get(i, i) for i in range(len(fps))] == [find(i) for i in range(len(fps))]


def test_near_duplicates_odd_rows(spark, make_docs):
    docs = make_docs(ODD)
    docs = docs.unionByName(docs.filter("doc_id = 4")).withColumn("fp", F.lit(1)).unionByName(docs.filter("doc_id = 4").withColumns({"doc_id": F.lit(None).cast("long"), "fp": F.lit(2)}))
    found = simhash.near_duplicates(docs).collect()
    assert len(found) == len(ODD) + 2
    by = {r.doc_id: r.component_id for r in found}
    assert by[0] == by[1] == by[2] == 0 and by[4] == by[5] == by[None] == 4
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


# ---- 4: token ids


def test_code_lengths_are_best():
    assert huffman.code_lengths({5: 10}) == {5: 1} and huffman.code_lengths({}) == {}
    assert sorted(huffman.code_lengths({1: 1, 2: 1, 3: 2, 4: 4}).values()) == [1, 2, 3, 3]
    counts = {i: 1 << i for i in range(20)}
    lengths = huffman.code_lengths(counts, 8)
    assert max(lengths.values()) == 8 and sum(2.0**-x for x in lengths.values()) <= 1
    with pytest.raises(ValueError):
        huffman.code_lengths({i: 1 for i in range(5)}, 2)


def test_code_length_limit_against_search():
    """All ways to give four ids lengths of at most three bits: none is cheaper."""
    from itertools import product

    for seed in range(20):
        r = random.Random(seed)
        counts = {i: r.randint(1, 50) for i in range(5)}
        best = min(sum(c * x for c, x in zip(counts.values(), lens)) for lens in product((1, 2, 3), repeat=5) if sum(2.0**-x for x in lens) <= 1)
        assert sum(counts[i] * x for i, x in huffman.code_lengths(counts, 3).items()) == best


def test_token_ids_round_trip(spark, make_docs):
    tokenizers = pytest.importorskip("tokenizers")
    import numpy as np

    texts = [*ODD, "a  b   c \n\n d", " x y", "it's I'm  fine ", "<|endoftext|> a"]
    docs = make_docs(texts).withColumn("start", F.lit("clash")).orderBy(F.desc("doc_id"))
    path = scratch(spark, "test-ids")
    token_ids.write_token_ids(docs, path)
    found = token_ids.read_token_ids(spark, path).orderBy("key").collect()
    crc = {r.key: r.ids for r in token_ids.read_token_ids(spark, path, digest=True).collect()}
    library, start = tokenizers.Tokenizer.from_file(token_ids.vocabulary_path()), 0
    for i, (t, r) in enumerate(zip(texts, found)):
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        assert (r.key, r.start, r.n_tokens, r.ids) == (i, start, len(ids), ids)
        assert crc[i] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    token_ids.write_token_ids(docs.limit(0), path + "-none")
    assert token_ids.read_token_ids(spark, path + "-none").count() == 0


def test_long_pieces_are_not_remembered(spark, make_docs, monkeypatch):
    """The memory of pieces is bounded in bytes, and a document may be longer than a block."""
    import numpy as np

    tokenizers = pytest.importorskip("tokenizers")
    monkeypatch.setattr(token_ids, "BLOCK", 50)
    encoder = token_ids.Encoder(token_ids.vocabulary_path())
    text = "a " + "xyz" * 2000 + " " + prose(300, 4)
    assert np.frombuffer(encoder.encode([text], 2)[0], "<u2").tolist() == tokenizers.Tokenizer.from_file(token_ids.vocabulary_path()).encode(text, add_special_tokens=False).ids + [2]
    assert max(map(len, encoder.pieces)) < 20 and encoder.size == sum(map(len, encoder.pieces))
    path = scratch(spark, "test-long")
    token_ids.write_token_ids(make_docs([text, "b", text]), path)
    assert [(r.key, r.n_tokens) for r in token_ids.read_token_ids(spark, path, digest=True).orderBy("key").collect()] == [(0, len(encoder.encode([text], 2)[0]) // 2), (1, 2), (2, len(encoder.encode([text], 2)[0]) // 2)]


def test_simple_pieces_go_to_the_merges(monkeypatch):
    """Words with marks after them need neither the library's regex nor its added tokens; all other pieces do."""
    import numpy as np

    pytest.importorskip("tokenizers")
    encoder = token_ids.Encoder(token_ids.vocabulary_path())
    library, seen = encoder.library, []

    class Watched:
        def encode_batch_fast(self, texts, **options):
            seen.extend(texts)
            return library.encode_batch_fast(texts, **options)

    monkeypatch.setattr(encoder, "library", Watched())
    for text in ("A word, être%%%\nÜber (no ###\nend.", "it's 5 x\u00a0y a<|endoftext|> \u4e2d\u6587 re'll", "a.\n\nb \u00d7 \u00b5 \u00e9\u0301"):
        assert np.frombuffer(encoder.encode([text], 2)[0], "<u2").tolist() == library.encode(text, add_special_tokens=False).ids + [2]
    assert {"A", " (no ###\nend."} <= set(seen) and not [t for t in seen if "word" in t or "ber" in t]


# ---- 5: sharding


def test_shards_are_even(spark, make_docs):
    docs = make_docs([f"t{k % 7}" for k in range(1003)]).withColumn("slot", F.lit(5)).withColumn("rank", F.lit(1))
    out = sharding.shard_documents(docs, 16).collect()
    sizes = [sorted(r.slot for r in out if r.shard == s) for s in range(16)]
    assert all(s == list(range(len(s))) for s in sizes) and {len(s) for s in sizes} == {62, 63}
    assert sorted(r.doc_id for r in out) == list(range(1003)) and out[0]["rank"] == 1
    assert sharding.shard_documents(docs.limit(0)).count() == 0
    same = docs.withColumn("doc_id", F.lit(None).cast("long"))
    assert sorted(sharding.shard_documents(same, 4).groupBy("shard").count().toPandas()["count"]) == [250, 251, 251, 251]


def test_placement_equals_brute_force(make_docs):
    """Cells filled in their own order, each key to the next virtual node clockwise with room; hot keys among them."""
    from collections import Counter

    docs = make_docs([f"text {k}" for k in range(900)]).withColumn("doc_id", F.when(F.col("doc_id") % 3 == 0, F.lit(None)).when(F.col("doc_id") % 3 == 1, 5).otherwise(F.col("doc_id")).cast("long"))
    keyed = docs.withColumn("cell", F.shiftrightunsigned(F.xxhash64("doc_id"), 48).cast("int"))
    cells = {(r.doc_id, r.text): r.cell for r in keyed.collect()}
    counts, nodes = Counter(cells.values()), sharding.ring(7)
    room, want = {s: 900 // 7 + (s < 900 % 7) for s in range(7)}, Counter()
    for cell in sorted(counts, key=lambda c: (sharding._hash("cell", c), c)):
        clockwise = sorted(nodes, key=lambda n: ((n[0] - cell) % sharding.CELLS, n[1]))
        for _ in range(counts[cell]):
            shard = next(s for _, s in clockwise if room[s])
            room[shard] -= 1
            want[cell, shard] += 1
    out = sharding.shard_documents(docs, 7).collect()
    assert Counter((cells[r.doc_id, r.text], r.shard) for r in out) == want
    assert sorted((r.shard, r.slot) for r in out) == [(s, k) for s in range(7) for k in range(900 // 7 + (s < 900 % 7))]


def test_sharding_query(spark, make_docs, tmp_path):
    make_docs(ODD).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r for r in sharding.op5_shard_ring(spark, str(tmp_path)).collect()}
    for i, t in enumerate(ODD):
        data = (t or "").encode()
        assert (found[i]["size"], found[i].text_crc32, found[i].law, found[i].grown_shard) == (len(data) + 1, zlib.crc32(data), "rows", None)


def test_few_keys_move():
    r = random.Random(1)
    counts = {c: r.randint(1, 3) for c in range(0, sharding.CELLS, 9)}
    place = lambda n: {(c, k): s for c, a, z, s, _ in sharding.fill_ring(counts, n) for k in range(a, z)}
    a, b = place(16), place(17)
    moved = sum(a[k] != b[k] for k in a) / len(a)
    assert moved < 0.12  # 1 of 17 must


# ---- 6: licenses


def test_licenses(make_docs):
    texts = [*ODD, "x Apache License, Version 2.0 y MIT license.", "cc-by cc by CC BY-SA 4.0", "Permission is hereby granted, free of charge, to any person obtaining a copy", "mit license mit license", "submit licenses"]
    found = {r.doc_id: r for r in licenses.scan_licenses(make_docs(texts).withColumn("labels", F.lit(0)), ["doc_id", "labels"]).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(t))
        at = [(k, x) for p, x in licenses.BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        r = found[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), min(at, default=[None])[0], max(at, default=[None])[0]), i
        assert r.base_labels == ",".join(sorted({x for _, x in at})) and {x for _, x in at} <= set(r.labels.split(",")) and 0 <= r.score <= 1
    n = len(ODD)
    assert "apache-2.0" in found[n].labels and found[n].score == 0.9
    assert found[n + 1].labels == "cc-by,cc-by-sa-4.0"
    assert (found[n + 2].labels, found[n + 2].score) == ("mit", 1.0)
    assert found[n + 4].labels == "" and len(licenses.rules()) > 300
    assert licenses.scan_licenses(make_docs([]), ["doc_id"]).count() == 0


def matches(parsed, rng):
    """A random match of a parsed regex."""
    out = ""
    for op, x in parsed:
        name = str(op)
        if name == "LITERAL":
            out += chr(x)
        elif name == "IN":
            out += "5" if str(x[0][0]) == "CATEGORY" and "DIGIT" in str(x[0][1]) else "w" if str(x[0][0]) == "CATEGORY" else chr(rng.choice(x)[1])
        elif name == "BRANCH":
            out += matches(rng.choice(x[1]), rng)
        elif name == "SUBPATTERN":
            out += matches(x[3], rng)
        elif name == "MAX_REPEAT":
            out += "".join(matches(x[2], rng) for _ in range(rng.randint(x[0], min(x[1], x[0] + 1))))
        else:
            raise ValueError(name)
    return out


def test_prefilter_drops_no_match(make_docs, monkeypatch):
    rng, every = random.Random(4), licenses.rules()
    texts = ["Released under Creative Commons Attribution-ShareAlike 4.0", "distributed under MPL 2.0", "available under the BSD 3-Clause", "EPL 2.0", "all rights reserved", "AGPL License"]
    gate = re.compile(licenses.gate(every))
    for _, _, regex, clauses, _ in every:
        for _ in range(20):
            text = f" {matches(re._parser.parse(regex), rng)} "
            assert re.fullmatch(f" {regex} ", text) and all(any(k in text for k in c) for c in clauses) and gate.search(text)
        texts.append(text)
    docs = make_docs(texts)
    found = {r.doc_id: r for r in licenses.scan_licenses(docs, ["doc_id"]).collect()}
    assert all(r.labels and r.score > 0 for r in found.values())
    monkeypatch.setattr(licenses, "rules", lambda: [(p, x, r, (("",),), w) for p, x, r, _, w in every])
    monkeypatch.setattr(licenses, "gate", lambda every: " ")
    assert found == {r.doc_id: r for r in licenses.scan_licenses(docs, ["doc_id"]).collect()}


def test_gate_lets_few_rules_pass():
    """The first clauses leave plain prose alone, and a license line meets a few rules, not all."""
    every = licenses.rules()
    gate = re.compile(licenses.gate(every))
    assert not any(gate.search(f" {prose(3000, k)} die katze geht mit dem hund ") for k in range(5))
    for text in (" licensed under the apache license version 2 0 ", " mit license ", " gnu general public license version 3 ", " cc by sa 4 0 "):
        assert sum(all(any(k in text for k in c) for c in r[3]) for r in every) <= 20


def brute_detections(norm, every):
    found = sorted((m.start(), -m.end(), p, x) for p, x, r, _, _ in every for m in re.finditer(f" {r}(?= )", norm))
    chain, reach = [], -1
    for a, z, p, x in found:
        if -z > reach:
            chain.append((a, -z, p, x))
            reach = -z
    over = lambda i, j: 0 <= i < j < len(chain) and chain[i][1] > chain[j][0]
    stays = [c for i, c in enumerate(chain) if not (over(i - 1, i) and (chain[i - 1][2] < c[2] or (chain[i - 1][2] == c[2] and chain[i - 1][3] == c[3]))) and not (over(i, i + 1) and chain[i + 1][2] < c[2])]
    return sorted({c[3] for c in stays})


def test_detections_equal_brute_force(make_docs):
    """Labels of whole texts against a plain search by all rules, without gates."""
    rng, every = random.Random(9), licenses.rules()
    texts = []
    for k in range(120):
        parts = []
        for _ in range(rng.randint(1, 5)):
            parts.append(matches(re._parser.parse(rng.choice(every)[2]), rng))
            if rng.random() < 0.5:
                parts.append(prose(rng.randint(1, 4), k))
        texts.append(" ".join(parts))
    found = {r.doc_id: r for r in licenses.scan_licenses(make_docs(texts), ["doc_id"]).collect()}
    for i, t in enumerate(texts):
        want = set(brute_detections(f" {t} ", every)) | set(found[i].base_labels.split(",") if found[i].base_labels else ())
        assert found[i].labels == ",".join(sorted(want)), t


def test_contained_detections_are_suppressed(make_docs):
    docs = make_docs(["licensed under the apache license version 2 0"]).select("doc_id", licenses.normalised(F.col("text")).alias("n"))
    hits = docs.select("doc_id", licenses.matches(F.col("n"), licenses.rules()).alias("h"))
    found = licenses.resolve(licenses.placed(hits, "doc_id", "h"), "doc_id").collect()
    assert [(r.label, r.start) for r in found] == [("apache-2.0", 0)]


def test_partial_overlaps_are_settled_by_priority(spark):
    rows = [(1, 2, "a", 0, 10), (1, 1, "b", 8, 20), (1, 3, "b", 18, 30), (2, 2, "mit", 0, 10), (2, 2, "mit", 8, 20), (3, 2, "x", 0, 10), (3, 2, "y", 8, 20), (3, 1, "z", 20, 25)]
    found = spark.createDataFrame([(k, p, x, 1.0, a, z) for k, p, x, a, z in rows], "k int, priority int, label string, weight double, start int, end int")
    stays = sorted((r.k, r.label, r.start) for r in licenses.resolve(found, "k").collect())
    assert stays == [(1, "b", 8), (2, "mit", 0), (3, "x", 0), (3, "y", 8), (3, "z", 20)]


# ---- 7: repeats


def brute_repeats(texts, length):
    from collections import Counter

    data = [(t or "").encode() for t in texts]
    count = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        hit = [False] * len(d)
        for i in range(len(d) - length + 1):
            if count[d[i : i + length]] > 1:
                hit[i : i + length] = [True] * length
        runs = sum(h and not (i and hit[i - 1]) for i, h in enumerate(hit))
        out.append((len(d), sum(hit), runs, bytes(c for c, h in zip(d, hit) if not h)))
    return out


@pytest.mark.parametrize("hot", [repeats.HOT, 3])
def test_repeats(spark, make_docs, monkeypatch, hot):
    monkeypatch.setattr(repeats.repeated_blocks, "__defaults__", (repeats.LENGTH, repeats.GRAM, hot))
    passage = prose(60, 77)
    texts = ["", None, "short", "x" * 700, prose(80, 1), prose(80, 1)] + [prose(30, 10 + k) + passage[k * 3 :] + prose(20, 40 + k) for k in range(8)] + ["é" * 150 + prose(30, 9), "é" * 150, passage[:199], passage[5:205]]
    docs = make_docs(texts).withColumn("n_bytes", F.lit("clash"))
    found = {r.doc_id: r for r in repeats.remove_repeats(docs.drop("n_bytes"), ["doc_id"]).collect()}
    for i, want in enumerate(brute_repeats(texts, 200)):
        r = found[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == want, i


def test_repeats_in_long_texts(make_docs, monkeypatch):
    """Texts longer than the pieces that are looked at."""
    monkeypatch.setattr(repeats, "PIECE", 500)
    passage = prose(300, 5)
    texts = [prose(200, 1) + passage, passage + prose(300, 2), prose(400, 3)]
    found = {r.doc_id: r for r in repeats.remove_repeats(make_docs(texts), ["doc_id"]).collect()}
    for i, want in enumerate(brute_repeats(texts, 200)):
        assert (found[i].n_bytes, found[i].n_removed, found[i].n_spans, bytes(found[i].kept)) == want
    with pytest.raises(ValueError):
        repeats.remove_repeats(make_docs(texts), ["doc_id"], length=5000)


def test_repeated_rows_and_none(make_docs):
    docs = make_docs([prose(80, 1), prose(80, 2)])
    twice = docs.unionByName(docs.filter("doc_id = 0"))
    found = sorted((r.doc_id, r.n_removed > 0) for r in repeats.remove_repeats(twice, ["doc_id"], texts=False).collect())
    assert found == [(0, True), (0, True), (1, False)]
    assert repeats.remove_repeats(docs.limit(0), ["doc_id"]).count() == 0


# ---- 8: mixing


def brute_mix(sizes, sources, keys, weights=(5, 2, 1), repeats=3):
    """Words taken of each row, by one global queue."""
    names = sorted({x for x in sources if x is not None}) + ([None] if None in sources else [])
    queue, budget, taken = [], sum(sizes), [0] * len(sizes)
    for r, name in enumerate(names):
        rows = [i for i, x in enumerate(sources) if x == name]
        rows.sort(key=lambda i: (hashlib.md5(f"{'' if keys[i] is None else keys[i]}:mix:{sizes[i]}".encode()).hexdigest(), i))
        run = 0
        for _ in range(repeats):
            for i in rows:
                run += sizes[i]
                queue.append((run / weights[r % 3], r, i))
    for _, _, i in sorted(x for x in queue if sizes[x[2]]):
        own = min(sizes[i], budget)
        taken[i] += own
        budget -= own
    return taken


def test_mix(spark, make_docs):
    sources = ["a"] * 10 + ["b"] * 80 + [None] * 3 + ["c"] * 40
    docs = make_docs([prose(20 + k % 9, k) for k in range(len(sources) - 1)] + [None], sources).withColumn("target", F.lit("clash"))
    out = mixing.mix_sources(docs, word_count(F.col("text"))).collect()
    again = mixing.mix_sources(docs.repartition(3), word_count(F.col("text"))).collect()
    assert sorted((r.doc_id, r.taken) for r in out) == sorted((r.doc_id, r.taken) for r in again)
    total = sum(r["size"] for r in out)
    targets = {r.source: r.target for r in out}
    sizes = {s: sum(r["size"] for r in out if r.source == s) for s in targets}
    assert abs(sum(targets.values()) - total) < 1e-6 and sum(r.taken for r in out) == total
    for s in targets:
        assert abs(sum(r.taken for r in out if r.source == s) - targets[s]) <= 30 and targets[s] <= 3 * sizes[s]
    assert all(0 <= r.taken <= 3 * r["size"] for r in out)
    assert targets["a"] == 3 * sizes["a"]
    by = sorted(out, key=lambda r: r.doc_id)
    assert [r.taken for r in by] == brute_mix([r["size"] for r in by], sources, [r.doc_id for r in by])
    assert mixing.mix_sources(docs.limit(0), F.lit(1)).count() == 0
    assert {r.taken for r in mixing.mix_sources(make_docs([None, ""]), word_count(F.col("text"))).collect()} == {0}
    order = mixing.mixed_order(mixing.mix_sources(docs, word_count(F.col("text"))), 3).collect()
    assert sum(r.words for r in order) == total and [r.finish for r in order] == sorted(r.finish for r in order)
    assert max(r["copy"] for r in order) == 2 and all(r.words == r["size"] for r in order[:-1])


def test_mix_of_rows_that_share_a_key(make_docs):
    """No key at all, and one key for most rows: the words taken are those of the one queue."""
    sources, sizes = ["a", "b", "b"] * 40, [5 + k % 3 for k in range(120)]
    for keys in ([None] * 120, [7 if k % 4 else k for k in range(120)]):
        docs = make_docs([prose(n, k) for k, n in enumerate(sizes)], sources).withColumn("doc_id", F.when(F.lit(keys[0] is None), F.lit(None)).otherwise(F.when(F.col("doc_id") % 4 == 0, F.col("doc_id")).otherwise(7)).cast("long"))
        out = mixing.mix_sources(docs, word_count(F.col("text"))).collect()
        found = sorted((r.source, str(r.doc_id), r["size"], r.taken) for r in out)
        assert found == sorted((x, str(k), n, t) for x, k, n, t in zip(sources, keys, sizes, brute_mix(sizes, sources, keys)))


@pytest.mark.parametrize("buckets, most", [(mixing.TIME_BUCKETS, mixing.SORTED), (3, 2), (2, 1)])
def test_the_cut_is_found_by_buckets(spark, buckets, most):
    r = random.Random(3)
    rows = sorted((r.choice([1.5, r.uniform(0, 50)]), k, r.randint(1, 9)) for k in range(200))
    copies = spark.createDataFrame(rows, "finish double, rank int, n long")
    for budget in (1, 37, 500, sum(x[2] for x in rows)):
        left = budget
        for f, k, n in rows:
            if n >= left:
                break
            left -= n
        assert mixing.find_cut(copies, budget, 50.0, buckets, most) == (f, k, left)
    assert mixing.find_cut(copies, 10_000, 50.0, buckets, most) is None


# ---- 9: language model


def test_scores(make_docs):
    import math
    from collections import Counter

    texts = [*ODD, *[prose(200, 500 + k) for k in range(40)]]
    docs = make_docs(texts).withColumn("score", F.lit("clash"))
    found = {r.doc_id: r for r in pitman_yor.score_texts(docs).collect()}
    toks = [words(ascii_lower(t)) + [" "] for t in texts]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    count = Counter(w for t, h in zip(toks, held) if not h for w in t)
    n, v = sum(count.values()), len(count)
    for i, t in enumerate(toks):
        r = found[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(t), sum(w in count for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t))
        assert r.score < 0
    rest = [i for i in range(len(texts)) if held[i]]
    assert rest and sum(found[i].score for i in rest) > sum(found[i].base_score for i in rest)
    again = {r.doc_id: r.score for r in pitman_yor.score_texts(docs).collect()}
    assert all(again[i] == pytest.approx(found[i].score) for i in again)
    assert pitman_yor.score_texts(docs.limit(0)).count() == 0


def test_scores_dont_depend_on_partitions(spark, make_docs):
    docs = make_docs([prose(150, 700 + k) for k in range(60)])
    found = []
    for n in (4, 7):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.append(sorted((r.doc_id, r.score) for r in pitman_yor.score_texts(docs.repartition(n)).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert found[0] == found[1]


def test_word_contexts_are_learnt(make_docs):
    """Texts from a word chain: the model tells them from the same words in another order, and half the perplexity
    of held-out texts is gone against add-one unigrams."""
    r = random.Random(8)
    vocabulary = [f"w{k}o" for k in range(300)]  # all end in one byte: only word contexts can tell them apart
    after = {w: r.sample(vocabulary, 4) for w in vocabulary}

    def chain():
        out = [r.choice(vocabulary)]
        while len(out) < 200:
            out.append(r.choice(after[out[-1]]))
        return out

    texts = [chain() for _ in range(300)]
    mixed = [r.sample(t, len(t)) for t in texts[:100]]
    docs = make_docs([" ".join(t) for t in texts]).unionByName(make_docs([" ".join(t) for t in mixed]).withColumn("doc_id", F.col("doc_id") + 100_000).filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2))
    found = pitman_yor.score_texts(docs, share=2000).collect()
    held = [x for x in found if x.held_out]
    per = lambda rows, c: 10 ** (-sum(x[c] for x in rows) / sum(x.n_tokens for x in rows))
    own, other = [x for x in held if x.doc_id < 100_000], [x for x in held if x.doc_id >= 100_000]
    assert len(own) > 20 and len(other) > 5
    assert per(own, "score") < 0.5 * per(own, "base_score")
    assert per(other, "score") > 5 * per(own, "score")


@pytest.mark.parametrize("n, p, d, s", [(2, 0.3, 0.5, 1.0), (6, 0.05, 0.3, 4.0), (7, 0.9, 0.8, 0.7)])
def test_exact_tables_against_all_seatings(n, p, d, s):
    """Table counts against the law summed over all set partitions of n customers."""
    import numpy as np

    law = np.zeros(n + 1)

    def seatings(sizes, weight):
        """All ways to seat the customers one by one, each with its probability times p for each table."""
        j = sum(sizes)
        if j == n:
            law[len(sizes)] += weight
            return
        for k, size in enumerate(sizes):
            seatings([*sizes[:k], size + 1, *sizes[k + 1 :]], weight * (size - d))
        seatings([*sizes, 1], weight * (s + d * len(sizes)) * p)

    seatings([], 1.0)
    law /= law.sum()
    tables = np.ones(200_000, np.int64)
    pitman_yor.exact_tables(tables, np.full(200_000, n), np.full(200_000, p), d, np.full(200_000, s), np.random.default_rng(2))
    assert np.abs(np.bincount(tables, minlength=n + 1) / 200_000 - law).max() < 0.005


def test_probabilities_sum_to_one():
    """Over the known words and the unknown one, in every context."""
    import numpy as np

    r = np.random.default_rng(3)
    cells, kinds = r.integers(1, 4, 30), np.array(pitman_yor.kind_of([pitman_yor.word_key(w) for w in (b"the", b"of")]))
    ctx = np.concatenate([np.sort(r.choice(259, n, replace=False)) for n in cells])
    state = pitman_yor.Seating(cells, ctx, r.integers(1, 90, len(ctx)), kinds)
    model = {"discount": [0.5, 0.5, 0.5], "base": 1 / 31}
    n = pitman_yor.FIRST_CONTEXT + len(kinds)
    for k in range(3):
        every = state.totals().astype(float)
        model |= {"customers": every[:n], "tables": every[n:]}
        if k < 2:
            state.sweep(model, r)
            again = pitman_yor.Seating(cells, ctx, state.count, kinds, state.pack())
            assert all((getattr(again, x) == getattr(state, x)).all() for x in ("tables", "kind_tables", "root_tables"))
    root, _ = state.probabilities(model)
    unknown = (1 + 0.5 * model["tables"][0]) * model["base"] / (1 + model["customers"][0])
    assert root.sum() + unknown == pytest.approx(1)
    assert (state.tables <= state.count).all() and (state.kind_tables <= state.kind_customers()).all() and (state.tables >= 1).all()


def test_a_buckets_seating_is_small():
    """A whole bucket of the largest size, a cell for every 45 bytes of text, takes a fraction of an executor's memory of each task."""
    import tracemalloc
    from types import SimpleNamespace

    import numpy as np
    import pyarrow as pa

    r = np.random.default_rng(8)
    names, each = [b"w%06d" % k for k in range(40_000)], 5
    contexts = SimpleNamespace(value=list(range(300)))
    kinds = np.array(pitman_yor.kind_of(contexts.value))
    ctx = np.sort(np.argsort(r.random((len(names), len(kinds))), axis=1)[:, :each], axis=1).astype("<u2")
    n_cells, chunks = ctx.size, 8
    own = [(range(k, len(names), chunks), ctx[k::chunks].copy()) for k in range(chunks)]
    schema = pa.schema([("bucket", pa.int32()), ("words", pa.list_(pa.binary())), ("cells", pa.list_(pa.int32())), ("ctx", pa.binary()), ("count", pa.binary())])
    given = [pa.RecordBatch.from_pylist([{"bucket": 3, "words": [names[i] for i in ks], "cells": [each] * len(ks), "ctx": c.tobytes(), "count": (1 + np.arange(c.size) % 7).astype("<i4").tobytes()}], schema=schema) for ks, c in own]
    peaks = []

    def watched(run, batches):
        tracemalloc.start()
        out = list(run(iter(batches)))
        peaks.append(tracemalloc.get_traced_memory()[1] / n_cells)
        tracemalloc.stop()
        return out

    model = watched(pitman_yor._combine(contexts), given)
    row = model[0].to_pylist()[0]
    assert row["sums"][:2] == [sum(int((1 + np.arange(c.size) % 7).sum()) for _, c in own), len(names)]
    n = pitman_yor.FIRST_CONTEXT + len(kinds)
    now = lambda x: {"customers": np.array(x[:n], float), "tables": np.array(x[n:], float), "discount": [0.5, 0.5, 0.5], "base": 1 / (len(names) + 1)}
    models = []
    for k in range(3):
        model = watched(pitman_yor._sweeper(SimpleNamespace(value=now(model[0].to_pylist()[0]["totals"])), contexts, k, k > 0), model)
        models.append(now(model[0].to_pylist()[0]["totals"]))
    row = model[0].to_pylist()[0]
    assert len(row["seats"]) == 3
    seated = {"group": 3, "part": 0, "is_model": True, "together": False, "chunk": None, "sizes": None, "doc": None, "tokens": None, **{c: row[c] for c in ("bucket", "words", "ctx", "cells", "count", "seats")}}
    told = dict.fromkeys(seated) | {"group": 3, "part": 0, "bucket": 3, "is_model": False, "together": False, "chunk": 1, "words": [names[5], b"new"], "sizes": [2, 1], "ctx": ctx[5][:2].tobytes() + b"\x07\x00", "doc": np.array([0, 1, 1], "<u2").tobytes(), "tokens": [2]}
    schema = pa.schema([*model[0].schema, ("group", pa.int32()), ("part", pa.int32()), ("together", pa.bool_()), ("is_model", pa.bool_()), ("chunk", pa.int64()), ("sizes", pa.list_(pa.int32())), ("doc", pa.binary()), ("tokens", pa.list_(pa.int64()))])
    schema = pa.schema([schema.field(c) for c in seated])
    (scored,) = watched(pitman_yor._scorer(SimpleNamespace(value=models), contexts, sum(row["sums"][:1]), len(names)), [pa.RecordBatch.from_pylist([x], schema=schema) for x in (seated, told)])
    sums = np.frombuffer(scored.column("part")[0].as_py(), pitman_yor.PART)
    assert sums["known"].tolist() == [1, 1]
    p = []
    for m, seats in zip(models, row["seats"]):  # the probability of names[5] in its first context, by hand
        state = pitman_yor.Seating(np.array(row["cells"]), np.frombuffer(row["ctx"], "<u2"), np.frombuffer(row["count"], "<i8"), kinds, seats)
        at = 5 * each
        _, kind = state.probabilities(m)
        c, t = m["customers"], m["tables"]
        place = pitman_yor.FIRST_CONTEXT + int(state.ctx[at])
        p.append((state.count[at] - 0.5 * state.tables[at] + (1 + 0.5 * t[place]) * kind[state.pair[at]]) / (1 + c[place]))
    assert sums["score"][0] == pytest.approx(np.log10(np.mean(p)))
    assert max(peaks) * pitman_yor.BUCKET / 45 < 300e6, peaks


def test_buckets_of_a_group_are_added_up(make_docs, monkeypatch):
    """Many buckets to a group, in several tasks: the same numbers as with a row of sums for each bucket."""
    docs = make_docs([*ODD, *[prose(200, 900 + k) for k in range(20)]])
    monkeypatch.setattr(pitman_yor, "BUCKETS", 3)
    monkeypatch.setattr(pitman_yor, "BUCKET", 12_000)
    monkeypatch.setattr(pitman_yor, "TASK_WORDS", 2_000)
    found = []
    for most, n in ((0, 4), (1000, 7)):
        monkeypatch.setattr(pitman_yor, "TASK_DOCS", most)
        found.append(sorted(tuple(r) for r in pitman_yor.score_texts(docs.repartition(n)).collect()))
    assert len(found[0]) == docs.count()
    for a, b in zip(*found, strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-12)


def test_tables_follow_the_process():
    """The mean number of tables is that of seating customers one by one."""
    import numpy as np

    rng = np.random.default_rng(1)
    n, p, d, s = 60, 0.3, 0.4, 2.0
    many = pitman_yor.seat(np.full(20_000, n), np.full(20_000, p), d, np.full(20_000, s), rng)
    t = np.ones(20_000)
    for j in range(1, n):
        a = (s + d * t) * p
        t += rng.random(20_000) < a / (a + j - d * t)
    assert abs(many.mean() - t.mean()) < 0.05 and abs(many.std() - t.std()) < 0.05


@pytest.mark.parametrize("many", [1, 4000])
def test_tables_follow_the_exact_law(many):
    """Their distribution is the one that seating one by one has; both ways of drawing."""
    import numpy as np

    n, p, d, s = 400, 0.5, 0.9, 3.0
    law = np.zeros(n + 1)
    law[1] = 1
    t = np.arange(n + 1)
    for j in range(1, n):
        a = (s + d * t) * p
        new = np.where(t <= j, a / (a + np.maximum(j - d * t, 0.01)), 0)
        law = law * (1 - new) + np.append(0, (law * new)[:-1])
    rng = np.random.default_rng(5)
    found = np.concatenate([pitman_yor.seat(np.full(many, n), np.full(many, p), d, np.full(many, s), rng) for _ in range(40_000 // many)])
    mean, std = (law * t).sum(), np.sqrt((law * t * t).sum() - (law * t).sum() ** 2)
    assert abs(found.mean() - mean) < 0.03 * std and abs(found.std() / std - 1) < 0.02


def test_scores_average_three_seatings():
    assert pitman_yor.SWEEPS - pitman_yor.BURN_IN >= 3


# ---- 10: decontamination


def brute_items(text, items, window=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(t))
    w, hit, ids = split(text), set(), set()
    for i, t in items:
        own = split(t)
        n = min(window, len(own))
        for g in {tuple(own[k : k + n]) for k in range(max(1, len(own) - window + 1))} if own else ():
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) == g:
                    hit |= set(range(k, k + n))
                    ids.add(i)
    return len(w), len(hit), sorted(ids)


@pytest.mark.parametrize("terms, block", [(decontaminate.MAX_TERMS, decontaminate.BLOCK_WORDS), (3, 20)])
def test_items_are_found(spark, make_docs, monkeypatch, terms, block):
    monkeypatch.setattr(decontaminate, "MAX_TERMS", terms)
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    items = [(1, prose(30, 201)), (2, prose(12, 202)), (3, "Zig, ZAG"), (4, None), (5, ""), (6, prose(12, 202)), (7, "never seen wordz")]
    part = " ".join(prose(30, 201).split()[5:20])
    texts = [*ODD, f"{prose(20, 1)} {part}! {prose(9, 4)}", prose(12, 202).upper() * 2, "zig zag zig zag", "zig\nzag", " ".join(part.split()[:9])]
    docs = make_docs(texts).withColumn("n_words", F.lit("clash")).withColumn("item_id", F.lit(1))
    found = decontaminate.find_items(docs, spark.createDataFrame(items, "item_id long, text string"))
    got = {r.doc_id: (r.n_words, r.hit, sorted(r["items"])) for r in found.withColumn("hit", decontaminate.words_in(F.col("spans"))).collect()}
    for i, t in enumerate(texts):
        assert got[i] == brute_items(t, items), i


def test_no_items_and_no_documents(spark, make_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert {len(r["items"]) for r in decontaminate.find_items(make_docs(["a b"]), none).collect()} == {0}
    assert decontaminate.find_items(make_docs([]), none).count() == 0


def test_proximity(spark, make_docs):
    items = spark.createDataFrame([(1, "alpha bravo charlie delta")], "item_id long, text string")
    docs = make_docs(["alpha bravo so charlie delta", "alpha x y z bravo charlie delta", "alpha bravo charlie delta"])
    found = lambda slop: [r.doc_id for r in decontaminate.find_items(docs, items, slop=slop).filter(F.size("items") > 0).orderBy("doc_id").collect()]
    assert found(0) == [2] and found(1) == [0, 2] and found(3) == [0, 1, 2]
