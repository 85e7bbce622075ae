import json

import pytest
from pyspark.sql import functions as F

from cuelake.operators import agree, audio, cues, frames, joins, lanes, lag, masking, reports, stats, wer
from cuelake.sources import readers, sinks

LISTS = [("en", "damn", "block"), ("en", "zorp*", "block"), ("en", "bad word", "block"), ("en", "zorpina", "allow")]


def mask(spark, text, style):
    texts = spark.createDataFrame([(1, "en", text)], "id long, lang string, text string")
    return masking.mask_words(texts, spark.createDataFrame(LISTS, "lang string, entry string, list string"), style).first().text


@pytest.mark.parametrize("style, wanted", [("asterisks", "Oh ****, *** ****! zorpina ******"), ("first_letter", "Oh D***, b** ****! zorpina z*****"), ("bleep", "Oh [bleep], [bleep]! zorpina [bleep]"), ("drop", "Oh,! zorpina")])
def test_mask(spark, style, wanted):
    assert mask(spark, "Oh Dàmn, bad word! zorpina zorped", style) == wanted


def test_mask_leaves_others_alone(spark):
    assert mask(spark, "nothing  here .", "drop") == "nothing  here ."
    assert mask(spark, "", "bleep") == ""


def test_lane_texts(spark):
    texts = spark.createDataFrame([(1, "en", "fr", "damn ©"), (2, "xx", "en", "damn"), (3, "en", "fr", " ​ ")], "id long, lang string, source_lang string, text string")
    lists = spark.createDataFrame([*LISTS, ("fr", "zut", "block")], "lang string, entry string, list string")
    assert {r.id: r.text for r in masking.text_for_lane(texts, lists).collect()} == {1: "**** (c)", 2: "****"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_joins_plan_no_loops(spark):
    left = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 0.5)], "k string, id long, t double")
    right = spark.createDataFrame([("a", 1.0, 10), ("a", 5.0, 11), ("a", 5.0, 12), ("b", 0.0, 13)], "k string, u double, v long")
    out = joins.asof_join(left, right, ["k"], "t", "u", ["v"], tie="v")
    assert {r.id: r.v for r in out.collect()} == {1: 12, 2: None}
    first = joins.asof_join(left, right, ["k"], "t", "u", ["v"], tie="v", first_if_none=True)
    assert {r.id: r.v for r in first.collect()} == {1: 12, 2: 10}
    spans = spark.createDataFrame([("a", 7, 0.0, 1.0), ("a", 8, 4.0, 6.0)], "k string, s long, low double, high double")
    near = joins.range_join(right, spans, ["k"], "u", "low", "high", 2.0)
    assert sorted((r.s, r.v) for r in near.collect()) == [(7, 10), (8, 11), (8, 12)]
    for df in (out, near):
        assert "Cartesian" not in plan(df) and "NestedLoop" not in plan(df)


def test_summary_of_nothing(spark):
    row = stats.summary(spark.createDataFrame([], "v double"), "v").first()
    assert row.n == 0 and row.p95 == 0.0 and row.stddev == 0.0


@pytest.mark.parametrize("method, p50, p95", [("nearest", 50, 95), ("linear", 51, 95), ("floor_n", 51, 96), ("floor_n1", 50, 95), ("half_up", 50, 96)])
def test_percentile_rules(spark, method, p50, p95):
    row = stats.rank_percentiles(spark.range(1, 101).withColumn("v", F.col("id").cast("double")).withColumn("k", F.lit(1)), "v", ["k"], method, {"p50": 0.5, "p95": 0.95}).first()
    assert (row.p50, row.p95) == (p50, p95)


def tap(spark, rows):
    return spark.createDataFrame([("s", w, p, q, h) for w, p, q, h in rows], "stream_id string, wall_ns long, pts_90k long, seq long, tail_hash string")


def test_frames_match_across_the_wrap(spark):
    wrap = 1 << 33
    hashes = [f"{i + 1:016x}" for i in range(100)]
    one = tap(spark, [(i * 10**9, (wrap - 50 * 3000 + i * 3000) % wrap, i, hashes[i]) for i in range(100)])
    two = tap(spark, [(i * 10**9 + 5_000_000, (wrap - 50 * 3000 + i * 3000 + 90_000) % wrap, i, hashes[i]) for i in range(100) if i not in (7, 8, 9)])
    pairs = frames.match_frames(one, two)
    assert pairs.count() == 97 and {r.method for r in pairs.collect()} == {"hash"}
    assert frames.pts_offset_mode(frames.match_frames_hash(one, two)).first().offset == 90_000
    assert frames.delay_report(pairs).first().p50 == 5.0
    report = frames.match_report(one, two, pairs).first()
    assert (report.matched, report.unmatched_in, report.unmatched_out, report.duplicates) == (97, 3, 0, 0)


def test_frames_fall_back_to_pts(spark):
    none = "0" * 16
    one, two = tap(spark, [(i, i * 3000, i, none) for i in range(50)]), tap(spark, [(i + 5, i * 3000, i, none) for i in range(50)])
    pairs = frames.match_frames(one, two)
    assert pairs.count() == 50 and {r.method for r in pairs.collect()} == {"pts"}


def test_sample_clock(spark):
    f = spark.createDataFrame([("s", 0, 0, 1600), ("s", 10_000, 1600, 1600)], "stream_id string, start_ms long, first_sample long, n_samples long")
    s = spark.createDataFrame([("s", 800), ("s", 2400)], "stream_id string, sample long")
    assert sorted(r.at_ms for r in frames.sample_clock(s, f).collect()) == [50, 10_050]


def test_cues_are_clipped_to_segments(spark):
    c = spark.createDataFrame([("s", "en", 90_000, 360_000, "a<b")], "stream_id string, lang string, start long, end long, text string")
    s = spark.createDataFrame([("s", k, k * 180_000, (k + 1) * 180_000, 2.0) for k in range(3)], "stream_id string, seq long, seg_start long, seg_end long, dur double")
    assert sorted((r.seq, r.start, r.end) for r in cues.cue_overlap(c, s).collect()) == [(0, 90_000, 180_000), (1, 180_000, 360_000)]
    body = {r.seq: r.body for r in cues.vtt_segments(c, s, spark.createDataFrame([("en",)], "lang string")).collect()}
    assert body[0] == "WEBVTT\nX-TIMESTAMP-MAP=MPEGTS:0,LOCAL:00:00:00.000\n\n00:00:01.000 --> 00:00:02.000\na&lt;b\n"
    assert body[2].startswith("WEBVTT") and "-->" not in body[2]


def test_roll_up():
    t = cues.CueTrack(rows=2, max_chars=10, hold=100)
    assert t.line("ab", True, 0) is None
    assert t.line("cd", False, 50) == (0, 50, "ab")
    assert t.line("efgh ijkl", False, 60) == (50, 60, "ab cd")
    assert t.line("x", True, 500) == (60, 160, "ab cd\nefgh ijkl")
    assert t.lines == ["x"]


def test_calibration(spark):
    """Utterances shown exactly two seconds late are all found with that lag."""
    words = ["alpha bravo charlie", "delta echo foxtrot", "golf hotel india", "juliet kilo lima"]
    utts = spark.createDataFrame([("s", i, i * 10.0, i * 10.0 + 3, words[i % 4]) for i in range(40)], "stream_id string, utt long, start double, end double, text string")
    utts = lag.borrow_words(utts).withColumns({"loop": F.lit(0), "ref_end": F.col("end")})
    shown = utts.select("stream_id", (F.col("end") + 2).alias("start"), "text")
    row = lag.lag_summary(lag.utterance_appearance(utts, shown)).first()
    assert (row.matched, row.p50, row.max) == (40, 2.0, 2.0)


def test_borrowed_words(spark):
    utts = spark.createDataFrame([("s", 0, "alpha bravo charlie"), ("s", 1, "delta"), ("s", 2, "echo foxtrot golf")], "stream_id string, utt long, text string")
    found = {r.utt: r.target for r in lag.borrow_words(utts).collect()}
    assert found[1] == ["bravo", "charlie", "delta"] and len(found) == 3


def test_agreement():
    a = agree.Agreement(2)
    w = lambda t: [(x, i * 1.0, i + 0.5) for i, x in enumerate(t.split())]
    assert a.add(w("the quick brow"), 0.0, False) == []
    assert [x[0] for x in a.add(w("the quick brown fox"), 0.0, False)] == ["the", "quick"]
    assert [x[0] for x in a.add(w("the quick brown fox jumps"), 0.0, False)] == ["brown", "fox"]
    assert [x[0] for x in a.add(w("the quick brown fox jumps over"), 0.0, True)] == ["jumps", "over"]
    assert agree.skip_prefix(["a", "b"], ["a", "x", "c"]) == 2 and agree.skip_prefix([], ["a"]) == 0


def test_tokens_to_words(spark):
    t = spark.createDataFrame([("s", i, x, i * 0.1) for i, x in enumerate(["<s>", "▁Hel", "lo", " wor", "ld", "<e>", "x"])], "stream_id string, i long, token string, t double")
    assert [r.text for r in agree.group_tokens(t).orderBy("word").collect()] == ["Hello", "world", "x"]


def test_shedding():
    s = lanes.Shedding(["de", "fr"], "en", 4000)
    assert s.decide(0, {"de": 5000}) == [("de", True)]
    assert s.decide(1000, {"fr": 5000}) == []
    assert s.decide(3000, {"fr": 5000}) == [("fr", True)]
    assert s.decide(4000, {"en": 100}) == [] and s.decide(13_000, {"en": 100}) == []
    assert s.decide(14_000, {"en": 100}) == [("fr", False)]
    assert s.decide(15_000, {"en": 3000}) == []


def test_stale_and_paused(spark):
    clauses = spark.createDataFrame([("s", 1, 1000)], "stream_id string, id long, closed_ms long")
    t = spark.createDataFrame([("s", 1, "de", "x", 2000), ("s", 1, "fr", "x", 9000), ("s", 5, "de", "x", 2000), ("s", 1, "es", "x", 3000)], "stream_id string, clause_id long, lang string, text string, arrival_ms long")
    changes = spark.createDataFrame([("s", "es", 2500, True)], "stream_id string, lang string, changed_ms long, paused boolean")
    found = {(r.clause_id, r.lang): r["drop"] for r in lanes.drop_stale(t, clauses, changes).collect()}
    assert found == {(1, "de"): None, (1, "fr"): "stale", (5, "de"): "stale", (1, "es"): "paused"}


def test_routes(spark):
    m = spark.createDataFrame([("d", "es", ["fr"], False, False, 0), ("a", "es", ["en"], False, True, 1), ("b", "en", ["fr", "de"], False, True, 2)], "id string, source string, targets array<string>, is_default boolean, installed boolean, position long")
    pairs = spark.createDataFrame([("es", "fr"), ("es", "de"), ("fr", "es"), ("en", "de")], "source string, target string")
    assert {(r.source, r.target): r.hops for r in lanes.route_models(m, pairs).collect()} == {("es", "fr"): ["a", "b"], ("es", "de"): ["a", "b"], ("fr", "es"): None, ("en", "de"): ["b"]}


def test_catalogue(spark):
    kind = "id string, source string, targets array<string>, variant_of string, position long"
    base = spark.createDataFrame([("a", "en", ["de"], None, 0), ("b", "en", ["fr"], "a", 1)], kind)
    user = spark.createDataFrame([("a", "en", ["es"], "zzz", 0), ("c", "en", [], None, 1)], kind)
    rows, skipped = lanes.merge_catalogue(base, user)
    assert [(r.id, r.variant_of) for r in rows.collect()] == [("b", "a")]  # only a user's models go
    assert sorted((r.id, r.reason) for r in skipped.collect()) == [("a", "unknown variant"), ("c", "no targets")]


def test_chains_of_variants(spark):
    """A chain of 1,000, one that ends well, and a circle."""
    kind = "id string, source string, targets array<string>, variant_of string, position long"
    rows = [(f"x{k}", "en", ["de"], f"x{k - 1}", k) for k in range(1, 1001)] + [(f"y{k}", "en", ["de"], f"y{k - 1}" if k else "base", k) for k in range(300)] + [("p", "en", ["de"], "q", 0), ("q", "en", ["de"], "p", 1), ("r", "en", ["de"], "q", 2)]
    kept, skipped = lanes.merge_catalogue(spark.createDataFrame([("base", "en", ["de"], None, 0)], kind), spark.createDataFrame(rows, kind))
    assert {r.id for r in kept.collect()} == {"base", "p", "q", "r"} | {f"y{k}" for k in range(300)}
    assert {r.id for r in skipped.collect()} == {f"x{k}" for k in range(1, 1001)}


def test_word_errors(spark):
    pairs = spark.createDataFrame([("en", "the cat sat on the mat", "the cat sit on mat now"), ("en", "", "x")], "lang string, ref string, hyp string")
    row = wer.wer(pairs, ["lang"], kinds=True).first()
    assert (row.edits, row.n_ref, row.sub, row["del"], row.ins) == (3, 6, 3, 0, 0)
    assert wer.wer(pairs, ["lang"]).first().edits == 3


def test_levels_and_silence(spark):
    pcm = spark.createDataFrame([("s", [-32768, 32767]), ("s", [])], "stream_id string, samples array<short>")
    found = [(round(r.rms_dbfs, 3), r.peak_dbfs) for r in audio.level_windows(pcm).collect()]
    assert found[0] == (-0.0, 0.0) and found[1] == (-100.0, -100.0)
    quiet = spark.createDataFrame([("s", k * 250, -90.0) for k in range(1, 49)], "stream_id string, end_ms long, rms_dbfs double")
    last = audio.silence_meter(quiet).orderBy(F.desc("end_ms")).first()
    assert (last.silent_s, last.alert) == (12.0, True)


def test_reframe(spark):
    pcm = spark.createDataFrame([("s", 0, list(range(1000))), ("s", 62, list(range(1000, 2000))), ("s", 500, [1, 2])], "stream_id string, start_ms long, samples array<short>")
    out = audio.reframe_pcm(pcm).orderBy("start_ms").collect()
    assert [(r.start_ms, len(r.samples)) for r in out] == [(0, 1600), (100, 400), (500, 2)] and out[0].samples == list(range(1600))


def test_pcm_bytes(spark):
    good, bad = audio.decode_pcm(spark.createDataFrame([(1, bytearray(b"\x01\x00\xff\xff")), (2, bytearray(b"\x01"))], "id long, body binary"))
    assert good.first().samples == [1, -1] and bad.count() == 1


def test_translate(spark):
    texts = spark.createDataFrame([(1, "de", "One. Two."), (2, "de", "x" * 5000), (3, "fr", "")], "id long, lang string, text string")
    out = {r.id: (r.out, r.error) for r in reports.translate(texts, lambda: lambda ts, lang: [f"<{t}>" for t in ts]).collect()}
    assert out == {1: ("<One.> <Two.>", None), 2: (None, "too long"), 3: (None, "empty")}


def test_translate_keeps_other_columns(spark):
    """Long numbers beside nulls, more rows than are Python objects at the same time."""
    n = 600 * reports.SPREAD // 16
    big = F.when(F.col("id") % 2 == 0, F.lit((1 << 60) + 1) + F.col("id"))
    rows = spark.range(n).select("id", F.lit("de").alias("lang"), F.lit("a b").alias("text"), big.alias("big"))
    out = reports.translate(rows, lambda: lambda texts, lang: list(texts)).select("id", "big", "out").collect()
    assert {(r.id, r.big, r.out) for r in out} == {(k, None if k % 2 else (1 << 60) + 1 + k, "a b") for k in range(n)} and len(out) == n


def test_char_f():
    assert reports.chr_f("abc", "abc") == pytest.approx(100) and reports.chr_f("abc", "xyz") == 0 and reports.chr_f("", "") == 0


def test_failures_by_label(spark):
    labelled = spark.createDataFrame([("r", "de", "empty"), ("r", "de", "empty"), ("r", "de", None), ("r", "de", "too-long"), ("r", "fr", None)], "run string, lang string, label string")
    assert [(x.run, x.lang, x.labels) for x in reports.failures_by_label(labelled).collect()] == [("r", "de", {"empty": 2, "too-long": 1})]
    runs = spark.createDataFrame([("r", lang, "1", 1, 5.0, 2.0, None, 3, "") for lang in ("de", "fr")], "run string, lang string, id string, line long, ms double, req_ms double, ttft_ms double, n_out int, cap string")
    assert {x.lang: x.labels for x in reports.mt_run_report(runs, labelled).collect()} == {"de": {"empty": 2, "too-long": 1}, "fr": {}}


def test_routes_share_the_first_hop(spark):
    def make():
        def run(texts, model):
            if model == "bad":
                return ["" for _ in texts]
            return [f"{model}({t})" for t in texts]

        return run

    routes = spark.createDataFrame([("es", "en", ["a"]), ("es", "de", ["a", "b"]), ("es", "fr", ["a", "c"]), ("es", "it", ["d"]), ("pt", "en", ["bad"]), ("pt", "de", ["bad", "b"]), ("es", "pl", None)], "source string, target string, hops array<string>")
    rows = [(1, "es", ["en", "de", "fr", "it", "pl", "de"], "hola"), (None, "pt", ["en", "de"], "x"), (2, "es", ["de"], None), (2, "es", [], "y"), (3, "es", ["it"], "z" * 5000)]
    requests = spark.createDataFrame(rows, "id long, source string, langs array<string>, text string")
    found = {(r.id, r.lang): (r.via, r.out, r.error) for r in reports.translate_routes(requests, routes, make, ["id"]).collect()}
    assert found == {
        (1, "en"): (None, "a(hola)", None), (1, "de"): ("en", "b(a(hola))", None), (1, "fr"): ("en", "c(a(hola))", None), (1, "it"): (None, "d(hola)", None), (1, "pl"): (None, None, "no route"),
        (None, "en"): (None, None, "empty"), (None, "de"): ("en", None, "empty"), (2, "de"): ("en", None, "too long"), (3, "it"): (None, None, "too long"),
    }


def test_a_busy_language_is_many_tasks(spark):
    rows = spark.range(400).select(F.col("id"), F.lit("de").alias("lang"), F.lit("a b").alias("text"))
    spark.conf.set("spark.sql.adaptive.enabled", False)
    out = reports.translate(rows, lambda: lambda texts, lang: list(texts)).select(F.spark_partition_id().alias("p")).distinct().count()
    spark.conf.set("spark.sql.adaptive.enabled", True)
    assert out > 1 and reports.translate(rows.limit(0), lambda: None).count() == 0


def test_settings_of_any_depth(spark):
    def nested(depth, leaf, turn):
        body = {"leaf": leaf, "list": [{"b": 1, "a": 2}], "none": None, "empty": {}}
        for k in range(depth):
            body = {"z": k, "in": body} if turn else {"in": body, "z": k}
        return json.dumps({k: body[k] for k in sorted(body, reverse=turn)})

    kind = "id long, settings string"
    before = spark.createDataFrame([(1, nested(12, "x", True)), (2, nested(12, 1, True)), (3, None), (4, "broken {"), (5, '{"a": {}}'), (6, '{"a": "1", "l": [{"x": 1, "y": 2}]}')], kind)
    after = spark.createDataFrame([(1, nested(12, "x", False)), (2, nested(12, 2, False)), (3, None), (4, "{}"), (5, '{"a": {"b": 1}}'), (6, '{"l": [{"y": 2, "x": 1}], "a": 1}')], kind)
    found = {(r.id, r.path, r.old, r.new) for r in stats.changed_settings(before, after, ["id"]).collect()}
    assert found == {(2, "in." * 12 + "leaf", "1", "2"), (5, "a", "{}", None), (5, "a.b", None, "1"), (6, "a", "1", "1")}


def test_context_stops_at_another_document(spark):
    rows = [("f", i, d, t) for i, (d, t) in enumerate([("A", "1"), ("A", "2"), ("B", "3"), ("A", "4"), ("A", "5"), (None, "6"), (None, "7")])]
    df = spark.createDataFrame(rows, "file string, i long, doc string, text string")
    found = {r.i: r.context for r in stats.previous_context(df, 2, ["i"], by=["file"]).collect()}
    assert found == {0: [], 1: ["1"], 2: [], 3: [], 4: ["4"], 5: [], 6: ["6"]}


def test_changed_settings(spark):
    a = spark.createDataFrame([(1, '{"a":{"b":1,"c":[1,2]},"d":"x"}')], "id long, settings string")
    b = spark.createDataFrame([(1, '{"a":{"b":2,"c":[1,2]},"e":"y"}')], "id long, settings string")
    assert {(r.path, r.old, r.new) for r in stats.changed_settings(a, b, ["id"]).collect()} == {("a.b", "1", "2"), ("d", "x", None), ("e", None, "y")}


def test_readers(spark, tmp_path):
    (tmp_path / "t.csv").write_text("wallclock_ns,pts,seq,hash\n1,,2,zz\n5,6,7,ab\nbad\nx,1,2,3\n")
    rows, bad = readers.read_tap(spark, str(tmp_path / "t.csv"))
    assert sorted((r.wall_ns, r.pts_90k, r.seq, r.tail_hash) for r in rows.collect()) == [(1, None, 2, "0" * 16), (5, 6, 7, "0" * 14 + "ab")] and bad.first().bad == 2
    (tmp_path / "w.tsv").write_text("word\tt0\tt1\temit\nhi\t0.5\t0.7\t1.0\n")
    assert readers.read_words(spark, str(tmp_path / "w.tsv"), "engine").collect() == [("w", "hi", 500, 700, 1.0)]
    (tmp_path / "s.srt").write_text("1\r\n00:00:01,000 --> 00:00:02,500 x\r\n<i>a</i>\r\n{b}c\r\n\r\n2\n00:00:00,500 --> 00:00:00,900\nz\n")
    assert [(r.start, r.end, r.text) for r in readers.read_srt(spark, str(tmp_path / "s.srt")).collect()] == [(0.5, 0.9, "z"), (1.0, 2.5, "a c")]
    (tmp_path / "p.m3u8").write_text("#EXTM3U\n#EXT-X-TARGETDURATION:2\n#EXT-X-MEDIA-SEQUENCE:7\n#EXTINF:2.0,\na.ts\nb.ts\n#EXTINF:1.5,\nc.ts\n")
    assert sorted((r.seq, r.dur, r.uri) for r in readers.read_playlist(spark, str(tmp_path / "p.m3u8")).collect()) == [(7, 2.0, "a.ts"), (9, 1.5, "c.ts")]
    (tmp_path / "seg.tsv").write_text("0.0\t1.0\ta\tb\nx\t1\t2\n")
    assert [r.text for r in readers.read_segments(spark, str(tmp_path / "seg.tsv")).collect()] == ["a\tb"]


def test_writers(spark, tmp_path):
    bodies = spark.createDataFrame([("s", "one\ntwo")], "stream_id string, body string")
    sinks.write_bodies(bodies, str(tmp_path / "b"), ["stream_id"])
    assert spark.read.text(str(tmp_path / "b"), wholetext=True).first().value == "one\ntwo\n"
    pairs = spark.createDataFrame([("s", 1, 1, 0, 0, 5, 1.23456)], "stream_id string, in_seq long, out_seq long, in_pts long, out_pts long, in_wall_ns long, delay_ms double")
    sinks.write_pairs(pairs, str(tmp_path / "p"))
    assert spark.read.option("header", True).csv(str(tmp_path / "p")).first().delay_ms == "1.235"
