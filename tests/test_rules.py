"""Fixed cases of the lag, report, slot, session, and cue rules, against plain Python where they have a law."""

import random
from difflib import get_close_matches

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cuelake.functions import text as T
from cuelake.operators import cues, frames, guard, lag, lanes, ordered, reports, wer


def test_content_words_and_sentences(spark):
    df = spark.createDataFrame([("Don't tell the King's men, it isn't what I'd say", "Mr. Chen met Dr. Wu. Then Jr. Smith left at 5 p.m. Today. no cut.  Two spaces")], "a string, b string")
    r = df.select(T.content_words(F.col("a")).alias("w"), T.split_sentences(F.col("b")).alias("s")).first()
    assert r.w == ["dont", "tell", "kings", "men", "isnt", "id", "say"]
    assert r.s == ["Mr. Chen met Dr. Wu.", "Then Jr. Smith left at 5 p.m. Today. no cut.  Two spaces"]


def close(a, b):
    most = lag_limit(max(len(a), len(b)))
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row[-1] <= most


def lag_limit(n):
    return 0 if n <= 2 else 1 if n <= 7 else 2


def plain_count(target, shown):
    """From each place of the last word backwards."""
    best = 0
    for e, w in enumerate(shown):
        if target and close(w, target[-1]):
            n, at = 1, e
            for t in target[-2::-1]:
                found = [p for p in range(max(0, e - len(target) - 1), at) if close(shown[p], t)]
                if found:
                    n, at = n + 1, found[-1]
            best = max(best, n)
    return best


def test_match_count(spark):
    r = random.Random(2)
    words = ["alpha", "alpah", "bravo", "charlie", "charlye", "to", "ta", "delta"]
    rows = [([], ["a"]), (["a"], []), (["alpha", "bravo"], ["alpha", "x"]), (["alpha", "bravo"], ["bravo", "alpha", "bravo"])]
    rows += [([r.choice(words) for _ in range(r.randint(1, 5))], [r.choice(words) for _ in range(r.randint(0, 9))]) for _ in range(150)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "i int, a array<string>, b array<string>")
    got = {x.i: x.n for x in df.select("i", lag.match_count(F.col("a"), F.col("b")).alias("n")).collect()}
    assert [got[i] for i in range(len(rows))] == [plain_count(a, b) for a, b in rows]
    assert got[2] == 0 and got[3] == 2


def test_closest_lines(spark):
    shown = ["the cat sat", "a dog ran off", "", "something else", "the cat sat down"]
    wanted = ["the cat sat", "the cat sits", "dog ran", "zzzzz", ""]
    out = lag.exact_or_closest(spark.createDataFrame([("f", i, t) for i, t in enumerate(wanted)], "file string, line int, text string"), spark.createDataFrame([("f", t) for t in shown], "file string, text string"))
    for r in out.collect():
        best = get_close_matches(r.text, shown, n=1, cutoff=0.3)
        assert r.exact == (r.text in shown) and (r.exact or r.closest == (best[0] if best else None))


def test_failure_labels(spark):
    rows = [
        ("de", "full", "one two three", "", "x", "", "empty"), ("de", "full", "one two three", "eins", "x", "max", "capped:max"), ("de", "full", "one two", "eins\nzwei", "x", None, "commentary"),
        ("de", "full", "one two", "Übersetzung eins zwei", "x", "", "commentary"), ("de", "full", "One two three", "one two three", "x", "", "untranslated"), ("zh", "full", "One two three", "one two three", "x", "", None),
        ("de", "full", "one two", "one two", "x", "", None), ("de", "full", "one two three four five", "one two three four fünf", "x", "", "mostly-untranslated"),
        ("de", "full", "a b c", "eins zwei drei vier fünf sechs sieben", "x", "", "too-long"), ("de", "fragment", "go there now", "geh jetzt dort mal eben hin", "geh hin", "", "fragment-continued"),
        ("de", "full", "go there now", "geh jetzt dort mal eben hin", "geh hin", "", None),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, lang string, kind string, src string, out string, ref string, cap string, want string")
    assert [(r.i, r.label) for r in reports.label_failures(df).orderBy("i").collect()] == [(i, r[-1]) for i, r in enumerate(rows)]


def test_contained_texts_are_scored_without_counting(monkeypatch):
    pairs = [("[de] one two three", "one two three"), ("one", "someone else"), ("aaaa", "aa"), ("", "abc"), ("abc", ""), ("a b c", "a b c")]
    counted = [reports.chr_f("x" + a + "y", b + "z") for a, b in pairs]
    # the same by counting every n-gram
    from collections import Counter

    def plain(a, b):
        a, b, ps, rs = "".join(a.split()), "".join(b.split()), [], []
        for n in range(1, 7):
            h, r = (Counter(x[i : i + n] for i in range(len(x) - n + 1)) for x in (a, b))
            if h and r:
                ps.append(sum((h & r).values()) / sum(h.values()))
                rs.append(sum((h & r).values()) / sum(r.values()))
        p, r = (sum(x) / len(x) if x else 0.0 for x in (ps, rs))
        return 100 * 5 * p * r / (4 * p + r) if p + r else 0.0

    assert counted == [plain("x" + a + "y", b + "z") for a, b in pairs]
    wanted = [plain(a, b) for a, b in pairs]
    monkeypatch.setattr("collections.Counter", None)
    assert [reports.chr_f(a, b) for a, b in pairs] == wanted


def test_match_count_with_a_need(spark):
    """From the need on the count is that without it; below, it stays below, and hopeless places aren't followed to their end."""
    r = random.Random(8)
    words = "alpha beta gamma delta epsilon betta gama of".split()
    rows = [(i, [r.choice(words) for _ in range(r.randrange(7))], [r.choice(words) for _ in range(r.randrange(12))]) for i in range(600)]
    df = spark.createDataFrame(rows, "i long, a array<string>, b array<string>")
    need = F.when(F.size("a") <= 2, F.size("a")).otherwise(F.size("a") - 1)
    got = df.select(need.alias("need"), lag.match_count(F.col("a"), F.col("b")).alias("n"), lag.match_count(F.col("a"), F.col("b"), need).alias("m")).collect()
    assert all(x.m == x.n if x.n >= x.need else x.m < x.need for x in got) and any(x.m < x.n for x in got) and sum(x.n >= x.need > 2 for x in got) > 10


def test_frame_grid(spark):
    pts = [0, 3000, 6000, 6000, 3000, 12000, 12000 + 89 * 3000, 12000 + 300 * 3000, 12000 + 301 * 3000, 0]
    df = spark.createDataFrame([("s", 0, i, p) for i, p in enumerate(pts)], "stream_id string, session long, seq long, pts_90k long")
    got = [r.slot for r in frames.frame_grid(df).orderBy("seq").collect()]
    assert got == [0, 1, 2, 2, 1, 4, 93, 94, 95, 96]


def test_frame_grid_of_many_keys(spark):
    """A frame without a PTS starts anew, and so does the next one; batches hold many keys, and keys many batches."""
    rows = [(None if k == 7 else k, 0, i, None if i == 2 else (5 + i) * 3000) for k in range(3000) for i in range(4)] + [(5000, 1, i, i * 3000) for i in range(25_000)]
    df = spark.createDataFrame(rows, "stream_id long, session long, seq long, pts_90k long").repartition(7)
    found = frames.frame_grid(df).groupBy("stream_id").agg(F.sort_array(F.collect_list("slot")).alias("slots")).collect()
    assert {r.stream_id for r in found} == {k for k, *_ in rows}
    assert all(r.slots == list(range(25_000 if r.stream_id == 5000 else 4)) for r in found)


def test_sessions_go_on_across_the_wrap(spark):
    top = 1 << 33
    df = spark.createDataFrame([("s", i, p) for i, p in enumerate([top - 6000, top - 3000, 0, 3000, 900_000])], "stream_id string, seq long, pts_90k long")
    assert [r.session for r in frames.sessionize_pts(df).orderBy("seq").collect()] == [0, 0, 0, 0, 1]
    both = df.withColumn("kind", F.lit("video"))
    assert [r.session for r in frames.sessionize_av(both).orderBy("seq").collect()] == [0, 0, 0, 0, 1]


def test_blank_lines_show_nothing():
    t = cues.CueTrack(rows=2, max_chars=40, hold=100)
    assert t.line("one   two", True, 0) is None and t.line("  ", True, 50) is None
    assert t.line("", True, 150) == (0, 100, "one two") and t.line("x", True, 200) is None
    assert t.close(300) == (200, 300, "x")


def test_all_lanes_come_back_at_once():
    s = lanes.Shedding(["de", "fr"], "en", 1000, source_only=True)
    assert [x for t in range(0, 30_000, 1000) for x in s.decide(t, {"de": 2000 if t < 3000 else 0, "fr": 0})] == [("de", True), ("fr", True), ("fr", False), ("de", False)]


def test_loop_memory_begins_at_the_first_words_start():
    recent = [("a", 10.0), ("b", 15.0)]
    _, memory = guard.admit(recent, [("c", 42.0, 46.0)])
    assert memory == [("b", 15.0), ("c", 46.0)]


def plain_alignment(ref, hyp):
    """(cost, deletions) of the cheapest alignment with the fewest deletions."""
    row = [(j, 0) for j in range(len(hyp) + 1)]
    for i, x in enumerate(ref, 1):
        new = [(i, i)]
        for j, y in enumerate(hyp, 1):
            new.append(min((row[j - 1][0] + (x != y), row[j - 1][1]), (row[j][0] + 1, row[j][1] + 1), (new[j - 1][0] + 1, new[j - 1][1])))
        row = new
    return row[-1]


@pytest.mark.parametrize("cells", [1, 40, 1 << 20])
def test_alignments(monkeypatch, cells):
    """Pairs of any length side by side, null lists as empty ones, in groups of few cells."""
    monkeypatch.setattr(wer, "CELLS", cells)
    r = random.Random(4)
    pairs = [tuple([r.choice("abcde") for _ in range(r.choice([0, 1, 5, 12, 30]))] for _ in range(2)) for _ in range(150)] + [([], []), (None, ["a"]), (["a"], None)]
    refs, hyps = (pa.array(x, pa.list_(pa.string())) for x in zip(*pairs))
    found = wer.align_pairs(refs, hyps)
    assert [(int(x) >> wer.COST, int(x) % (1 << wer.COST)) for x in found] == [plain_alignment(a or [], b or []) for a, b in pairs]
    assert len(wer.align_pairs(refs[:0], hyps[:0])) == 0 and wer.align_pairs(refs.slice(7, 9), hyps.slice(7, 9)).tolist() == found[7:16].tolist()


def test_edits_and_kinds_agree(spark):
    r = random.Random(5)
    rows = [([r.choice("abcde") for _ in range(r.randint(0, 12))], [r.choice("abcde") for _ in range(r.randint(0, 12))]) for _ in range(40)]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    for x in df.select("a", "b", wer.word_edits(F.col("a"), F.col("b")).alias("edits"), wer.many_edits(F.col("a"), F.col("b")).alias("many"), wer.edit_kinds(F.col("a"), F.col("b")).alias("k")).collect():
        assert x.edits == x.many == x.k.sub + x.k["del"] + x.k.ins and x.k["del"] - x.k.ins == len(x.a) - len(x.b)


def test_ordered_streams_cross_batches(spark):
    """Each key has one machine, whatever the size of batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    words = spark.createDataFrame([(s, i, w, i * 300, i * 300 + 200, i // 4 * 1200 + 1260) for s in ("s", None, "t") for i, w in enumerate("a b no no no no no c d x y x y x y z".split())], "stream_id string, seq long, text string, start_ms long, end_ms long, arrival_ms long")
    small = guard.prune_loops(words).collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    key = lambda rows: sorted((str(r.stream_id), r.seq) for r in rows)
    assert key(small) == key(guard.prune_loops(words).collect()) and len(small) == 3 * len({r.seq for r in small})
    assert ordered.run_ordered(words.limit(0), ["stream_id"], ["seq"], guard.LoopPruner, words.schema).count() == 0
