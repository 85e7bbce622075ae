import pytest
from pyspark.sql import functions as F

from cuelake.operators import guard, segment
from cuelake.streaming.machines import stream_clauses

SCHEMA = "stream_id string, seq long, text string, start_ms long, end_ms long, arrival_ms long"


def rows(words, starts=None, stream="s", batch=560):
    out = []
    for i, w in enumerate(words):
        start = starts[i] if starts else i * 300
        out.append((stream, i, w, start, start + 200, ((start + 200) // batch + 1) * batch + 60))
    return out


def closes(spark, words, starts=None):
    df = spark.createDataFrame(rows(words, starts), SCHEMA)
    return [(r.text, r.reason, r.new_row) for r in segment.segment_clauses(df).orderBy("id").collect()]


def test_one_word_sentence_waits(spark):
    assert closes(spark, "Yes. I think so.".split()) == [("Yes. I think so.", "punctuation", True)]


def test_pause_closes_three_words(spark):
    found = closes(spark, ["one", "two", "three", "four"], [0, 300, 600, 1150])
    assert found == [("one two three", "pause", True), ("four", "end", True)]


def test_only_a_long_gap_closes_a_short_clause(spark):
    found = closes(spark, ["one", "two", "three"], [0, 700, 1900])
    assert [f[0] for f in found] == ["one two", "three"]


def test_cut_after_the_last_comma(spark):
    words = [f"w{i}" + ("," if i == 9 else "") for i in range(25)]
    found = closes(spark, words)
    assert found[0][1] == "max_words" and found[0][0].endswith("w9,") and found[1][2] is False


def test_punctuation_alone_is_no_clause(spark):
    assert closes(spark, ["...", "!"]) == []


def test_empty(spark):
    assert segment.segment_clauses(spark.createDataFrame([], SCHEMA)).count() == 0
    assert segment.source_chunks(spark.createDataFrame([], SCHEMA)).count() == 0


def whole(words):
    """All rows of one stream through the machine without islands."""
    machine, out, open_, last = segment.Clauses(), [], [], None
    gap_end = None
    for w in words:
        now = w["arrival_ms"]

        def closed(event):
            nonlocal open_
            if event:
                if any(x["text"].isalnum() or any(c.isalnum() for c in x["text"]) for x in open_[: event[0]]):
                    out.append((" ".join(x["text"] for x in open_[: event[0]]), event[1]))
                open_ = open_[event[0] :]

        if last is not None and now != last:
            closed(machine.idle(now))
        word = {**w, "gap_ms": max(0, w["start_ms"] - gap_end) if gap_end is not None else 0, "punct": not any(c.isalnum() for c in w["text"]), "ends": w["text"][-1] in ".!?", "comma": w["text"][-1] == ","}
        gap_end = w["end_ms"]
        closed(machine.before(word, now))
        open_.append(word)
        closed(machine.add(word, now))
        if machine.open:
            machine.last = now
        last = now
    if open_:
        out.append((" ".join(x["text"] for x in open_), "end"))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_islands_change_nothing(spark, seed):
    import random

    r = random.Random(seed)
    at, data = 0, []
    for i in range(400):
        at += r.choice([250, 300, 300, 300, 600, 1300, 2500])
        data.append(("s", i, r.choice(["a", "bb", "c,", "d.", "ee", "ff"]), at, at + 200, ((at + 200) // 560 + 1) * 560 + 60))
    df = spark.createDataFrame(data, SCHEMA)
    found = [(c.text, c.reason) for c in segment.segment_clauses(df).orderBy("id").collect()]
    assert found == whole([dict(zip(("s", "seq", "text", "start_ms", "end_ms", "arrival_ms"), d)) for d in data])


def test_chunks_hold_all_words(spark):
    words = "one two three. four five, six seven".split()
    df = spark.createDataFrame(rows(words), SCHEMA)
    chunks = segment.source_chunks(df).orderBy("seq").collect()
    assert " ".join(c.text for c in chunks) == " ".join(words)
    assert chunks[0].new_row


def test_stream_equals_batch(spark, tmp_path):
    words = "one two three. four five six seven, eight nine ten eleven twelve. a b c d e".split() * 3
    df = spark.createDataFrame(rows(words), SCHEMA)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = stream_clauses(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), idle_ms=None)
    query = stream.writeStream.format("memory").queryName("clauses").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    got = [(r.id, r.text, r.reason, r.new_row) for r in spark.table("clauses").orderBy("id").collect()]
    batch = [(r.id, r.text, r.reason, r.new_row) for r in segment.segment_clauses(df).filter("reason <> 'end'").orderBy("id").collect()]
    assert got == batch and len(got) > 5


def test_loops():
    assert guard.keep_mask(["a"] * 4) == [True, False, False, False]
    assert guard.keep_mask(["a"] * 3) == [True] * 3
    assert guard.keep_mask("x a b a b a b y".split()) == [True, True, True, False, False, False, False, True]
    assert guard.keep_mask(["", "", "", ""]) == [True] * 4


def test_filler(spark):
    say = lambda t: spark.range(1).select(guard.is_filler(F.split(F.lit(t), " "))).first()[0]
    assert say("Thank you. Bye.") and say("Oh, oh.") and say("Subtitles by the community")
    assert not say("Thank you. See the report.") and not say("...")


def test_words_are_marked_once(spark):
    """Columns pass through the machine: no join back, which would clean and mark all words again."""
    df = spark.createDataFrame(rows("one two three. four".split()), SCHEMA).withColumn("more", F.col("seq") * 2)
    marked = segment.mark_clauses(df)
    assert "Join" not in marked._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.more, r.text, r.part) for r in marked.orderBy("seq").collect()] == [(0, "one", 0), (2, "two", 0), (4, "three.", 0), (6, "four", 1)]
