import pytest
from pyspark.sql import functions as F

from cuelake.functions import text as T
from cuelake.functions import times


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()[0]


@pytest.mark.parametrize("given, wanted", [("a  b\t\tc", "a b c"), ("“hi” — ok…", '"hi" - ok...'), ("x​\U0001F600y", "xy"), ("½ ° ¿ «", "½ ° ¿ «"), ("œuvre €5 ©", "oeuvre EUR5 (c)"), ("", "")])
def test_clean(spark, given, wanted):
    assert one(spark, T.clean(F.col("t")), t=given) == wanted


@pytest.mark.parametrize("given, wanted", [("PÉDÉ", "pede"), ("Straße æ œ", "strasse ae oe"), ("Łódź", "lodz")])
def test_fold(spark, given, wanted):
    assert one(spark, T.fold(F.col("t")), t=given) == wanted


def test_sentences_keep_abbreviations(spark):
    assert one(spark, T.split_sentences(F.col("t")), t="Mr. Chen left. He came back! ¿Qué? yes") == ["Mr. Chen left.", "He came back!", "¿Qué? yes"]


@pytest.mark.parametrize("given, wanted", [(["Yes", ",", "no", "."], "Yes, no."), (["¿", "Qué", "?"], "¿Qué?"), (["你", "好"], "你好"), ([], "")])
def test_join_words(spark, given, wanted):
    words = F.array(*[F.lit(w) for w in given]) if given else F.array().cast("array<string>")
    assert spark.range(1).select(T.join_words(words)).first()[0] == wanted


def test_wrap(spark):
    assert one(spark, T.wrap_lines(F.col("t"), 10), t="one two  three\nabcdefghijkl m") == ["one two", "three", "abcdefghij", "kl m"]


def test_entry_problems(spark):
    for entry, wanted in (("ok*", None), ("a b-c", None), ("***", "every word needs at least one letter or digit besides *"), ("a/b", "use letters, digits, spaces, ', - and * only"), (" ", "entry is empty")):
        assert one(spark, T.entry_problem(F.col("t")), t=entry) == wanted


def test_word_equality(spark):
    for a, b, wanted in (("ab", "ac", False), ("abcd", "abxd", True), ("abcdefgh", "abxxefgh", True), ("abcd", "axxd", False)):
        assert one(spark, T.word_eq(F.col("a"), F.col("b")), a=a, b=b) is wanted


def test_urls(spark):
    assert one(spark, T.redact_url(F.col("t")), t="rtmp://h/app/secret") == "rtmp://h/app/***"
    assert one(spark, T.redact_url(F.col("t")), t="srt://h:1?streamid=a&x=1") == "srt://h:1?streamid=***&x=1"


def test_clocks(spark):
    assert one(spark, times.srt_time(F.col("s")), s=3723.4567) == "01:02:03,457"
    assert one(spark, times.vtt_time(F.col("s")), s=90 * 3723456) == "01:02:03.456"
    assert one(spark, times.parse_time(F.col("s")), s="01:02:03,5") == 3723.5
    assert one(spark, times.parse_time(F.col("s")), s="nonsense") is None
    assert one(spark, times.pts_diff(F.col("a"), F.col("b")), a=5, b=(1 << 33) - 5) == 10
    assert one(spark, times.unwrap_near(F.col("a"), F.col("b")), a=5, b=(1 << 33) - 5) == (1 << 33) + 5
    assert one(spark, times.dbfs(F.col("a")), a=0.0) == -100.0


def test_plain_captions(spark):
    rows = [("Łódź – Šibenik…\nœuvre € 5 ♪ 日本 ÿ„x“\t",), (None,), ("",), ("plain [ok] ^ \\\\",)]
    df = spark.createDataFrame(rows, "t string")
    found = [r.p for r in df.select(T.plain_caption(F.col("t")).alias("p")).collect()]
    assert found == ["Lódz - Sibenik...\noeuvre EUR 5 ♪  y\"x“", None, "", rows[3][0]]
    assert df.select(T.plain_caption(F.col("t"), "708").alias("p")).first().p == "Lódz - Šibenik…\nœuvre EUR 5 ♪  ÿ\"x“"


def test_joined_words_are_glued_ones(spark):
    """The text is that of gluing word by word, and the expression doesn't go through the text so far."""
    import random

    from pyspark.sql import functions as F

    from cuelake.functions import text as T

    r = random.Random(5)
    rows = [([r.choice(["a", "Bc", ",", "«", "(", "x(", "」", "日", "本a", "¿", "...", "", "-", " "]) for _ in range(r.randint(0, 12))],) for _ in range(400)] + [(None,), (["a", None, "b"],), ([],)]
    df = spark.createDataFrame(rows, "w array<string>").select(T.join_words(F.col("w")).alias("one"), F.aggregate("w", F.lit(""), T.glue).alias("two"))
    assert all(x.one == x.two for x in df.collect())
    assert "aggregate(" not in df.select("one")._jdf.queryExecution().optimizedPlan().toString()


def test_clean_by_one_character(spark):
    """Each character alone and between others is kept, dropped or made a space as its class says; a space costs no match."""
    codes = [*range(0x3100), *range(0xD7F0, 0xD800), *range(0xE000, 0xE010), *range(0xF8F0, 0xFB10), *range(0xFDF0, 0x10010), *range(0x1EFF0, 0x1FB10), *range(0xDFFF0, 0xE0090)]
    df = spark.createDataFrame([(f"a {chr(c)} b{chr(c)}{chr(c)}c {chr(c)}",) for c in codes], "t string")
    plain = F.translate("t", "".join(x for _, x in T.ONE_TO_ONE), "".join(y * len(x) for y, x in T.ONE_TO_ONE))
    plain = F.regexp_replace(T._replace(plain, T.ONE_TO_MANY), T.WHITE, " ")
    plain = F.trim(F.regexp_replace(F.regexp_replace(plain, T.DROPPED, ""), " {2,}", " "))
    assert df.filter(~T.clean(F.col("t")).eqNullSafe(plain)).count() == 0
    assert "(?![ -~])" in df.select(T.clean(F.col("t")))._jdf.queryExecution().toString()
