"""Quality rules with thresholds that adapt to each language and source.

Signals are computed inside each row from built-in functions alone. Their distribution is kept as a mergeable
quantile sketch: a log-linear histogram of (language, source, signal, bucket, count) rows whose buckets keep the
seven leading bits of a value, so any quantile is within 1/64 of the true value. Sketches merge by adding counts:
sources merge into languages, languages into the whole.

A signal's fence is a high quantile of the group's documents that pass the base rule, and beyond it a multiple of that
quantile's distance from the median (a small least distance gives groups of equal values some room). A group's
fences are drawn to its language's, and those to the fences of all documents, as if the wider group had added
``PRIOR`` documents: a small group borrows nearly all, a large one nearly nothing, and no size switches anything.

Windows of eight words are compared by a 64-bit hash within one document (a false repeat in a document of a
million words has a chance of about 1 in 40 million).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, let, materialize, text_words

#: Documents' weight of the wider group in the fences of a group.
PRIOR = 200
#: Signal, quantile, reach beyond it (times its distance from the median), least distance, whether low values are
#: rejected too. In thousandths. The two shares of repeats are zero in nearly all documents, so a quantile further out
#: tells what their group is used to.
SIGNALS = (("mean_word_length", 0.9, 3, 50, True), ("symbol_share", 0.9, 3, 5, False), ("dup_line_share", 0.99, 2, 10, False), ("repeat_share", 0.99, 2, 10, False))
#: The table of fences is broadcast if it has no more groups than this.
BROADCAST_GROUPS = 20_000
WINDOW = 8


def repeat_words(words: Column, n: int = WINDOW) -> Column:
    """Words in n-word windows that are found twice or more in the array, the first one included."""

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        repeated = let(pairs, lambda p: F.transform(p, lambda x, k: F.when((x.h == F.get(p, k - 1).h) | (x.h == F.get(p, k + 1).h), x.i)))
        starts = F.sort_array(F.array_compact(repeated))
        return let(starts, lambda s: F.aggregate(F.transform(s, lambda x, k: F.least(F.lit(n), F.coalesce(F.get(s, k + 1) - x, F.lit(n)))), F.lit(0), lambda a, x: a + x))

    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.xxhash64(F.slice(words, i, n)))
    found = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0)))
    return F.when(F.size(words) > n, found).otherwise(F.lit(0)).cast("long")


def base_signals(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` with word_chars, n_words, n_symbols, n_lines, n_dup_lines and n_repeat_words."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(*keep, t.alias("__t"), text_words(F.col(text)).alias("__w"))
    lines = F.filter(F.split("__t", "\n"), lambda x: x.rlike(r"[^\x09-\x0D\x20]"))
    return rows.select(
        *keep,
        F.size("__w").cast("long").alias("n_words"),
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        (F.length("__t") - F.length(F.regexp_replace("__t", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("__l"),
        repeat_words(F.col("__w")).alias("n_repeat_words"),
    ).select(*keep, "n_words", "word_chars", "n_symbols", F.col("__l.n").alias("n_lines"), F.col("__l.dup").alias("n_dup_lines"), "n_repeat_words")


#: Columns that score_quality adds.
OWN = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", *(n for n, *_ in SIGNALS), "base_failed", "kept")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _share(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.floor(1000 * F.col(part) / F.col(whole))).otherwise(0).cast("long")


def signal_values() -> dict[str, Column]:
    return {"mean_word_length": _share("word_chars", "n_words"), "symbol_share": _share("n_symbols", "word_chars"), "dup_line_share": _share("n_dup_lines", "n_lines"), "repeat_share": _share("n_repeat_words", "n_words")}


def bucket(value: Column) -> Column:
    """Lower edge of the sketch's bucket: all but the seven leading bits are zero."""
    step = F.pow(F.lit(2.0), F.greatest(F.length(F.bin(value)) - 7, F.lit(0))).cast("long")
    return value - value % step


def sketch(signals: DataFrame, keys: list[str]) -> DataFrame:
    """Quantile sketches of the documents that pass the base rule: keys, signal, bucket, n (0 where only others are).
    Sum ``n`` to merge them."""
    each = F.array(*[F.struct(F.lit(name).alias("signal"), bucket(F.col(name)).alias("bucket")) for name, *_ in SIGNALS])
    passes = F.when(base_failed(), 0).otherwise(1)
    return signals.select(*keys, passes.alias("p"), F.explode(each).alias("x")).groupBy(*keys, "x.signal", "x.bucket").agg(F.sum("p").alias("n"))


def fences(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Per key one row: the number of documents and for each signal the lowest and highest value that passes."""
    merged = sketches.groupBy(*keys, "signal", "bucket").agg(F.sum("n").alias("n"))
    by = Window.partitionBy(*keys, "signal")
    run = merged.withColumns({"up_to": F.sum("n").over(by.orderBy("bucket")), "docs": F.sum("n").over(by)})
    quantile = F.create_map(*[F.lit(x) for name, q, *_ in SIGNALS for x in (name, q)])[F.col("signal")]
    at = lambda q: F.min(F.when(F.col("up_to") >= F.ceil(q * F.col("docs")), F.col("bucket")))
    quantiles = run.withColumn("q", quantile).groupBy(*keys, "signal").agg(F.max("docs").alias("docs"), at(F.lit(0.5)).alias("mid"), at(F.col("q")).alias("high"), at(1 - F.col("q")).alias("low"))
    out = [F.max("docs").alias("docs")]
    for name, _, reach, least, both in SIGNALS:
        mine = F.col("signal") == name
        out += [F.max(F.when(mine, F.col("high") + reach * F.greatest(F.col("high") - F.col("mid"), F.lit(least)))).alias(f"{name}_max")]
        if both:
            out += [F.max(F.when(mine, F.col("low") - reach * F.greatest(F.col("mid") - F.col("low"), F.lit(least)))).alias(f"{name}_min")]
    return quantiles.groupBy(*keys).agg(*out)


def _drawn(docs: str, own: str, wider: Column, prior: int) -> Column:
    """A fence drawn to the wider group's, which counts as ``prior`` documents."""
    return (F.col(docs).cast("double") * F.col(own).cast("double") + F.lit(float(prior)) * wider) / (F.col(docs).cast("double") + F.lit(float(prior)))


def score_quality(docs: DataFrame, keep: list[str], lang: str = "lang", source: str = "source", prior: int = PRIOR) -> DataFrame:
    """The columns ``keep`` of all documents with their base signals, ``base_failed`` and ``kept``.

    ``kept`` is false for documents that fail the base rule or lie outside a fence of their group. Null texts and
    texts of white space have no words and fail; null languages and sources are groups of their own; very long texts
    are judged whole, like any other; values that tie with a fence pass; equal rows get equal verdicts; an empty table
    gives an empty table. ``prior`` is the weight of the wider group in a group's fences. Columns that aren't asked for don't matter; of those that are, one with the name of a new
    column is replaced."""
    if prior <= 0:
        raise ValueError("a group without documents needs the wider group's fences")
    keep = [c for c in keep if c not in OWN]
    given = docs.select(*[F.col(c) for c in keep], F.struct(F.col(lang).alias("lang"), F.col(source).alias("source")).alias("__g"), F.col("text").alias("__text"))
    rows = base_signals(given, [*keep, "__g"], "__text").withColumns(signal_values())
    rows = materialize(rows, "quality-signals")  # read twice below
    sketches = sketch(rows, ["__g"])
    by_group = fences(sketches, ["__g"])
    by_lang = fences(sketches.withColumn("__lang", F.struct("__g.lang")), ["__lang"])
    every = fences(sketches.withColumn("__one", F.lit(1)), ["__one"])
    names = [c for c in every.columns if c.endswith(("_max", "_min"))]
    merged = by_group.withColumns({"__lang": F.struct("__g.lang"), "__one": F.lit(1)})
    merged = merged.join(by_lang.select("__lang", *[F.col(c).alias(f"l_{c}") for c in ["docs", *names]]), "__lang").join(every.select("__one", *[F.col(c).alias(f"a_{c}") for c in names]), "__one")
    # every group lies in a wider one, so the joins lose none
    drawn = [_drawn("docs", c, _drawn("l_docs", f"l_{c}", F.col(f"a_{c}").cast("double"), prior), prior).alias(f"__{c}") for c in names]
    merged = materialize(merged.select("__g", *drawn), "quality-fences")
    if merged.count() <= BROADCAST_GROUPS:
        merged = F.broadcast(merged)
    inside = F.lit(True)
    for name, *_, both in SIGNALS:
        inside &= F.col(name) <= F.col(f"__{name}_max")
        if both:
            inside &= F.col(name) >= F.col(f"__{name}_min")
    return rows.join(merged, "__g").withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & inside).drop("__g", *[f"__{c}" for c in names])


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_quality(documents(spark, sf_dir), ["doc_id"])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql() -> str:
    """The same in DuckDB's SQL; rows are numbered because ids may repeat."""
    value = lambda a, b: f"CASE WHEN {b} > 0 THEN CAST(floor(1000 * {a} / {b}) AS BIGINT) ELSE 0 END"
    values = {"mean_word_length": value("word_chars", "n_words"), "symbol_share": value("n_symbols", "word_chars"), "dup_line_share": value("n_dup_lines", "n_lines"), "repeat_share": value("n_repeat_words", "n_words")}
    v = "CAST(v AS BIGINT)"
    step = f"CAST(pow(2, greatest(length(bin({v})) - 7, 0)) AS BIGINT)"
    level = "CASE signal " + " ".join(f"WHEN '{n}' THEN CAST({q} AS DOUBLE)" for n, q, *_ in SIGNALS) + " END"
    fence = []
    for name, own in (("g", "lang, source"), ("l", "lang"), ("a", "one")):
        fence.append(f"{name}_m AS (SELECT {own}, signal, bucket, sum(n) AS n FROM (SELECT *, 1 AS one FROM sk) GROUP BY ALL)")
        fence.append(f"{name}_r AS (SELECT *, {level} AS q, sum(n) OVER (PARTITION BY {own}, signal ORDER BY bucket) AS up_to, sum(n) OVER (PARTITION BY {own}, signal) AS docs FROM {name}_m)")
        at = lambda q: f"min(bucket) FILTER (WHERE up_to >= ceil({q} * CAST(docs AS DOUBLE)))"
        fence.append(f"{name}_q AS (SELECT {own}, signal, max(docs) AS docs, {at('CAST(0.5 AS DOUBLE)')} AS mid, {at('q')} AS high, {at('(1 - q)')} AS low FROM {name}_r GROUP BY ALL)")
        out = []
        for signal, _, reach, least, both in SIGNALS:
            out.append(f"max(high + {reach} * greatest(high - mid, {least})) FILTER (WHERE signal = '{signal}') AS {signal}_max")
            if both:
                out.append(f"max(low - {reach} * greatest(mid - low, {least})) FILTER (WHERE signal = '{signal}') AS {signal}_min")
        fence.append(f"{name} AS (SELECT {own}, max(docs) AS docs, {', '.join(out)} FROM {name}_q GROUP BY ALL)")
    drawn = lambda t, c, wider: f"((CAST({t}.docs AS DOUBLE) * CAST({t}.{c} AS DOUBLE) + CAST({PRIOR} AS DOUBLE) * {wider}) / (CAST({t}.docs AS DOUBLE) + CAST({PRIOR} AS DOUBLE)))"
    pick = lambda c: drawn("g", c, drawn("l", c, f"CAST(a.{c} AS DOUBLE)"))
    inside = " AND ".join(f"s.{n} <= {pick(n + '_max')}" + (f" AND s.{n} >= {pick(n + '_min')}" if both else "") for n, *_, both in SIGNALS)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, list_filter(string_split_regex(text, '[\x09-\x0D\x20]+'), lambda x: x <> '') AS w FROM d),
i AS (SELECT rid, unnest(generate_series(1, len(w) - {WINDOW - 1})) AS i, w FROM w WHERE len(w) > {WINDOW}),
h AS (SELECT rid, i, list_slice(w, i, i + {WINDOW - 1}) AS h FROM i),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, h) AS n FROM h) WHERE n > 1),
c AS (SELECT rid, sum(least({WINDOW}, gap)) AS n FROM (SELECT rid, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, {WINDOW}) AS gap FROM r) GROUP BY rid),
b AS (SELECT d.rid, doc_id, lang, source, CAST(len(w.w) AS BIGINT) AS n_words, CAST(length(array_to_string(w.w, '')) AS BIGINT) AS word_chars,
        CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x09-\x0D\x20]')) AS lines,
        CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
      FROM d JOIN w USING (rid) LEFT JOIN c USING (rid)),
e AS (SELECT *, len(lines) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
        n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b),
s AS (SELECT *, {', '.join(f'{x} AS {n}' for n, x in values.items())} FROM e),
x AS ({' UNION ALL '.join(f"SELECT lang, source, base_failed, '{n}' AS signal, {n} AS v FROM s" for n, *_ in SIGNALS)}),
sk AS (SELECT lang, source, signal, {v} - {v} % {step} AS bucket, count(*) FILTER (WHERE NOT base_failed) AS n FROM x GROUP BY ALL),
{', '.join(fence)}
SELECT s.doc_id, s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words, s.base_failed,
       NOT s.base_failed AND {inside} AS kept
FROM s JOIN g ON s.lang IS NOT DISTINCT FROM g.lang AND s.source IS NOT DISTINCT FROM g.source
JOIN l ON s.lang IS NOT DISTINCT FROM l.lang CROSS JOIN a"""


OP1_SQL = _sql()
