"""Translation runs, failures, caption sets, soak and run reports."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import in_caption_charset, split_sentences
from ..sources.staging import staged
from .ranks import nearest, with_ranks
from .stats import rank_percentiles

SCRIPT = ("the", "quick", "brown", "fox", "jumps", "over")


def stub_translate(text: Column, lang: Column) -> Column:
    """A stand-in for a model."""
    return F.concat(F.lit("["), lang, F.lit("] "), text)


def stub_words(frame: Column) -> Column:
    """One of six scripted words for each audio frame."""
    return F.element_at(F.array(*[F.lit(w) for w in SCRIPT]), (F.pmod(frame, F.lit(len(SCRIPT))) + 1).cast("int"))


#: Tasks that the requests of one language or model are dealt over.
SPREAD = 64
#: Requests of an Arrow batch that are Python objects at the same time.
TOGETHER = 256


def translate(requests: DataFrame, make: Callable[[], Callable], text: str = "text", most_bytes: int = 4096, deadline_s: float = 2.0, by: str = "lang") -> DataFrame:
    """G1: ``requests`` with ``out``, ``error`` and ``elapsed_ms``. ``make()`` is called once in each Python worker and gives a
    function from (texts, value of the column ``by``) to texts. Texts are cut into sentences, which are translated
    together and joined again. What is null or too long, comes back empty, or is late is an error row. Requests of one
    language are dealt over ``SPREAD`` tasks, so that a busy one isn't a task of its own and workers meet few of them."""
    plain = [c for c in requests.columns if requests.schema[c].dataType.typeName() not in ("map", "variant")]
    deal = F.pmod(F.xxhash64(*plain), F.lit(SPREAD))
    given = requests.withColumn("__s", F.when(F.octet_length(text) <= most_bytes, split_sentences(F.col(text)))).repartition(F.col(by), deal)
    own = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in requests.schema)
    loaded: list = []

    def one(sentences, model) -> tuple[str | None, str | None, int]:
        if sentences is None:
            return None, "too long", 0
        began = time.monotonic()
        out = " ".join(x for x in loaded[0](list(sentences), model) if x).strip() if len(sentences) else ""
        took = int((time.monotonic() - began) * 1000)
        error = "empty" if not out else "late" if took > deadline_s * 1000 else None
        return None if error else out, error, took

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                if not loaded:
                    loaded.append(make())
                done = zip(*[one(s, m) for s, m in zip(part.column("__s").to_pylist(), part.column(by).to_pylist())])
                kept = [c for c in part.schema.names if c != "__s"]
                made = [pa.array(x, t) for x, t in zip(done, (pa.string(), pa.string(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *made], names=[*kept, "out", "error", "elapsed_ms"])

    return given.mapInArrow(run, f"{own}out string, error string, elapsed_ms long")


def translate_routes(requests: DataFrame, routes: DataFrame, make: Callable[[], Callable], key: list[str], most_bytes: int = 4096, deadline_s: float = 2.0) -> DataFrame:
    """G1 with J13 and J14: ``requests(key.., source, langs, text)`` by the hops of ``routes(source, target, hops)``: a row for each
    wanted language with ``via``, ``out``, ``error``, ``elapsed_ms`` of all its hops. ``make()`` gives a function from
    (texts, model).

    The first hop to English is translated once for a clause, for all languages beyond it and for English itself, and
    written; second hops join its result. An error of the first hop is that of every language behind it. A language without
    a route is an error row, and so is the text's own language."""
    wanted = requests.select(*key, "source", "text", F.explode(F.array_distinct("langs")).alias("lang"))
    planned = wanted.join(routes.select("source", F.col("target").alias("lang"), "hops"), ["source", "lang"], "left").withColumn("n", F.coalesce(F.size("hops"), F.lit(0)))
    planned = staged(planned, "planned")
    # one request for each clause and first model: direct ones, and the shared hop to English
    first = planned.filter("n > 0").select(*key, "text", F.col("hops")[0].alias("model"), F.when(F.col("n") == 1, F.col("lang")).otherwise("en").alias("into")).dropDuplicates([*key, "model", "into"])
    one = staged(translate(first, make, "text", most_bytes, deadline_s, by="model").drop("text"), "first-hops")
    done = one.withColumnsRenamed({"out": "out1", "error": "error1", "elapsed_ms": "ms1"})
    same = [F.col(f"p.{k}").eqNullSafe(F.col(f"d.{k}")) for k in key] + [F.col("p.hops")[0] == F.col("d.model"), F.when(F.col("p.n") == 1, F.col("p.lang")).otherwise("en") == F.col("d.into")]
    met = planned.filter("n > 0").alias("p").join(done.alias("d"), reduce(lambda a, b: a & b, same)).select("p.*", "d.out1", "d.error1", "d.ms1")
    direct = met.filter("n = 1").select(*key, "source", "lang", F.lit(None).cast("string").alias("via"), F.col("out1").alias("out"), F.col("error1").alias("error"), F.col("ms1").alias("elapsed_ms"))
    second = met.filter("n = 2 and error1 is null").select(*key, "source", "lang", F.col("hops")[1].alias("model"), F.col("out1").alias("text"), "ms1")
    pivot = translate(second, make, "text", most_bytes, deadline_s, by="model").select(*key, "source", "lang", F.lit("en").alias("via"), "out", "error", (F.col("ms1") + F.col("elapsed_ms")).alias("elapsed_ms"))
    failed = met.filter("n = 2 and error1 is not null").select(*key, "source", "lang", F.lit("en").alias("via"), F.lit(None).cast("string").alias("out"), F.col("error1").alias("error"), F.col("ms1").alias("elapsed_ms"))
    none = planned.filter("n = 0").select(*key, "source", "lang", F.lit(None).cast("string").alias("via"), F.lit(None).cast("string").alias("out"), F.lit("no route").alias("error"), F.lit(0).cast("long").alias("elapsed_ms"))
    return direct.unionByName(pivot).unionByName(failed).unionByName(none)


def char_f(a: Column, b: Column, order: int = 6, beta: float = 2.0) -> Column:
    """Character n-gram F score (0 to 100) of a hypothesis against a reference, white space left out."""

    @F.pandas_udf("double")
    def score(hyp: pd.Series, ref: pd.Series) -> pd.Series:
        return pd.Series([chr_f(x or "", y or "", order, beta) for x, y in zip(hyp, ref)])

    return score(a, b)


def chr_f(hyp: str, ref: str, order: int = 6, beta: float = 2.0) -> float:
    from collections import Counter

    hyp, ref, ps, rs = "".join(hyp.split()), "".join(ref.split()), [], []
    whole = hyp in ref or ref in hyp  # then every n-gram of the shorter one is met, and none has to be counted
    for n in range(1, order + 1):
        a, b = len(hyp) - n + 1, len(ref) - n + 1
        if a > 0 and b > 0:
            if whole:
                same = min(a, b)
            else:
                h, r = (Counter([x[i : i + n] for i in range(k)]) for x, k in ((hyp, a), (ref, b)))
                same = sum(min(c, r[g]) for g, c in h.items() if g in r)
            ps.append(same / a)
            rs.append(same / b)
    p, r = (sum(x) / len(x) if x else 0.0 for x in (ps, rs))
    return 100 * (1 + beta**2) * p * r / (beta**2 * p + r) if p + r else 0.0


#: Words by which a model comments on its work.
COMMENTARY = r"(?iU)\b(translation|translated|note:|here is|nota:|traducción|traduction|übersetzung|tradução)\b"


def label_failures(runs: DataFrame) -> DataFrame:
    """A16 of ``runs(lang, kind, src, out, ref, cap)``: ``label`` of each translation, the first that fits; null if none.
    Chinese, which has no spaces, is exempt from what counts words against the source."""
    strip = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"^\s+|\s+$", "")
    n = lambda c: F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))
    rows = runs.withColumns({"__s": strip("src"), "__o": strip("out"), "__r": strip("ref")}).withColumn("__f", char_f(F.col("__o"), F.col("__s")))
    src, out, ref = F.col("__s"), F.col("__o"), F.col("__r")
    spaced, cap = F.col("lang") != "zh", F.coalesce(F.col("cap"), F.lit(""))
    label = (
        F.when(out == "", "empty").when(cap != "", F.concat(F.lit("capped:"), cap)).when(out.rlike("\n") | out.rlike(COMMENTARY), "commentary")
        .when(spaced & (F.lower(out) == F.lower(src)) & (n(src) > 2), "untranslated").when(spaced & (F.col("__f") > 75) & (n(src) > 3), "mostly-untranslated")
        .when(spaced & (n(out) / F.greatest(n(src), F.lit(1)) > 2.2) & (n(src) >= 3), "too-long").when((F.col("kind") == "fragment") & (ref != "") & (n(out) > n(ref) + 3), "fragment-continued")
    )
    return rows.withColumn("label", label).drop("__f", "__s", "__o", "__r")


def failures_by_label(labelled: DataFrame) -> DataFrame:
    """Per run and language ``labels``, a map from label to the number of translations with it, of what
    :func:`label_failures` gives."""
    counts = labelled.filter("label is not null").groupBy("run", "lang", "label").agg(F.count("*").alias("n"))
    return counts.groupBy("run", "lang").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("label", "n")))).alias("labels"))


def mt_run_report(runs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """Per run and language n, percentiles of times, request times (the last record of each id), output tokens per
    second, caps; with ``labelled`` the failures by label too (an empty map where there are none)."""
    by = ["run", "lang"]
    main = rank_percentiles(runs, "ms", by, "linear", {"p50": 0.5, "p95": 0.95, "max": 1.0})
    first = rank_percentiles(runs, "ttft_ms", by, "linear", {"ttft_p50": 0.5}).drop("n")
    last = runs.filter("req_ms is not null").withColumn("__k", F.row_number().over(Window.partitionBy(*by, "id").orderBy(F.desc("line")))).filter("__k = 1")
    request = rank_percentiles(last, "req_ms", by, "linear", {"req_p50": 0.5, "req_p95": 0.95, "req_max": 1.0}).drop("n")
    rate = runs.groupBy(*by).agg((1000 * F.sum("n_out") / F.sum("ms")).alias("tokens_per_s"), F.count_if(F.col("cap") != "").alias("capped"))
    out = reduce(lambda a, b: a.join(b, by, "left"), (first, request, rate), main)
    if labelled is None:
        return out
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))
    return out.join(failures_by_label(labelled), by, "left").withColumn("labels", F.coalesce("labels", none))


def charset_coverage(texts: DataFrame, by: str = "lang", text: str = "text", kind: str = "608") -> DataFrame:
    """Per language the characters, the share that the caption set has, and the most frequent of the others."""
    chars = texts.select(by, F.explode(F.split(text, "")).alias("ch")).filter("ch <> ''").groupBy(by, "ch").agg(F.count("*").alias("n"))
    rows = chars.withColumn("ok", in_caption_charset(F.col("ch"), kind))
    lacking = F.when(~F.col("ok"), F.struct((-F.col("n")).alias("k"), F.col("ch")))
    return rows.groupBy(by).agg(F.sum("n").alias("chars"), (F.sum(F.when(F.col("ok"), F.col("n")).otherwise(0)) / F.sum("n")).alias("covered"), F.array_join(F.transform(F.slice(F.sort_array(F.array_compact(F.collect_list(lacking))), 1, 10), lambda x: x["ch"]), "").alias("unsupported"))


def rtf(runs: DataFrame) -> DataFrame:
    """Real-time factor and worst backlog of each run (``compute_s, audio_s, now_s, fed_s``)."""
    return runs.groupBy("run").agg((F.sum("compute_s") / F.sum("audio_s")).alias("rtf"), F.max(F.col("now_s") - F.col("fed_s")).alias("backlog_s"))


def soak_blocks(rows: DataFrame, value: str, at: str, minutes: int = 10, counters: list[str] = (), sessions: str | None = None) -> DataFrame:
    """Per stream and block of time n, p50, p99 and max of ``value``, its first and last, growth of counters, and
    the number of sessions."""
    blocks = rows.withColumn("block", F.window(at, f"{minutes} minutes")["start"])
    more = {f"{c}_delta": F.max(c) - F.min(c) for c in counters} | ({"sessions": F.count_distinct(sessions)} if sessions else {})
    plain = {"rows": F.count("*"), "max": F.max(value), "first": F.min_by(value, at), "last": F.max_by(value, at), **more}
    out = with_ranks(blocks, value, ["stream_id", "block"], {"p50": nearest(0.5), "p99": nearest(0.99)}, plain)
    return out.select("stream_id", "block", F.col("rows").alias("n"), "p50", "p99", "max", "first", "last", *more)


def junk_rate(emitted: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """Words put out on recordings without speech."""
    return emitted.groupBy(*by).agg(F.count("*").alias("lines"), F.sum(F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))).alias("words"))


def run_summary(runs: DataFrame, parts: dict[str, DataFrame]) -> DataFrame:
    """One row for each run with the columns of all parts, null where a part has none."""
    return reduce(lambda a, p: a.join(p[1].withColumnsRenamed({c: f"{p[0]}_{c}" for c in p[1].columns if c != "run"}), "run", "left"), parts.items(), runs)


