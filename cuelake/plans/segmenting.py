"""Queries of the word and clause operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import guard, masking, segment
from ..functions import text as T
from .tables import WORDS_SQL, dealt, staged, table, word_lists, words


def clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.segment_clauses(words(spark, sf_dir))


def clause_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses of each stream by reason, with the words that masking hides."""
    found = staged(clauses(spark, sf_dir), "clauses")
    texts = found.select(F.struct("stream_id", "id").alias("key"), F.lit("en").alias("lang"), F.lit("fr").alias("source_lang"), "text")
    masked = masking.text_for_lane(texts, word_lists(spark), key="key").groupBy(F.col("key.stream_id").alias("stream_id")).agg(F.sum("n_masked").alias("masked"))
    return segment.clause_stats(found).join(masked, "stream_id", "left").withColumn("masked", F.coalesce("masked", F.lit(0)))


_FOLD = f"replace(replace(replace(translate(lower(w), '{''.join(T.FOLDED.values())}', '{''.join(k * len(v) for k, v in T.FOLDED.items())}'), 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe')"

#: A stream word by word: the open clause, the close before a word (timer or pause), and the one that it brings about.
CLAUSES_CTE = f"""
{WORDS_SQL},
g AS MATERIALIZED (SELECT stream_id, seq, arrival_ms AS now, coalesce(greatest(start_ms - lag(greatest(start_ms, end_ms)) OVER (PARTITION BY stream_id ORDER BY seq), 0), 0) AS gap,
        regexp_matches(text, '[.!?。！？…][»)\\]"''”’」』）》]*$') AS ends,
        struct_pack(seq := seq, t := text, s := start_ms, e := end_ms, p := NOT regexp_matches(text, '[\\p{{L}}\\p{{N}}]'), c := regexp_matches(text, '[,，、][»)\\]"''”’」』）》]*$')) AS word FROM words),
r AS (
  SELECT stream_id, CAST(-1 AS BIGINT) AS seq, CAST([] AS STRUCT(seq BIGINT, t VARCHAR, s BIGINT, e BIGINT, p BOOLEAN, c BOOLEAN)[]) AS open, CAST(NULL AS BIGINT) AS last, CAST(NULL AS BIGINT) AS now,
         CAST([] AS STRUCT(seq BIGINT, t VARCHAR, s BIGINT, e BIGINT, p BOOLEAN, c BOOLEAN)[]) AS w1, CAST(NULL AS VARCHAR) AS e1, CAST(NULL AS BIGINT) AS a1,
         CAST([] AS STRUCT(seq BIGINT, t VARCHAR, s BIGINT, e BIGINT, p BOOLEAN, c BOOLEAN)[]) AS w2, CAST(NULL AS VARCHAR) AS e2, CAST(NULL AS BIGINT) AS a2 FROM (SELECT DISTINCT stream_id FROM words)
  UNION ALL
  SELECT stream_id, seq, open2[n2 + 1:], CASE WHEN len(open2) > n2 THEN now ELSE last END, now,
         CASE WHEN e1 IS NULL THEN open[1:0] ELSE open END, e1, CASE e1 WHEN 'timer' THEN last + wait WHEN 'pause' THEN now END, open2[1:n2], e2, CASE WHEN n2 > 0 THEN now END
  FROM (SELECT *, CASE e2 WHEN 'punctuation' THEN len(open2) WHEN 'max_words' THEN coalesce(list_max(list_filter(range(3, len(open2)), lambda k: open2[k].c)), len(open2)) ELSE 0 END AS n2
    FROM (SELECT *, CASE WHEN ends AND len(list_filter(open2, lambda w: NOT w.p)) >= 3 THEN 'punctuation' WHEN len(list_filter(open2, lambda w: NOT w.p)) >= 24 THEN 'max_words' END AS e2
      FROM (SELECT *, list_append(CASE WHEN e1 IS NULL THEN open ELSE open[1:0] END, word) AS open2
        FROM (SELECT *, CASE WHEN len(open) = 0 THEN NULL WHEN before <> now AND now - last > wait THEN 'timer' WHEN gap >= 350 AND (spoken >= 3 OR gap >= 1000) THEN 'pause' END AS e1
          FROM (SELECT r.stream_id, g.seq, r.open, r.last, r.now AS before, g.now, g.gap, g.ends, g.word, len(list_filter(r.open, lambda w: NOT w.p)) AS spoken,
                       CASE WHEN len(list_filter(r.open, lambda w: NOT w.p)) >= 3 THEN 800 ELSE 1000 END AS wait
                FROM r JOIN g ON g.stream_id = r.stream_id AND g.seq = r.seq + 1)))))),
z AS (SELECT stream_id, w1 AS w, e1 AS reason, a1 AS closed_ms FROM r WHERE e1 IS NOT NULL UNION ALL SELECT stream_id, w2, e2, a2 FROM r WHERE e2 IS NOT NULL
      UNION ALL SELECT stream_id, open, 'end', now FROM r WHERE len(open) > 0 QUALIFY row_number() OVER (PARTITION BY stream_id ORDER BY seq DESC) = 1 AND seq = (SELECT max(seq) FROM g WHERE g.stream_id = r.stream_id)),
n AS (SELECT z.*, g.gap AS next_gap_ms, coalesce(lag(reason) OVER (PARTITION BY z.stream_id ORDER BY w[1].seq) <> 'max_words', true) AS new_row FROM z LEFT JOIN g ON g.stream_id = z.stream_id AND g.seq = w[-1].seq + 1),
clauses AS (SELECT stream_id, row_number() OVER (PARTITION BY stream_id ORDER BY w[1].seq) - 1 AS id, array_to_string(list_transform(w, lambda x: x.t), ' ') AS text, w[1].s AS start_ms, w[-1].e AS end_ms,
                   len(w) AS n_words, new_row, reason, closed_ms, next_gap_ms FROM n WHERE len(list_filter(w, lambda x: NOT x.p)) > 0)"""
CLAUSES_SQL = f"WITH RECURSIVE {CLAUSES_CTE} SELECT * FROM clauses"
CLAUSE_STATS_SQL = rf"""
WITH RECURSIVE {CLAUSES_CTE},
f AS (SELECT *, list_transform(regexp_extract_all(text, '[\p{{L}}\p{{N}}]+'), lambda w: {_FOLD}) AS f FROM clauses),
h AS (SELECT *, len(list_filter(range(1, len(f) + 1), lambda i: (f[i] = 'of' AND f[i + 1] = 'the') OR (f[i] = 'de' AND f[i + 1] = 'la')
         OR ((f[i] = 'the' OR starts_with(f[i], 'ha')) AND f[i] <> 'hand' AND NOT (i > 1 AND f[i] = 'the' AND f[i - 1] = 'of')) OR ((f[i] = 'le' OR starts_with(f[i], 'eau')) AND f[i] <> 'eaux'))) AS masked FROM f)
SELECT stream_id, count(*) FILTER (WHERE reason = 'punctuation') AS punctuation, count(*) FILTER (WHERE reason = 'pause') AS pause, count(*) FILTER (WHERE reason = 'timer') AS timer,
       count(*) FILTER (WHERE reason = 'max_words') AS max_words, count(*) FILTER (WHERE reason = 'end') AS end, count(*) AS total,
       count(*) FILTER (WHERE reason = 'timer' AND next_gap_ms >= 350) AS timer_at_pause, CAST(sum(masked) AS BIGINT) AS masked FROM h GROUP BY stream_id"""


#: A chunk ends with its arrival, at a clause's end, and before a pause that closes one.
CHUNKS_SQL = f"""
WITH RECURSIVE {CLAUSES_CTE},
k AS (SELECT r.stream_id, r.seq, g.word.t AS t, r.now AS came, coalesce(r.e2 IS NOT NULL OR lead(r.e1) OVER w = 'pause', false) AS flush, lead(r.now) OVER w AS next, z.reason AS closed
      FROM r JOIN g USING (stream_id, seq) LEFT JOIN z ON z.stream_id = r.stream_id AND z.w[-1].seq = r.seq WHERE r.seq >= 0 WINDOW w AS (PARTITION BY r.stream_id ORDER BY r.seq)),
e AS (SELECT *, flush OR next IS NULL OR next <> came AS fin, CASE WHEN flush AND closed IS NULL THEN 'max_words' ELSE closed END AS cut FROM k),
c AS (SELECT *, coalesce(sum(CAST(fin AS INTEGER)) OVER (PARTITION BY stream_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk FROM e),
d AS (SELECT stream_id, CAST(chunk AS BIGINT) AS seq, string_agg(t, ' ' ORDER BY seq) AS text, max(CASE WHEN fin THEN cut END) AS cut, max(came) AS at_ms FROM c GROUP BY stream_id, chunk)
SELECT stream_id, seq, text, seq = 0 OR coalesce(lag(cut) OVER (PARTITION BY stream_id ORDER BY seq) <> 'max_words', false) AS new_row, at_ms FROM d"""


def source_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.source_chunks(words(spark, sf_dir))


def pruned_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guard.prune_loops(words(spark, sf_dir)).groupBy("stream_id").agg(F.count("*").alias("n_words"))


def mask_documents(style: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """F1 over whole texts."""
        docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", "text")
        return masking.mask_words(dealt(docs), word_lists(spark), style).select(F.col("id").alias("doc_id"), F.md5("text").alias("text_md5"), "n_masked")

    return run


_SHOWN = {
    "asterisks": ("repeat('*', length(t[i]))", "s[i] || repeat('*', length(t[i]))"),
    "first_letter": ("t[i][1] || repeat('*', length(t[i]) - 1)", "s[i] || repeat('*', length(t[i]))"),
    "bleep": ("'[bleep]'", "''"),
    "drop": ("''", "''"),
}


def mask_sql(style: str) -> str:
    """The word lists written out; no second word of a phrase begins another one."""
    first, second = _SHOWN[style]
    body = "array_to_string(list_transform(range(1, len(t) + 1), lambda i: CASE WHEN i > 1 AND h[i - 1] = 2 THEN {b} WHEN h[i] > 0 THEN s[i] || {a} ELSE s[i] || t[i] END), '') || s[len(t) + 1]".format(a=first, b=second)
    if style == "drop":
        body = rf"rtrim(regexp_replace(regexp_replace(regexp_replace({body}, '^ +', ''), ' {{2,}}', ' ', 'g'), ' ([,.!?;:])', '\1', 'g'), ' ')"
    return rf"""
WITH d AS (SELECT doc_id, lang, text, regexp_extract_all(text, '[\p{{L}}\p{{N}}]+') AS t, string_split_regex(text, '[\p{{L}}\p{{N}}]+') AS s FROM documents),
f AS (SELECT *, list_transform(t, lambda w: {_FOLD}) AS f FROM d),
p AS (SELECT *, list_transform(range(1, len(f) + 1), lambda i: (lang = 'en' AND f[i] = 'of' AND f[i + 1] = 'the') OR (lang = 'fr' AND f[i] = 'de' AND f[i + 1] = 'la') OR (lang = 'de' AND f[i] = 'in' AND f[i + 1] = 'der')) AS p FROM f),
h AS (SELECT *, list_transform(range(1, len(f) + 1), lambda i: CASE WHEN p[i] THEN 2 WHEN i > 1 AND p[i - 1] THEN 0
        WHEN (lang = 'en' AND (f[i] = 'the' OR starts_with(f[i], 'ha')) AND f[i] <> 'hand') OR (lang = 'fr' AND (f[i] = 'le' OR starts_with(f[i], 'eau')) AND f[i] <> 'eaux')
          OR (lang = 'de' AND (f[i] = 'die' OR starts_with(f[i], 'zu'))) OR (lang = 'es' AND (f[i] = 'el' OR starts_with(f[i], 'de'))) THEN 1 ELSE 0 END) AS h FROM p),
n AS (SELECT *, coalesce(len(list_filter(h, lambda x: x > 0)), 0) AS n FROM h)
SELECT doc_id, md5(CASE WHEN n = 0 THEN text ELSE {body} END) AS text_md5, CAST(n AS BIGINT) AS n_masked FROM n"""


def guard_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the first words of turns as decoder segments."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.clean("text").alias("text"))
    w = F.split("text", " ")
    reason = guard.reject_reason(w, (F.length("text") % 10) / 10.0, -(F.length("text") % 13) / 10.0, 0.6, -1.0)
    return turns.select("conv_id", "turn", reason.alias("reason"))


GUARD_SQL = r"""
SELECT conv_id, turn, CASE WHEN (length(t) % 10) / 10.0 > 0.6 THEN 'no_speech' WHEN -(length(t) % 13) / 10.0 < -1.0 THEN 'low_confidence' END AS reason
FROM (SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM conversations)"""


def guard_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as decoder segments, some of them filler, some with a word that loops at the end."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("k"), T.clean("text").alias("text"))
    said = F.when(F.col("k") % 5 == 1, "Thank you. Bye bye!").when(F.col("k") % 5 == 4, F.concat("text", F.lit(" no no no no no no"))).otherwise(F.col("text"))
    rows = turns.select("conv_id", F.split(said, " ").alias("words"), ((F.length("text") % 10) / 10.0).alias("no_speech"), (-(F.length("text") % 13) / 10.0).alias("avg_logprob"))
    return guard.guard_report(rows, ["conv_id"])


GUARD_COUNTS_SQL = r"""
WITH t AS (SELECT conv_id, turn % 5 AS k, length(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS n FROM conversations),
w AS (SELECT *, CASE WHEN (n % 10) / 10.0 > 0.6 THEN 'no_speech' WHEN -(n % 13) / 10.0 < -1.0 THEN 'low_confidence' WHEN k = 1 THEN 'filler' END AS why FROM t)
SELECT conv_id, count(*) AS segments, count(*) FILTER (WHERE why = 'no_speech') AS no_speech, count(*) FILTER (WHERE why = 'low_confidence') AS low_confidence, count(*) FILTER (WHERE why = 'filler') AS filler,
       CAST(coalesce(sum(5) FILTER (WHERE why IS NULL AND k = 4), 0) AS BIGINT) AS loop_words FROM w GROUP BY 1"""


def plain_captions(kind: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """T21 over whole texts."""
        return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.plain_caption(F.col("text"), kind)).alias("text_md5"))

    return run


def plain_captions_sql(kind: str) -> str:
    letters, plain, longer, shown = T.caption_tables(kind)
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    body = f"translate(text, {quoted(letters)}, {quoted(plain)})"
    for a, b in longer:
        body = f"replace({body}, {quoted(a)}, {quoted(b)})"
    return f"SELECT doc_id, md5(regexp_replace({body}, {quoted(f'[^{shown}]')}, '', 'g')) AS text_md5 FROM documents"


def loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F5 and F6 over turns."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", guard.drop_annotations(F.split("text", r"\s+")).alias("words"))
    return guard.collapse_loops(turns, "words").select("conv_id", "turn", F.size("words").cast("long").alias("n_words"), "n_looped")


def word_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1."""
    from ..operators.stats import gap_to_previous

    return gap_to_previous(words(spark, sf_dir), ["stream_id"], ["seq"]).groupBy("stream_id").agg(F.max("gap_ms").alias("max_gap_ms"), F.count_if(F.col("gap_ms") >= 350).alias("pauses"), F.count("*").alias("n_words"))


WORD_GAPS_SQL = f"""
WITH {WORDS_SQL}
SELECT stream_id, CAST(max(gap) AS BIGINT) AS max_gap_ms, CAST(count(*) FILTER (WHERE gap >= 350) AS BIGINT) AS pauses, CAST(count(*) AS BIGINT) AS n_words
FROM (SELECT stream_id, coalesce(greatest(start_ms - lag(greatest(start_ms, end_ms)) OVER (PARTITION BY stream_id ORDER BY seq), 0), 0) AS gap FROM words)
GROUP BY stream_id"""

QUERIES = {
    "clauses": clauses,
    "clause_stats": clause_stats,
    "source_chunks": source_chunks,
    "pruned_loops": pruned_loops,
    **{f"mask_{s}": mask_documents(s) for s in masking.STYLES},
    "guard_segments": guard_segments,
    "guard_counts": guard_counts,
    **{f"plain_captions_{k}": plain_captions(k) for k in ("608", "708")},
    "loops": loops,
    "word_gaps": word_gaps,
}
SQL = {"guard_counts": GUARD_COUNTS_SQL, **{f"plain_captions_{k}": plain_captions_sql(k) for k in ("608", "708")}, "clauses": CLAUSES_SQL, "clause_stats": CLAUSE_STATS_SQL, "source_chunks": CHUNKS_SQL, **{f"mask_{s}": mask_sql(s) for s in masking.STYLES}, "guard_segments": GUARD_SQL, "word_gaps": WORD_GAPS_SQL}
