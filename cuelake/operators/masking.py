"""Word lists and masking.

Usable entries are folded words. Up to ``TRIE_ENTRIES`` of them (counted first) are broadcast and become a trie for each
lane in every Python worker: edges are whole words, words with * are compiled alternatives beside them. A text's words
are walked through it in place, from the positions whose word can begin an entry, and only the spots that are hit
come back; texts are put together again by built-in functions. Longer lists are met by joins (:func:`list_match`).
"""

from __future__ import annotations

import re
import uuid
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ALNUM, clean, entry_problem, fold, fold_word, let, separators, tokens

STYLES = ("asterisks", "first_letter", "bleep", "drop")
#: Entries that are broadcast at most.
TRIE_ENTRIES = 200_000
SPOTS = pa.list_(pa.struct([("i", pa.int32()), ("len", pa.int32())]))


def compile_entries(lists: DataFrame) -> DataFrame:
    """Usable entries of ``lists(lang, entry, list)`` as ``lang, list, pattern``: folded words, each a regex."""
    words = F.filter(F.split(F.trim("entry"), f"[^{ALNUM}*]+"), lambda w: w != "")
    pattern = F.transform(words, lambda w: F.replace(fold(w), F.lit("*"), F.lit(".*")))
    return lists.filter(entry_problem(F.trim("entry")).isNull()).select("lang", "list", pattern.alias("pattern")).distinct()


def rejected_entries(lists: DataFrame) -> DataFrame:
    """Entries that can't be used, with the reason."""
    return lists.withColumn("problem", entry_problem(F.trim("entry"))).filter("problem is not null")


class Trie:
    """Entries of a lane by their words, to be looked up at a position of a text."""

    def __init__(self):
        self.words, self.globs, self.ends = [{}], [[]], [set()]

    def add(self, pattern: list[str], kind: str) -> None:
        at = 0
        for word in pattern:
            edges = self.words[at]
            if word not in edges:
                edges[word] = len(self.words)
                if ".*" in word:
                    self.globs[at].append((re.compile(word), edges[word]))
                for column, empty in ((self.words, {}), (self.globs, []), (self.ends, set())):
                    column.append(empty)
            at = edges[word]
        self.ends[at].add(kind)

    def after(self, at: int, word: str) -> list[int]:
        """The nodes that ``word`` leads to."""
        exact = self.words[at].get(word)  # a word of a text has no *, so it never names a glob
        return ([exact] if exact is not None else []) + [to for glob, to in self.globs[at] if glob.fullmatch(word)]

    def spot(self, words: list[str], i: int, first: list[int]) -> int:
        """How many words are masked at i: those of the longest blocked entry, unless as many are allowed; else 0."""
        blocked, allowed, nodes, size = 0, set(), first, 1
        while nodes:
            kinds = set().union(*(self.ends[n] for n in nodes))
            if "block" in kinds:
                blocked = size
            if "allow" in kinds:
                allowed.add(size)
            if i + size >= len(words):
                break
            nodes = [to for n in nodes for to in self.after(n, words[i + size])]
            size += 1
        return 0 if blocked in allowed else blocked


#: The tries of the lists that this worker met last, by the name of the broadcast.
_tries: dict[str, dict[str, Trie]] = {}


def _tries_of(name: str, rows: list[tuple[str, str, list[str]]]) -> dict[str, Trie]:
    if name not in _tries:
        _tries.clear()
        tries = _tries[name] = {}
        for lang, kind, pattern in rows:
            tries.setdefault(lang, Trie()).add(pattern, kind)
    return _tries[name]


def spots_in(tries: dict[str, Trie], langs: list[str], texts: pa.Array) -> pa.Array:
    """For each array of words the masked ``(i, len)``, from left to right. Each different word is folded once for all texts and
    looked up once at the root of each lane in which it stands."""
    coded = pc.dictionary_encode(texts.flatten())
    folded = [fold_word(w) for w in coded.dictionary.to_numpy(zero_copy_only=False).tolist()]  # to_pylist is slow for many
    codes = coded.indices.to_numpy(zero_copy_only=False)
    bounds = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(texts), 0).to_numpy(zero_copy_only=False)))).astype(np.int64)
    stands = {lang: np.zeros(len(folded), bool) for lang in tries.keys() & set(langs)}
    for lang, a, b in zip(langs, bounds[:-1].tolist(), bounds[1:].tolist()):
        if lang in stands:
            stands[lang][codes[a:b]] = True
    roots = {lang: [tries[lang].after(0, w) if here else [] for w, here in zip(folded, at.tolist())] for lang, at in stands.items()}
    begins = {lang: np.array([bool(x) for x in first], bool) for lang, first in roots.items()}
    spot_at, spot_len, ends = array("i"), array("i"), array("i", [0])  # plain numbers: texts of a batch have many spots
    for lang, a, b in zip(langs, bounds[:-1].tolist(), bounds[1:].tolist()):
        if lang in roots and b > a:
            at = np.flatnonzero(begins[lang][codes[a:b]]).tolist()
            words, free = [folded[k] for k in codes[a:b].tolist()] if at else [], 0
            for i in at:
                if i >= free and (n := tries[lang].spot(words, i, roots[lang][codes[a + i]])):
                    spot_at.append(i)
                    spot_len.append(n)
                    free = i + n
        ends.append(len(spot_at))
    found = pa.StructArray.from_arrays([pa.array(np.array(x, np.int32)) for x in (spot_at, spot_len)], fields=list(SPOTS.value_type))
    return pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), found).cast(SPOTS)


def spots(entries: DataFrame, lang: Column, words: Column) -> Column:
    """``array<struct<i, len>>``: what is masked in an array of words, for ``entries(lang, list, pattern)`` that fit the driver."""
    name = uuid.uuid4().hex
    sent = entries.sparkSession.sparkContext.broadcast([(r.lang, r.list, list(r.pattern)) for r in entries.collect()])

    @F.arrow_udf("array<struct<i: int, len: int>>")
    def find(langs: pa.Array, texts: pa.Array) -> pa.Array:
        return spots_in(_tries_of(name, sent.value), langs.to_pylist(), texts)

    return find(lang, words)


def list_match(words: DataFrame, entries: DataFrame, key: str) -> DataFrame:
    """``key, lang, list, i, len`` of entries that stand at word i (from 0) of ``words(key, lang, words)``.

    Exact first words of entries are met by an equi join, those with * by regex on the distinct words of a lane's
    language, never on all positions. Phrases are verified on the words that follow."""
    longest = entries.agg(F.max(F.size("pattern"))).first()[0] or 1
    here = F.transform("words", lambda w, i: F.struct(i.alias("i"), w.alias("word"), F.slice("words", i + 1, longest).alias("next")))
    spots = words.select(key, "lang", F.explode(here).alias("x")).select(key, "lang", "x.*")
    first = entries.withColumn("word", F.col("pattern")[0])
    globs = first.filter(F.contains("word", F.lit("*"))).withColumnRenamed("word", "glob")
    vocabulary = spots.select("lang", "word").distinct()
    by_glob = vocabulary.join(globs, "lang").filter(F.regexp_like("word", F.concat(F.lit("^(?:"), F.col("glob"), F.lit(")$"))))
    starts = first.filter(~F.contains("word", F.lit("*"))).select("lang", "word", "list", "pattern").unionByName(by_glob.select("lang", "word", "list", "pattern"))
    at = F.slice("next", 1, F.size("pattern"))
    whole = (F.size(at) == F.size("pattern")) & F.forall(F.arrays_zip(at.alias("w"), F.col("pattern").alias("p")), lambda x: F.regexp_like(x["w"], F.concat(F.lit("^(?:"), x["p"], F.lit(")$"))))
    found = spots.join(starts, ["lang", "word"])
    return found.filter((F.size("pattern") == 1) | whole).select(key, "lang", "list", "i", F.size("pattern").alias("len"))


def joined_spots(rows: DataFrame, entries: DataFrame, key: str) -> DataFrame:
    """``rows(key, lang, __t)`` with ``__m``, as :func:`spots` gives, by joins."""
    words = rows.select(key, "lang", F.transform("__t", fold).alias("words"))
    hits = list_match(words, entries, key)
    block = hits.filter("list = 'block'").groupBy(key, "i").agg(F.max("len").alias("len"))
    allow = hits.filter("list = 'allow'").select(key, "i", "len").distinct().withColumn("ok", F.lit(True))
    hits = block.join(allow, [key, "i", "len"], "left").filter("ok is null").select(key, "i", "len")
    # a hit that begins after all hits before it have ended is always taken: what lies between two such hits is an
    # island, in which the leftmost hits that don't overlap are taken one after another
    order = Window.partitionBy(key).orderBy("i")
    reach = F.max(F.col("i") + F.col("len")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    hits = hits.withColumn("island", F.sum(F.coalesce(F.col("i") >= reach, F.lit(True)).cast("int")).over(order))
    start = F.struct(F.lit(0).alias("next"), F.array().cast("array<struct<i:int,len:int>>").alias("spots"))
    take = lambda s, x: F.when(x["i"] >= s["next"], F.struct((x["i"] + x["len"]).alias("next"), F.concat(s["spots"], F.array(x)).alias("spots"))).otherwise(s)
    each = hits.groupBy(key, "island").agg(F.sort_array(F.collect_list(F.struct("i", "len"))).alias("h"))
    found = each.select(key, F.aggregate("h", start, take, lambda s: s["spots"]).alias("h")).groupBy(key).agg(F.sort_array(F.flatten(F.collect_list("h"))).alias("__m"))
    return rows.join(found, key, "left")


def tidy(c: Column) -> Column:
    """Spaces that dropped words leave behind."""
    return F.rtrim(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "^ +", ""), " {2,}", " "), " ([,.!?;:])", "$1"))


def mask_words(texts: DataFrame, lists: DataFrame, style: str = "asterisks", key: str = "id") -> DataFrame:
    """``texts(key, lang, text)`` with listed words and phrases masked, and ``n_masked``.

    At each word the longest entry of the block list counts. If exactly its words are on the allow list, one word is
    passed over, and shorter entries aren't tried. Else the entry is masked and the words after it are next."""
    if style not in STYLES:
        raise ValueError(f"style is one of {STYLES}")
    entries = compile_entries(lists)
    rows = texts.withColumn("__t", tokens(F.col("text")))
    few = entries.count() <= TRIE_ENTRIES
    out = rows.withColumn("__m", spots(entries, F.col("lang"), F.col("__t"))) if few else joined_spots(rows, entries, key)
    out = out.withColumn("__m", F.coalesce("__m", F.array().cast("array<struct<i:int,len:int>>")))
    stars = lambda t: F.regexp_replace(t, f"[{ALNUM}]", "*")

    def rebuilt(plain: Column, s: Column) -> Column:
        """The text from its words with the separators before them. Only what is masked is starred: separators have no letters."""
        m, n = F.col("__m"), F.size("__t")
        end = lambda k: F.coalesce(F.get(m, k)["i"] + F.get(m, k)["len"], F.lit(0))
        run = lambda a, z: F.array_join(F.slice(plain, a + 1, z - a), "")

        def hidden(x: Column) -> Column:
            if style in ("bleep", "drop"):
                return F.lit("[bleep]" if style == "bleep" else "")
            span = stars(F.substr(run(x["i"], x["i"] + x["len"]), F.length(F.get(s, x["i"])) + 1))
            return span if style == "asterisks" else F.concat(F.substring(F.get(F.col("__t"), x["i"]), 1, 1), F.substr(span, F.lit(2)))

        parts = F.transform(m, lambda x, k: F.concat(run(end(k - 1), x["i"]), F.get(s, x["i"]), hidden(x)))
        return F.concat(F.array_join(parts, ""), run(end(F.size(m) - 1), n), F.get(s, n))

    joined = lambda s: F.zip_with(F.slice(s, 1, F.size("__t")), F.col("__t"), lambda s, t: F.concat(s, t))
    body = let(separators(F.col("text")), lambda s: let(F.struct(s.alias("s"), joined(s).alias("a")), lambda x: rebuilt(x["a"], x["s"])))
    body = F.when(F.size("__m") == 0, F.col("text")).otherwise(tidy(body) if style == "drop" else body)
    return out.withColumns({"text": body, "n_masked": F.size("__m").cast("long")}).drop("__t", "__m")


def text_for_lane(texts: DataFrame, lists: DataFrame, style: str = "asterisks", key: str = "id") -> DataFrame:
    """clean and masked texts of ``texts(key, lang, source_lang, text)``, blank ones dropped.

    A lane is held against the list of its language and that of the source language; a lane whose language has no
    list against all lists."""
    langs = lists.select("lang").distinct()
    named = texts.select(F.col("lang").alias("__lane"), "source_lang").distinct()
    named = named.join(F.broadcast(langs.withColumnRenamed("lang", "__lane").withColumn("__known", F.lit(True))), "__lane", "left")
    # lanes and lists are few: one list for each pair of lane and source language
    pair = F.concat_ws("|", "__lane", "source_lang")
    of = named.select(pair.alias("__pair"), F.col("__known").isNull().alias("__all"), F.array("__lane", "source_lang").alias("__langs"))
    every = lists.join(F.broadcast(of), F.col("__all") | F.array_contains("__langs", F.col("lang"))).select(F.col("__pair").alias("lang"), "entry", "list").distinct()
    cleaned = texts.withColumns({"text": clean(F.col("text")), "__lang": F.col("lang"), "lang": F.concat_ws("|", "lang", "source_lang")})
    out = mask_words(cleaned, every, style, key).withColumn("lang", F.col("__lang")).drop("__lang")
    return out.filter(F.trim("text") != "")
