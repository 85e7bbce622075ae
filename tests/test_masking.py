"""Masking by tries against masking by joins and against a plain walk."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cuelake.operators import masking

ENTRIES = [("en", "the", "block"), ("en", "ha*", "block"), ("en", "of the", "block"), ("en", "of the ha*", "block"), ("en", "*nd of", "block"), ("en", "hand", "allow"), ("en", "of the hat", "allow"), ("fr", "été", "block"), ("fr", "l'eau", "block"), ("de", "straße", "block"), ("xx", "?!", "block")]
WORDS = "the Of of HAND hand hat hats and end été Ete l'eau L'Eau straße Strasse x-ray 12 * ,".split()


def corpus():
    r = random.Random(8)
    rows = [(k, r.choice(["en", "en", "fr", "de", "it", None]), "".join(r.choice(WORDS) + r.choice([" ", " ", ", ", "\n", "-"]) for _ in range(r.randint(0, 25)))) for k in range(150)]
    return rows + [(900, "en", None), (901, "en", ""), (902, None, "the"), (903, "en", "of the " * 3000), (904, "en", "Of the"), (905, "en", "...the")]


@pytest.mark.parametrize("style", masking.STYLES)
def test_tries_and_joins_agree(spark, monkeypatch, style):
    lists = spark.createDataFrame(ENTRIES, "lang string, entry string, list string")
    texts = spark.createDataFrame(corpus(), "id long, lang string, text string").repartition(3)
    by_trie = sorted(map(str, masking.mask_words(texts, lists, style).collect()))
    monkeypatch.setattr(masking, "TRIE_ENTRIES", 0)
    assert by_trie == sorted(map(str, masking.mask_words(texts, lists, style).collect()))


def test_spots_against_a_plain_walk():
    r = random.Random(9)
    pattern = lambda: [r.choice(["a", "b", "c", "a.*", "bb", ".*b"]) for _ in range(r.randint(1, 3))]
    for _ in range(60):
        rows = [("en", kind, list(p)) for kind in ("block", "allow") for p in {tuple(pattern()) for _ in range(r.randint(0, 5))}]
        tries = masking._tries_of(str(r.random()), rows)
        words = [r.choice(["a", "b", "c", "ab", "bb"]) for _ in range(30)]
        fits = lambda kind, i, n: any(k == kind and len(p) == n and i + n <= 30 and all(re.fullmatch(x, w) for x, w in zip(p, words[i:])) for _, k, p in rows)
        expected, i = [], 0
        while i < 30:
            n = max((n for n in (1, 2, 3) if fits("block", i, n)), default=0)
            masked = n and not fits("allow", i, n)
            expected += [{"i": i, "len": n}] if masked else []
            i += n if masked else 1
        assert masking.spots_in(tries, ["en", "fr", None], pa.array([words, words, None])).to_pylist() == [expected, [], []]


def test_no_lists(spark):
    texts = spark.createDataFrame([(1, "en", "the end")], "id long, lang string, text string")
    none = spark.createDataFrame([], "lang string, entry string, list string")
    assert [(r.text, r.n_masked) for r in masking.mask_words(texts, none).collect()] == [("the end", 0)]
    assert masking.mask_words(texts.limit(0), none).count() == 0


def test_spots_take_little_memory():
    """Spots of a batch are numbers, not an object each."""
    import tracemalloc

    import pyarrow as pa

    trie = masking.Trie()
    trie.add(["the"], "block")
    texts = pa.array([["the", "a"] * 1000] * 200 + [None, []])
    tracemalloc.start()
    found = masking.spots_in({"en": trie}, ["en"] * 202, texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.type == masking.SPOTS and found.to_pylist() == [[{"i": i, "len": 1} for i in range(0, 2000, 2)]] * 200 + [[], []]
    assert peak < 15_000_000


def test_words_are_looked_up_in_their_lanes(monkeypatch):
    """A word is looked up at the root of a lane only if a text of the lane has it, once for all texts."""
    seen, after = [], masking.Trie.after
    monkeypatch.setattr(masking.Trie, "after", lambda self, at, word: (at == 0 and seen.append(word)) or after(self, at, word))
    tries = {lang: masking.Trie() for lang in ("en", "fr")}
    tries["en"].add(["the"], "block")
    tries["fr"].add(["eau.*"], "block")
    found = masking.spots_in(tries, ["en", "fr", "en", "xx"], pa.array([["The", "cat"], ["eaux"], ["the"], ["the"]], pa.list_(pa.string())))
    assert [[(x["i"], x["len"]) for x in f] for f in found.to_pylist()] == [[(0, 1)], [(0, 1)], [(0, 1)], []]
    assert sorted(seen) == ["cat", "eaux", "the", "the"]  # The and the are different words of the texts


def test_documents_are_dealt_over_tasks(spark):
    """Costly work on a table of one row group isn't one task, and equal keys don't meet."""
    from cuelake.plans.tables import dealt

    docs = spark.range(400).selectExpr("id", "'same' AS text").coalesce(1)
    assert dealt(docs).select(F.spark_partition_id().alias("p")).distinct().count() > 1
    assert dealt(docs).count() == 400
