"""Scalar text functions as Column expressions of built-ins."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the caption character rules.
ONE_TO_ONE = (("'", "‘’‚‛′`´"), ('"', "“”„‟″"), ("-", "‐‑‒–—―−•·"))
ONE_TO_MANY = (("©", "(c)"), ("®", "(R)"), ("™", "TM"), ("…", "..."), ("€", "EUR"), ("œ", "oe"), ("Œ", "OE"))
WHITE = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
DROPPED = (
    r"[\x{0}-\x{8}\x{E}-\x{1F}\x{7F}-\x{84}\x{86}-\x{9F}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{20D0}-\x{20FF}"
    r"\x{2190}-\x{21FF}\x{2300}-\x{23FF}\x{2460}-\x{27BF}\x{2900}-\x{2BFF}\x{E000}-\x{F8FF}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFFD}"
    r"\x{1F000}-\x{1FAFF}\x{E0000}-\x{E007F}\x{F0000}-\x{10FFFF}]"
)
FOLDED = {
    "a": "àáâãäåāăą", "c": "çćčĉċ", "d": "ďđ", "e": "èéêëēĕėęě", "g": "ğĝġģ", "i": "ìíîïĩīĭįı", "l": "łľĺļ", "n": "ñńňņ",
    "o": "òóôõöøōŏő", "r": "ŕřŗ", "s": "śšşŝș", "t": "ťţț", "u": "ùúûüũūŭůűų", "y": "ýÿŷ", "z": "źżž",
}
FOLDED_TO_TWO = (("ß", "ss"), ("æ", "ae"), ("œ", "oe"))
OPENING = "¿¡«([“„「『（《"
CLOSING = "»)]\"'”’」』）》"
SENTENCE_MARKS = ".!?。！？…"
CLAUSE_MARKS = ",，、"
CJK = r"\x{3000}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{FF00}-\x{FFEF}"
#: Words that carry no content, and abbreviations that end no sentence.
STOP_WORDS = (
    "a", "an", "the", "and", "or", "but", "if", "of", "to", "in", "on", "at", "by", "for", "with", "from", "as",
    "is", "was", "are", "were", "be", "been", "am", "it", "its", "this", "that", "these", "those", "he", "she",
    "they", "we", "you", "i", "me", "him", "her", "them", "us", "my", "his", "their", "our", "your", "not", "no",
    "so", "do", "did", "had", "has", "have", "then", "there", "which", "who", "what", "all", "one", "into",
    "upon", "up", "out", "would", "could", "should", "will", "shall", "can", "may", "might", "must", "s",
)
ABBREVIATIONS = ("Mr.", "Mrs.", "Ms.", "Dr.", "St.", "Jr.", "a.m.", "p.m.")

#: Letters and numbers of any script.
ALNUM = r"\p{IsAlphabetic}\p{N}"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once for each row."""
    return F.transform(F.array(value), body)[0]


def _class(chars: str) -> str:
    return "[" + "".join(rf"\x{{{ord(c):X}}}" for c in chars) + "]"


def _replace(c: Column, pairs) -> Column:
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, c)


def clean(c: Column) -> Column:
    """Symbols to ASCII, white space to single spaces, controls and pictographs away, trimmed."""
    c = F.translate(c, "".join(s for _, s in ONE_TO_ONE), "".join(t * len(s) for t, s in ONE_TO_ONE))
    # runs become one space at the end; most characters are told from those of a large class by two ranges
    c = F.regexp_replace(_replace(c, ONE_TO_MANY), f"(?![ -~])(?:{WHITE})", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(c, rf"(?![ -~\x{{A0}}-\x{{1FFF}}]){DROPPED}", ""), " {2,}", " "))


def clean_bytes(c: Column) -> Column:
    """Bytes to text, what isn't UTF-8 away, then :func:`clean`."""
    return clean(F.make_valid_utf8(c.cast("string")))


def fold(c: Column) -> Column:
    """Lower case without Latin accents."""
    return _replace(F.translate(F.lower(c), "".join(FOLDED.values()), "".join(k * len(v) for k, v in FOLDED.items())), FOLDED_TO_TWO)


_FOLD_WORD = str.maketrans({x: k for k, letters in FOLDED.items() for x in letters} | dict(FOLDED_TO_TWO))


def fold_word(word: str) -> str:
    """:func:`fold` of one word in Python."""
    return word.lower().translate(_FOLD_WORD)


def tokens(c: Column) -> Column:
    """T4: runs of letters and numbers."""
    return F.regexp_extract_all(c, F.lit(f"[{ALNUM}]+"), F.lit(0))


def separators(c: Column) -> Column:
    """What stands before, between and after the tokens; one more than those."""
    return F.split(c, f"[{ALNUM}]+", -1)


def norm_word(c: Column) -> Column:
    """T5."""
    return F.lower(F.regexp_replace(c, f"[^{ALNUM}']+", ""))


def normalise_line(c: Column) -> Column:
    """T6."""
    return F.trim(F.regexp_replace(F.lower(c), f"[^{ALNUM}]+", " "))


def content_words(c: Column, stop=STOP_WORDS) -> Column:
    """Lower-case words without those of ``stop``; an apostrophe joins its sides."""
    each = F.split(F.lower(F.replace(c, F.lit("'"), F.lit(""))), f"[^{ALNUM}]+")
    return F.filter(each, lambda w: (w != "") & ~w.isin(*stop))  # a hash set of the stop words


def wer_tokens(c: Column, apostrophe: bool = False) -> Column:
    """T8 for text in NFKC (see operators.wer.nfkc): lower-case words; with ``apostrophe`` the mark joins its sides."""
    c = F.lower(c)
    if apostrophe:
        c = F.translate(c, "'’", "")
    return F.filter(F.split(F.regexp_replace(c, r"[\p{P}\p{S}\p{C}]", " "), r"\s+"), lambda w: w != "")


def entry_problem(c: Column) -> Column:
    """Why a word-list entry can't be used; null if it can."""
    words = F.filter(F.split(c, f"[^{ALNUM}*]+"), lambda w: w != "")
    return (
        F.when(c.rlike(f"[^{ALNUM}* '\\-]"), "use letters, digits, spaces, ', - and * only")
        .when(F.size(words) == 0, "entry is empty")
        .when(F.exists(words, lambda w: ~w.rlike(f"[{ALNUM}]")), "every word needs at least one letter or digit besides *")
    )


def split_sentences(c: Column, abbreviations=ABBREVIATIONS) -> Column:
    """Cut after . ! ? before one white space and a capital or an opening mark, not after an abbreviation."""
    # the white space first: what stands before it is looked at there alone, not at every character
    not_after = "".join(rf"(?<!\Q{a}\E\p{{IsWhite_Space}})" for a in abbreviations)
    cut = rf"\p{{IsWhite_Space}}(?=[\p{{IsUppercase}}¿¡\"“])(?<=[.!?]\p{{IsWhite_Space}}){not_after}"
    return F.filter(F.transform(F.split(c, cut), F.trim), lambda s: s != "")


def is_punct(c: Column) -> Column:
    """Not empty, and no letter or number in it."""
    return (c != "") & ~c.rlike(f"[{ALNUM}]")


def sentence_end(c: Column) -> Column:
    return c.rlike(f"{_class(SENTENCE_MARKS)}{_class(CLOSING)}*$")


def clause_end(c: Column) -> Column:
    return c.rlike(f"{_class(CLAUSE_MARKS)}{_class(CLOSING)}*$")


def _tight(before: Column, word: Column) -> Column:
    """Whether no space stands between what ends like ``before`` and ``word``."""
    bare = ~word.rlike(f"[{ALNUM}]") & ~word.rlike(f"^{_class(OPENING)}+$")
    return bare | before.rlike(f"{_class(OPENING)}$") | (before.rlike(f"[{CJK}]$") & word.rlike(f"^[{CJK}]"))


def glue(left: Column, word: Column) -> Column:
    """``left`` and ``word`` with a space, but none before bare punctuation, after an opening mark, or between two
    CJK characters."""
    return F.concat(left, F.when((left == "") | _tight(left, word), "").otherwise(" "), word)


def join_words(words: Column) -> Column:
    """T11 over an array: :func:`glue` looks at the word before alone, so the text isn't read again for each word. A null word
    makes the text null."""
    space = lambda w, x, i: F.when((i == 0) | _tight(F.get(w, i - 1), x), "").otherwise(" ")
    text = let(F.filter(words, lambda w: w != ""), lambda w: F.array_join(F.transform(w, lambda x, i: F.concat(space(w, x, i), x)), ""))
    return F.when(~F.exists(words, lambda w: w.isNull()), text)


def decode_cap(c: Column) -> Column:
    """Most output tokens for a text."""
    return F.least(F.size(F.filter(F.split(c, r"\s+"), lambda w: w != "")) * 4 + 16, F.lit(256))


def translatable(c: Column, most: int = 4096) -> Column:
    return F.octet_length(c) <= most


def word_eq(a: Column, b: Column) -> Column:
    """Equal up to the edits that a word of this length may have."""
    n = F.greatest(F.length(a), F.length(b))
    # beyond two edits, where it is -1, the distance isn't worked out
    return F.levenshtein(a, b, 2).between(0, F.when(n <= 2, 0).when(n <= 7, 1).otherwise(2))


def redact_url(c: Column) -> Column:
    """Stream keys in addresses."""
    c = F.regexp_replace(c, r"^(rtmps?://[^/?]+/[^?]*/)[^/?]+", "$1***")
    return F.regexp_replace(c, r"([?&](?:passphrase|streamid|key)=)[^&]*", "$1***")


def strip_tags(c: Column) -> Column:
    """T18."""
    return F.regexp_replace(F.regexp_replace(c, "<[^>]*(>|$)", ""), r"\{[^}]*(\}|$)", "")


def html_escape(c: Column) -> Column:
    """T19."""
    return _replace(c, (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")))


def wrap_lines(c: Column, cells: int) -> Column:
    """Lines of at most ``cells`` characters; hard breaks stay, words that are too long are cut.

    A line is the longest run of that many characters that ends where a word does: one pass of a regex."""
    if cells < 2:
        raise ValueError("a line has two cells or more")
    spaced = lambda line: F.regexp_replace(F.trim(F.regexp_replace(line, " {2,}", " ")), rf"([^ ]{{{cells}}})(?=[^ ])", "$1 ")
    pattern = rf"[^ ](?:.{{0,{cells - 2}}}[^ ])?(?= |$)"
    return F.flatten(F.transform(F.split(c, "\n"), lambda line: F.regexp_extract_all(spaced(line), F.lit(pattern), F.lit(0))))


#: The plain-text set of line 21 captions beside ASCII, and ASCII that it lacks.
CAPTION_608_EXTRA = "áéíóúçñÑ÷®°½¿™¢£♪àèâêîôûÁÉÓÚÜü‘¡*’—©•“”ÀÂÇÈÊËëÎÏïÔÙùÛ«»ÃãÍÌìÒòÕõ{}\\^_|~ÄäÖöß¥¤¦ÅåØø"
CAPTION_FALLBACK = {"…": "...", "€": "EUR", "œ": "oe", "Œ": "OE", "–": "-", "„": '"', "`": "'", "ÿ": "y", "Š": "S", "š": "s", "Ž": "Z", "ž": "z"}


def in_caption_charset(ch: Column, kind: str = "608") -> Column:
    """Whether a caption of the kind (608, or 708: Latin-1 and a little more) can show the character."""
    if kind == "708":
        return ch.rlike(r"^[\x{20}-\x{7E}\x{A0}-\x{FF}…‘’“”•™ŠšŒœŸ⅛⅜⅝⅞♪]$")
    return ch.rlike(r"^[\x{20}-\x{7E}]$") | F.contains(F.lit(CAPTION_608_EXTRA), ch)


def caption_tables(kind: str = "608") -> tuple[str, str, list[tuple[str, str]], str]:
    """What :func:`plain_caption` does: letters, their plain forms, longer replacements, and a class of all that can be shown."""
    extra = CAPTION_608_EXTRA if kind == "608" else "".join(map(chr, range(0xA0, 0x100))) + "…‘’“”•™ŠšŒœŸ⅛⅜⅝⅞♪"
    plain = {x: k for k, letters in FOLDED.items() for x in letters}
    plain |= {x.upper(): k.upper() for x, k in plain.items() if len(x.upper()) == 1}
    plain = {x: k for x, k in (plain | CAPTION_FALLBACK).items() if x not in extra and not " " <= x <= "~"}
    single = {x: k for x, k in plain.items() if len(k) == 1}
    escaped = "".join("\\" + x if x in "\\^]-[" else x for x in extra)
    return "".join(single), "".join(single.values()), [(x, k) for x, k in plain.items() if len(k) > 1], f"\n -~{escaped}"


def plain_caption(c: Column, kind: str = "608") -> Column:
    """A text as a caption of the kind can show it: letters that it lacks as plain ones, a few marks written out, the rest
    left out; line breaks stay."""
    letters, plain, longer, shown = caption_tables(kind)
    return F.regexp_replace(_replace(F.translate(c, letters, plain), longer), f"[^{shown}]", "")


#: Names of languages in themselves; a code without one is shown as it is.
ENDONYMS = {"en": "English", "es": "Español", "fr": "Français", "de": "Deutsch", "pt": "Português", "it": "Italiano", "nl": "Nederlands", "pl": "Polski", "ru": "Русский", "uk": "Українська", "ja": "日本語", "zh": "中文", "ko": "한국어", "ar": "العربية", "tr": "Türkçe", "sv": "Svenska"}
LATIN = ("en", "es", "fr", "de", "pt", "it", "nl", "pl", "sv", "tr")
EXTENDED_LATIN = ("pl", "tr")


def endonym(code: Column, names: dict[str, str] = ENDONYMS) -> Column:
    """T25."""
    table = F.create_map(*[F.lit(x) for p in names.items() for x in p])
    return F.coalesce(F.element_at(table, code), code)


def lang_formats(code: Column) -> Column:
    """Caption formats that a language's script allows."""
    return F.when(code.isin(*LATIN), F.array(F.lit("cea608"), F.lit("cea708"), F.lit("webvtt"))).otherwise(F.array(F.lit("webvtt")))


def lang_note(code: Column) -> Column:
    return F.when(code.isin(*EXTENDED_LATIN), "some letters are shown without their accents")


def with_normal_form(df: DataFrame, column: str, form: str = "NFKC") -> DataFrame:
    """``column`` in a Unicode normal form. Spark has no built-in for it: batches go through Arrow."""
    @F.pandas_udf("string")
    def normal(s: pd.Series) -> pd.Series:
        return s.str.normalize(form)

    return df.withColumn(column, normal(column))
