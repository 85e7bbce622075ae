"""Word error rates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import wer_tokens, with_normal_form

#: Words are coded as code points from here on, past control characters; surrogates bound the number of words.
FIRST_CODE, MOST_WORDS = 256, 55_000


def word_edits(ref: Column, hyp: Column) -> Column:
    """Least number of word edits between two arrays. Each different word becomes one character, and the built-in
    edit distance counts characters; a pair with more than 55,000 different words is aligned in numpy."""
    words = F.array_union(ref, hyp)
    code = lambda v, w: F.decode(F.unhex(F.lpad(F.hex(F.array_position(v, w) + (FIRST_CODE - 1)), 4, "0")), "UTF-16BE")
    coded = lambda v, x: F.array_join(F.transform(x, lambda w: code(v, w)), "")
    edits = F.transform(F.array(words), lambda v: F.levenshtein(coded(v, ref), coded(v, hyp)))[0]
    many = F.size(words) > MOST_WORDS
    return F.when(many, many_edits(F.when(many, ref), F.when(many, hyp))).otherwise(edits)


def many_edits(ref: Column, hyp: Column) -> Column:
    """Least number of word edits of two arrays, by :func:`align_pairs`; null of null."""

    @F.arrow_udf("int")
    def edits(a: pa.Array, b: pa.Array) -> pa.Array:
        packed = align_pairs(a, b) >> COST
        return pa.array(packed, pa.int32(), mask=np.asarray(pc.or_(a.is_null(), b.is_null())))

    return edits(ref, hyp)


#: A step of the alignment: its cost above, a deletion counted below.
COST = 32
SUBSTITUTION, DELETION, INSERTION = 1 << COST, (1 << COST) + 1, 1 << COST
#: Cells of the rows that are worked on together.
CELLS = 1 << 20


def coded(*arrays: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each array of lists the words as numbers, and where its lists begin and end; equal words have equal numbers."""
    flat = pc.dictionary_encode(pa.chunked_array([x.flatten() for x in arrays])).combine_chunks()
    codes = (flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat).indices.to_numpy(zero_copy_only=False)
    out, at = [], 0
    for x in arrays:
        bounds = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False)))).astype(np.int64)
        out.append((codes[at : at + bounds[-1]], bounds))
        at += int(bounds[-1])
    return out


def align_pairs(refs: pa.Array, hyps: pa.Array) -> np.ndarray:
    """For each pair of word lists ``cost << 32 | deletions`` of a cheapest alignment; of several, that with the fewest
    deletions (and so the fewest insertions and most substitutions).

    Pairs of like length are aligned side by side, a row of their tables at a time; every step adds a fixed number, so
    insertions are a running minimum. A pair needs the memory of two rows."""
    (x, xs), (y, ys) = coded(refs, hyps)
    n, m = np.diff(xs), np.diff(ys)
    out, order, at = np.zeros(len(n), np.int64), np.lexsort((m, n)), 0
    while at < len(order):
        width = np.maximum.accumulate(m[order[at : at + CELLS]]) + 1
        to = at + max(1, int(np.searchsorted(width * np.arange(1, len(width) + 1), CELLS, "right")))
        group = order[at:to]
        out[group] = _rows(x, xs[group], n[group], y, ys[group], m[group])
        at = to
    return out


def _rows(x, x_at, n, y, y_at, m) -> np.ndarray:
    """Pairs in rising order of ``n``, side by side: the last cell of each one's table."""
    wide = int(m.max())
    steps = np.arange(wide + 1) * INSERTION
    inside = np.minimum(np.arange(wide), np.maximum(m - 1, 0)[:, None]) + y_at[:, None]
    other = y[np.minimum(inside, max(len(y) - 1, 0))] if len(y) else np.zeros((len(n), wide), np.int64)
    row = np.tile(steps, (len(n), 1))
    done = int(np.searchsorted(n, 0, "right"))
    out = np.zeros(len(n), np.int64)
    out[:done] = row[np.arange(done), m[:done]]
    for i in range(int(n.max(initial=0))):
        row, other, x_at, n, m = (v[done:] for v in (row, other, x_at, n, m))
        new = row + DELETION
        same = other == x[x_at + i][:, None]
        np.minimum(new[:, 1:], row[:, :-1] + np.where(same, 0, SUBSTITUTION), out=new[:, 1:])
        row = np.minimum.accumulate(new - steps, axis=1) + steps
        done = int(np.searchsorted(n, i + 1, "right"))
        out[len(out) - len(n) : len(out) - len(n) + done] = row[np.arange(done), m[:done]]
    return out


def edit_kinds(ref: Column, hyp: Column) -> Column:
    """``struct<sub, del, ins>`` of two arrays of words, see :func:`align_pairs`; null arrays count as empty."""

    @F.arrow_udf("sub long, del long, ins long")
    def kinds(a: pa.Array, b: pa.Array) -> pa.Array:
        packed = align_pairs(a, b)
        cost, gone = packed >> COST, packed & ((1 << COST) - 1)
        sizes = [pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (a, b)]
        came = gone - sizes[0] + sizes[1]
        return pa.StructArray.from_arrays([pa.array(v) for v in (cost - gone - came, gone, came)], names=["sub", "del", "ins"])

    return kinds(ref, hyp)


def ref_hyp_join(refs: DataFrame, hyps: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Pairs of a non-empty reference and its hypothesis, and the references without one."""
    said = refs.filter(F.trim("ref") != "")
    return said.join(hyps, by), said.join(hyps, by, "left_anti")


def wer(pairs: DataFrame, by: list[str], normal_form: str | None = "NFKC", apostrophe: bool = False, kinds: bool = False) -> DataFrame:
    """A7 over ``pairs(.., ref, hyp)``: utterances, edits, reference words and the corpus rate per key; with ``kinds``
    substitutions, deletions and insertions too, and edits are their sum."""
    if normal_form:
        pairs = with_normal_form(with_normal_form(pairs, "ref", normal_form), "hyp", normal_form)
    rows = pairs.withColumns({"__r": wer_tokens(F.col("ref"), apostrophe), "__h": wer_tokens(F.col("hyp"), apostrophe)}).filter(F.size("__r") > 0)
    rows = rows.withColumn("n_ref", F.size("__r"))
    extra = []
    if kinds:
        rows = rows.withColumn("__k", edit_kinds(F.col("__r"), F.col("__h"))).withColumn("edits", F.expr("__k.sub + __k.del + __k.ins"))
        extra = [F.sum(f"__k.{k}").alias(k) for k in ("sub", "del", "ins")]
    else:
        rows = rows.withColumn("edits", word_edits(F.col("__r"), F.col("__h")))
    out = rows.groupBy(*by).agg(F.count("*").alias("utts"), F.sum("edits").alias("edits"), F.sum("n_ref").alias("n_ref"), *extra)
    return out.withColumn("wer", 100.0 * F.col("edits") / F.col("n_ref"))
