"""Words of a batch of texts as 64-bit hashes, a column of texts at a time in numpy."""

from __future__ import annotations

import numpy as np

#: Bytes looked at together; the tables of powers are as long.
SLICE = 1 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15 | 1)
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))
_MUL = np.uint64(0xC2B2AE3D27D4EB4F)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of ``h`` over all bits."""
    h = (h ^ (h >> np.uint64(29))) * _STEP
    h = (h ^ (h >> np.uint64(32))) * _MUL
    return h ^ (h >> np.uint64(30))


def _tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        n = max(n, SLICE + 1)
        powers = (np.cumprod(np.concatenate(([np.uint64(1)], np.full(n - 1, r)))) for r in (_STEP, _BACK))
        _powers[:] = list(powers)
    return _powers


def _letters(lower: bool) -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=np.uint64))
    if lower:
        values[65:91] = values[97:123]
    return values


def _slices(data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int]]:
    """(from, to) bytes, cut between texts or at white space, of about SLICE bytes; a longer word is never cut."""
    out, at, end = [], int(offsets[0]), int(offsets[-1])
    while at < end:
        to = min(end, at + SLICE)
        if to < end:
            k = int(np.searchsorted(offsets, to, "right")) - 1
            if offsets[k] > at:
                to = int(offsets[k])  # the last text that begins in the slice stays whole
            else:
                gaps = np.flatnonzero(_SPACE[data[at:to]])
                stop = int(offsets[k + 1])
                while not len(gaps) and to < stop:
                    far = min(stop, to + SLICE)
                    gaps = np.flatnonzero(_SPACE[data[to:far]]) + (to - at)
                    gaps, to = gaps[:1], far
                to = at + int(gaps[-1]) + 1 if len(gaps) else stop
        out.append((at, to))
        at = to
    return out


def hash_words(texts, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """``(hashes, bounds)`` of an Arrow array of binary texts: the words of text i are hashes[bounds[i]:bounds[i + 1]].

    Words are runs of bytes other than the six ASCII white-space ones; null texts have none. Equal words have equal
    hashes; ``lower`` reads A-Z as a-z. A word's hash is a sum of a number for each byte times a power of an odd number,
    taken from running sums, and mixed with its length."""
    import pyarrow as pa

    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    _, where, buffer = texts.buffers()
    offsets = np.frombuffer(where, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or buffer is None or offsets[0] == offsets[-1]:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    data, letters = np.frombuffer(buffer, np.uint8), _letters(lower)
    hashes, begins = [], []
    for at, to in _slices(data, offsets):
        part = data[at:to]
        inside = np.zeros(len(part) + 2, bool)
        inside[1:-1] = ~_SPACE[part]
        cut = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, to)] - at  # texts that begin here
        first = inside[1:-1] & ~inside[:-2]
        last = inside[1:-1] & ~inside[2:]
        first[cut] = inside[cut + 1]
        cut = cut[cut > 0] - 1
        last[cut] = inside[cut + 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        power, back = _tables(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(letters[part] * power[: len(part)], out=sums[1:])
        size = (ends - starts).astype(np.uint64)
        hashes.append(mix((sums[ends] - sums[starts]) * back[starts] + size * _MUL))
        begins.append(starts + at)
    begins = np.concatenate(begins)
    return np.concatenate(hashes), np.searchsorted(begins, offsets)
