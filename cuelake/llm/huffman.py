"""Canonical, length-limited Huffman codes for token ids, and blocks of coded ids.

A block is coded on its own: its ids as one string of bits, and the bit offset of every ``STEP``-th id. A decoder
looks up ``LIMIT`` bits at a time in one table and works on all checkpoints of a block side by side.
"""

from __future__ import annotations

import numpy as np

#: Longest code, in bits; room for 65,536 different ids.
LIMIT = 16
STEP = 64


def code_lengths(counts: dict[int, int], limit: int = LIMIT) -> dict[int, int]:
    """Lengths of the best prefix code with no code over ``limit`` bits (package-merge). One id alone gets 1 bit."""
    if len(counts) > 1 << limit:
        raise ValueError(f"{len(counts)} ids don't fit codes of {limit} bits")
    if len(counts) < 2:
        return dict.fromkeys(counts, 1)
    ids = sorted(counts, key=lambda i: (counts[i], i))
    weight = np.array([counts[i] for i in ids], np.int64)
    n = len(ids)
    # a level's list holds the ids and the pairs of the level below, by weight; whether an entry is an id
    # and how many of the first entries are ids is all that the way back needs
    levels, pairs = [], np.zeros(0, np.int64)
    for _ in range(limit):
        merged = np.concatenate((weight, pairs))
        order = np.argsort(merged, kind="stable")
        levels.append(order < n)
        merged = merged[order]
        even = len(merged) // 2 * 2
        pairs = merged[0:even:2] + merged[1:even:2]
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for is_id in reversed(levels):
        own = int(is_id[:take].sum())
        lengths[:own] += 1
        take = 2 * (take - own)
    return {i: int(x) for i, x in zip(ids, lengths)}


class Code:
    """Canonical codes: ids are numbered by (length, id), so the lengths alone give the code."""

    def __init__(self, lengths: dict[int, int], limit: int = LIMIT):
        ids = np.array(sorted(lengths, key=lambda i: (lengths[i], i)), np.int64)
        size = np.array([lengths[i] for i in ids.tolist()], np.int64)
        first = np.cumsum(1 << (limit - size)) - (1 << (limit - size))  # the codes, left-aligned in limit bits
        top = int(ids.max()) + 1 if len(ids) else 0
        self.limit = limit
        self.size, self.bits = np.zeros(top, np.int64), np.zeros(top, np.uint64)
        self.size[ids], self.bits[ids] = size, first >> (limit - size)
        self.table_id, self.table_size = np.zeros(1 << limit, np.int32), np.ones(1 << limit, np.uint8)
        if len(ids):
            fill = np.repeat(np.arange(len(ids)), 1 << (limit - size))
            self.table_id[: len(fill)], self.table_size[: len(fill)] = ids[fill], size[fill]

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bits, and the bit offset of every STEP-th id."""
        size, bits = self.size[ids], self.bits[ids]
        end = np.cumsum(size)
        at = end - size
        total = int(end[-1]) if len(ids) else 0
        words = np.zeros(total // 64 + 2, np.uint64)
        word, room = at >> 6, 64 - (at & 63) - size
        left = np.where(room >= 0, bits << np.maximum(room, 0).astype(np.uint64), bits >> np.maximum(-room, 0).astype(np.uint64))
        new = np.flatnonzero(np.diff(word, prepend=-1))
        if len(ids):
            words[word[new]] = np.bitwise_or.reduceat(left, new)
        over = np.flatnonzero(room < 0)  # at most one id ends in the next word of each
        words[word[over] + 1] |= bits[over] << (64 + room[over]).astype(np.uint64)
        return words.astype(">u8").tobytes()[: (total + 7) // 8], at[::STEP].copy()

    def decode(self, data: bytes, starts: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` ids of a block, from its bits and checkpoints."""
        raw = np.frombuffer(data + b"\0\0\0\0", np.uint8).astype(np.uint32)
        window = (raw[:-3] << 16) | (raw[1:-2] << 8) | raw[2:-1]  # 24 bits from each byte on
        at, out = np.asarray(starts, np.int64).copy(), np.zeros((STEP, len(starts)), np.int32)
        for k in range(STEP):
            if k and len(at) and k == (n - 1) % STEP + 1:
                at = at[:-1]  # the last checkpoint has no further ids
            peek = (window[at >> 3] >> (24 - self.limit - (at & 7)).astype(np.uint32)) & ((1 << self.limit) - 1)
            out[k, : len(at)] = self.table_id[peek]
            at += self.table_size[peek]
        return out.T.reshape(-1)[:n]
