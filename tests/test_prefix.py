"""Agreed words: the prefix by bit vectors is that of the edit table, with work that grows with the words alone."""

import random

from cuelake.operators import agree


def table_prefix(done, heard):
    """S4 by the whole edit table."""
    row = list(range(len(heard) + 1))
    for i, word in enumerate(done, 1):
        corner, row[0] = row[0], i
        for j, other in enumerate(heard, 1):
            corner, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, corner + (word != other))
    return max(range(len(row)), key=lambda j: (-row[j], j)) if done else 0


def test_prefix_is_that_of_the_table():
    r = random.Random(1)
    for _ in range(2000):
        letters = "abcd"[: r.randint(1, 4)]
        done, heard = ([r.choice(letters) for _ in range(r.randint(0, 14))] for _ in "ab")
        if r.random() < 0.4:
            heard = done[: r.randint(0, len(done))] + heard
        assert agree.skip_prefix(done, heard) == table_prefix(done, heard)


def test_prefix_compares_each_word_once():
    seen = 0

    class Word(str):
        __hash__ = str.__hash__

        def __eq__(self, other):
            nonlocal seen
            seen += 1
            return str.__eq__(self, other)

        def __ne__(self, other):
            nonlocal seen
            seen += 1
            return str.__ne__(self, other)

    words = [Word(f"w{i}") for i in range(200)]
    assert agree.skip_prefix(words, [Word(f"w{i}") for i in range(1, 400)]) == 199
    assert seen < 2000
