"""Loops across batches: quiet stretches are kept whole, with the result of going batch by batch."""

import random

import pandas as pd
import pytest

from cuelake.operators import guard


def turns(r, n, quiet=False):
    keys = []
    while len(keys) < n:
        keys += [r.choice(["a", "b", "", None]) for _ in range(r.randint(1, 8))] * r.randint(2, 6) if not quiet and r.random() < 0.2 else [f"w{len(keys)}"]
    start = pd.Series([300 * i + r.choice([0, 90]) for i in range(len(keys))]).cummax()
    return pd.DataFrame({"key": keys, "start_ms": start, "end_ms": start + 200, "arrival_ms": start // 560 * 560, "i": range(len(keys))})


def pruned(df, size):
    machine = guard.LoopPruner()
    out = [machine.take(df.iloc[a : a + size]) for a in range(0, len(df), size)] + [machine.end()]
    return [i for x in out if x is not None for i in x["i"]]


@pytest.mark.parametrize("seed", range(8))
def test_pruner_is_batch_by_batch(seed):
    r = random.Random(seed)
    df, recent, want = turns(r, 600), [], []
    if seed == 7:  # ends that fall
        df.loc[::5, "end_ms"] -= 900
    for _, batch in df.groupby("arrival_ms", sort=False):
        keep, recent = guard.admit(recent, list(zip(batch["key"], batch["start_ms"] / 1000, batch["end_ms"] / 1000)))
        want += batch["i"][keep].tolist()
    assert len(want) < len(df)
    for size in (1, 7, 100, 1000):
        assert pruned(df, size) == want


def test_quiet_batches_are_not_admitted_one_by_one(monkeypatch):
    calls = []
    plain = guard.admit
    monkeypatch.setattr(guard, "admit", lambda *a: calls.append(1) or plain(*a))
    df = turns(random.Random(3), 3000, quiet=True)
    assert pruned(df, 1000) == list(range(len(df))) and not calls
