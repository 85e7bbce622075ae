"""The queries of the training-text operators and their SQL."""

from __future__ import annotations

import importlib

#: Query: module, SQL constant (None where SQL can't express it; tests hold those against brute force).
_QUERIES = {
    "op1_quality_rules": ("quality", "OP1_SQL"),
    "op2_warc_salvage": ("warc", "OP2_SQL"),
    "op3_simhash_bktree": ("simhash", None),
    "op4_huffman_token_ids": ("token_ids", None),
    "op5_shard_ring": ("sharding", None),
    "op6_license_scan": ("licenses", None),
    "op7_repeated_strings": ("repeats", None),
    "op8_mix_sources": ("mixing", "OP8_SQL"),
    "op9_pitman_yor": ("pitman_yor", None),
    "op10_decontaminate": ("decontaminate", "OP10_SQL"),
    "op11_jaccard_join": ("jaccard", "OP11_SQL"),
    "op12_source_divergence": ("divergence", "OP12_SQL"),
    "op13_periodic_runs": ("periodic", None),
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"{__package__}.{module}"), name) for name, (module, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: getattr(importlib.import_module(f"{__package__}.{module}"), sql) for name, (module, sql) in _QUERIES.items() if sql}
