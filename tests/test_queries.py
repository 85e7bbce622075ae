"""Queries on a small table folder give the rows of their SQL."""

import os

import pytest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = ("frame_pairs", "delay_report", "last_purchase", "clicks_near_errors", "cue_overlap", "emission_tails", "stale_drops", "soak", "event_counters", "percentiles_half_up", "word_gaps") + (
    "turn_wer", "mask_asterisks", "mask_first_letter", "mask_bleep", "mask_drop", "clauses", "clause_stats", "catalogue", "source_context", "translated_routes", "published_subtitles", "order_summary", "event_settings", "frame_report",
    "tap_files", "emit_words", "engine_words", "segment_files", "run_files", "corpus_files", "word_list_files", "emit_log", "pair_files", "lag_files", "pcm_flags", "cleaned_bytes", "filler_lines", "loop_spans",
    "av_sessions", "session_offsets", "frame_slots", "lane_states", "lane_quality", "routes", "pivots", "speech", "committed_words", "playlists", "master_playlists", "run_report")


def rows(columns, values):
    text = lambda v: "-" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(text(v) for v in r) for r in values)


def test_names_agree():
    from cuelake.plans import registry

    assert set(registry.oracle_sql()) <= set(registry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_sql(spark, name):
    import duckdb

    from cuelake.plans import registry

    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = registry.queries()[name](spark, SF), db.sql(registry.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows(columns, got.select(*columns).collect()) == rows(columns, want.project(", ".join(f'"{c}"' for c in columns)).fetchall())
