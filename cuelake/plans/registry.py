"""All queries of the timed-text operators and their SQL."""

from . import captions, files, segmenting, streams, telemetry

_MODULES = (segmenting, telemetry, captions, files, streams)


def queries() -> dict:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in m.SQL.items()}
