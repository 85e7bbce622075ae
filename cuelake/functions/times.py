"""Scalar functions on times, clocks and levels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ticks of the 90 kHz clock, and where it wraps.
TICKS, WRAP = 90_000, 1 << 33


def _clock(ms: Column, mark: str) -> Column:
    part = lambda unit, size: F.pmod(F.floor(ms / unit), F.lit(size))
    return F.format_string(f"%02d:%02d:%02d{mark}%03d", F.floor(ms / 3_600_000), part(60_000, 60), part(1000, 60), F.pmod(ms, F.lit(1000)))


def srt_time(seconds: Column) -> Column:
    """HH:MM:SS,mmm of seconds, rounded."""
    return _clock(F.round(F.greatest(seconds, F.lit(0.0)) * 1000).cast("long"), ",")


def vtt_time(ticks: Column) -> Column:
    """HH:MM:SS.mmm of 90 kHz ticks, cut."""
    return _clock(F.floor(F.greatest(ticks, F.lit(0)) / 90).cast("long"), ".")


def parse_time(c: Column) -> Column:
    """Seconds of HH:MM:SS,mmm or HH:MM:SS.mmm; null if it isn't one."""
    pattern = r"^\s*(\d+):(\d+):(\d+)(?:[.,](\d+))?\s*$"
    part = lambda i: F.regexp_extract(c, pattern, i)
    fraction = F.concat(F.lit("0."), part(4), F.lit("0")).cast("double")
    return F.when(c.rlike(pattern), part(1).cast("double") * 3600 + part(2).cast("double") * 60 + part(3).cast("double") + fraction)


def dbfs(ratio: Column) -> Column:
    """Decibels of a ratio, -100 at least."""
    return F.when(ratio <= 0, F.lit(-100.0)).otherwise(F.greatest(20 * F.log10(ratio), F.lit(-100.0)))


def pts_diff(a: Column, b: Column) -> Column:
    """A - b on the wrapping clock, from -2**32 on."""
    d = F.pmod(a - b, F.lit(WRAP))
    return F.when(d >= WRAP // 2, d - WRAP).otherwise(d)


def unwrap_near(pts: Column, near: Column) -> Column:
    """The value congruent to ``pts`` that is closest to ``near``."""
    return near + pts_diff(pts, F.pmod(near, F.lit(WRAP)))


def to_output_ts(due_ms: Column, anchor_ms: Column, anchor_pts: Column) -> Column:
    """A due time on the output's 90 kHz line, which begins at one hour."""
    return F.greatest(anchor_pts + (due_ms - anchor_ms) * 90, F.lit(0)) + 3600 * TICKS
