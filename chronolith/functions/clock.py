"""Timestamps and numbers as Column expressions.  Rounding is half to even on the double product, which is rint()."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _parts(total: Column, scale: int) -> tuple[Column, Column, Column, Column]:
    hours, minutes = F.floor(total / (3600 * scale)), F.floor(total % (3600 * scale) / (60 * scale))
    return hours, minutes, F.floor(total % (60 * scale) / scale), total % scale


def format_timestamp(seconds: Column, precision: int = 1) -> Column:
    """M1: M:SS.f, or H:MM:SS.f from one hour on; negative times are 0."""
    scale = 10**precision
    h, m, s, f = _parts(F.rint(F.greatest(seconds, F.lit(0.0)) * scale).cast("long"), scale)
    tail = F.concat(F.lpad(s.cast("string"), 2, "0"), F.concat(F.lit("."), F.lpad(f.cast("string"), precision, "0")) if precision else F.lit(""))
    return F.when(h > 0, F.concat(h.cast("string"), F.lit(":"), F.lpad(m.cast("string"), 2, "0"), F.lit(":"), tail)).otherwise(F.concat(m.cast("string"), F.lit(":"), tail))


def format_clock(seconds: Column) -> Column:
    """M2: HH:MM:SS, rounded down."""
    h, m, s, _ = _parts(F.greatest(F.floor(seconds), F.lit(0)), 1)
    return F.format_string("%02d:%02d:%02d", h, m, s)


def format_cue_time(seconds: Column, mark: str) -> Column:
    """M3: HH:MM:SS,mmm with `,` for SRT and `.` for WebVTT."""
    h, m, s, ms = _parts(F.greatest(F.rint(seconds * 1000), F.lit(0.0)).cast("long"), 1000)
    return F.format_string(f"%02d:%02d:%02d{mark}%03d", h, m, s, ms)


def format_span(start: Column, end: Column, precision: int = 1) -> Column:
    """M4."""
    return F.concat(format_timestamp(start, precision), F.lit("–"), format_timestamp(end, precision))


def parse_time(text: Column) -> Column:
    """Seconds, M:S or H:M:S to seconds; null for anything else."""
    parts = F.split(text, ":")
    seconds = F.aggregate(parts, F.lit(0.0), lambda a, x: a * 60 + F.try_to_number(x, F.lit("999999999999.999999")).cast("double"))
    return F.when(text.rlike(r"^\d+(\.\d+)?$|^\d+:\d+(\.\d+)?$|^\d+:\d+:\d+(\.\d+)?$"), seconds)


def numbered_id(prefix: str, index: Column) -> Column:
    """seg_00042."""
    return F.concat(F.lit(f"{prefix}_"), F.when(index < 100_000, F.lpad(index.cast("string"), 5, "0")).otherwise(index.cast("string")))


def range_id(prefix: str, first: Column, last: Column) -> Column:
    return F.when(first == last, numbered_id(prefix, first)).otherwise(F.concat(numbered_id(prefix, first), F.lit("–"), numbered_id(prefix, last)))


def fraction(position: Column, duration: Column) -> Column:
    """Progress between 0 and 1; null without a duration."""
    return F.when(duration > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), position / duration)))


def ratio(numerator: Column, denominator: Column) -> Column:
    """P10: null where either is null or 0."""
    return F.when((numerator != 0) & (denominator != 0), numerator / denominator)


def config_key(config: Column) -> Column:
    """M8: the first 24 hex digits of the SHA-256 of a JSON text."""
    return F.substring(F.sha2(config, 256), 1, 24)
