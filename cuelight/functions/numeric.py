"""Arithmetic on scores, spans and sizes, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Weights and limits that results depend on.
INTEREST_WEIGHT = 0.7
AUDIO_WEIGHT = 0.3
FRAMES_MIN = 6
FRAMES_MAX = 16
SECONDS_PER_FRAME = 1.0
TOKENS_PER_FRAME = 256
CHARS_PER_TOKEN = 4
SHORT_SIDES = {"720p": 720, "1080p": 1080, "1440p": 1440, "2160p": 2160, "4k": 2160}


def clamp(value: Column, low, high) -> Column:
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return F.greatest(low, F.least(value, high))


def seconds(value: Column) -> Column:
    """Timeline positions are kept to the millisecond, halves to even."""
    return F.bround(value, 3)


def blend_score(interest: Column, audio_factor: Column) -> Column:
    mixed = INTEREST_WEIGHT * clamp(interest.cast("int"), 0, 100) + AUDIO_WEIGHT * clamp(
        audio_factor.cast("double"), 0.0, 100.0
    )
    return F.bround(mixed).cast("int")


def iou(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Shared length over the length of the common hull; 0 when either is empty."""
    shared = F.greatest(F.lit(0.0), F.least(a_end, b_end) - F.greatest(a_start, b_start))
    hull = F.greatest(a_end, b_end) - F.least(a_start, b_start)
    usable = (a_end > a_start) & (b_end > b_start)
    return F.when(usable, shared / hull).otherwise(0.0)


def frame_count(duration: Column) -> Column:
    wanted = F.floor(duration / SECONDS_PER_FRAME).cast("int")
    return F.when(duration <= 0, 0).otherwise(clamp(wanted, FRAMES_MIN, FRAMES_MAX))


def grid_columns(count: Column) -> Column:
    return F.when(count <= 0, 0).otherwise(F.ceil(F.sqrt(count.cast("double"))).cast("int"))


def grid_rows(count: Column) -> Column:
    return F.when(count <= 0, 0).otherwise(F.ceil(count / grid_columns(count)).cast("int"))


def token_estimate(prompt: Column, frames: Column) -> Column:
    text = F.greatest(F.lit(1), F.floor(F.length(prompt) / CHARS_PER_TOKEN).cast("int"))
    return text + frames * TOKENS_PER_FRAME


def scale_factor(width: Column, height: Column, preset: Column) -> Column:
    """Factor that brings the short side to the preset; null for an unknown preset."""
    table = F.create_map(*[F.lit(x) for pair in SHORT_SIDES.items() for x in pair])
    return F.try_element_at(table, preset).cast("double") / F.least(width, height)


def scaled(value: Column, factor: Column, minimum: int = 0) -> Column:
    return F.greatest(F.lit(minimum), F.bround(value * factor).cast("int"))


def scaled_even(value: Column, factor: Column) -> Column:
    whole = F.bround(value * factor).cast("int")
    return F.greatest(F.lit(2), whole + F.pmod(whole, F.lit(2)))


def decibels(level: Column) -> Column:
    """Amplitude (0..1] to dB; null for silence."""
    return F.when(level > 0, 20.0 * F.log10(level))


def audible(db: Column) -> Column:
    """True for usable loudness values: drops silence, -inf and NaN."""
    return (db > -200) & ~F.isnan(db)
