"""Scores, confidences and schedules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamped(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def combined(similarity: Column, confidence: Column, days: Column) -> Column:
    """Rank of a hit: similarity, confidence and freshness by 7:2:1."""
    return 0.7 * similarity + 0.2 * confidence + 0.1 * F.exp(-days / 30)


def decayed(confidence: Column, days: Column) -> Column:
    """Confidence after 14 days of grace less a tenth a week, at least 0.3."""
    return F.when(days <= 14, confidence).otherwise(F.greatest(F.lit(0.3), confidence - F.floor((days - 14) / 7) * 0.1))


def monthly_decay(confidence: Column, days: Column) -> Column:
    """Null beyond 90 days; from 30 days on times 0.95 a month."""
    return F.when(days > 90, F.lit(None).cast("double")).when(days > 30, confidence * F.pow(F.lit(0.95), F.floor(days / 30))).otherwise(confidence)


def level(score: Column) -> Column:
    return F.when(score >= 0.9, "very_high").when(score >= 0.7, "high").when(score >= 0.5, "medium").when(score >= 0.3, "low").otherwise("very_low")


def boosted(score: Column, ok: Column) -> Column:
    return clamped(score + F.when(ok, 0.1).otherwise(-0.1), 0.0, 1.0)


def retry_wait(attempt: Column, initial: float, factor: float, cap: float, most: int) -> Column:
    """Wait before an attempt; -1 beyond the last."""
    return F.when(attempt > most, F.lit(-1.0)).otherwise(F.least(F.lit(float(cap)), F.lit(float(initial)) * F.pow(F.lit(float(factor)), attempt - 1)))


def volatility(changes: Column, checks: Column) -> Column:
    """Share of checks that found a change; null with fewer than two."""
    return F.when(checks < 2, F.lit(None).cast("double")).otherwise(changes / checks)


def agreement(values: Column, sources: Column) -> Column:
    """How far sources agree, from the largest number with one value and the number of sources."""
    share = values / sources
    return F.when(share >= 1, "unanimous").when(share >= 0.7, "strong").when(share >= 0.4, "partial").otherwise("conflicting")


def percent_change(old: Column, new: Column) -> Column:
    """Rounded change in percent, halves towards plus infinity; null from 0."""
    return F.when(old != 0, F.floor((new - old) / old * 100 + 0.5).cast("long"))


def risk(block_rate: Column) -> Column:
    return F.when(block_rate >= 0.7, "very_high").when(block_rate >= 0.4, "high").when(block_rate >= 0.15, "medium").otherwise("low")


def quantised(vector: Column) -> Column:
    """Components from -1..1 as whole numbers 0..255."""
    return F.transform(vector, lambda x: F.floor((clamped(x.cast("double"), -1.0, 1.0) + 1) / 2 * 255 + 0.5).cast("int"))


def restored(codes: Column) -> Column:
    return F.transform(codes, lambda x: x / 255.0 * 2 - 1)


def human_bytes(n: Column) -> Column:
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, F.concat(F.round(n / 1024.0, 1).cast("string"), F.lit(" KB"))).otherwise(F.concat(F.round(n / 1048576.0, 1).cast("string"), F.lit(" MB")))
