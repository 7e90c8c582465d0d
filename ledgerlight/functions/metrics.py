"""Ratios. Halves round up, also below zero; a ratio without a denominator is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MINUTES_MANUAL, MINUTES_CORRECTION = 45.0, 3.0
LOW_CONFIDENCE = 0.75


def rounded(x: Column, scale: int = 1) -> Column:
    ten = float(10**scale)
    return F.floor(x * ten + 0.5) / ten


def share(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, None).otherwise(rounded(part.cast("double") / F.nullif(whole, F.lit(0)) * 100.0))


def accuracy(total: Column, overridden: Column) -> Column:
    return share(total - overridden, total)


def automation(validated: Column, corrected: Column, awaiting: Column) -> Column:
    return F.when(validated == 0, None).otherwise(F.greatest(F.lit(0.0), share(validated - corrected - awaiting, validated)))


def time_saved(documents: Column, overridden: Column) -> Column:
    base = documents * MINUTES_MANUAL
    return F.when(documents == 0, None).otherwise(rounded(F.greatest(F.lit(0.0), (base - overridden * MINUTES_CORRECTION) / F.nullif(base, F.lit(0.0)) * 100.0)))


def integrity(accepted: Column, discarded: Column) -> Column:
    return share(accepted, accepted + discarded)


def change_percent(current: Column, previous: Column) -> Column:
    return F.when(previous == 0, None).otherwise(rounded((current - previous).cast("double") / F.nullif(previous, F.lit(0)) * 100.0))


def direction(current: Column, previous: Column) -> Column:
    return F.when(current > previous, "up").when(current < previous, "down").otherwise("flat")
