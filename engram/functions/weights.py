"""Factors of the ranking, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from engram.params import DEFAULT, Params


def age_days(ts: Column, as_of: str) -> Column:
    return (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(ts)) / 86400e6


def decay(ts: Column, p: Params = DEFAULT) -> Column:
    """1 now, half after each half life; a future time counts as now, a missing one as 0.01."""
    age = F.greatest(age_days(ts, p.as_of), F.lit(0.0))  # greatest() passes over nulls
    return F.when(ts.isNull(), 0.01).otherwise(F.pow(F.lit(2.0), -age / p.half_life_days))


def emotion_weight(intensity: Column, p: Params = DEFAULT) -> Column:
    return 1 + F.least(F.coalesce(intensity, F.lit(0.0)), F.lit(2.0)) * p.emotion_factor


def feedback_weight(score: Column, p: Params = DEFAULT) -> Column:
    s = F.coalesce(score, F.lit(0))
    return F.when(s > 0, 1 + (p.feedback_boost - 1) * F.least(s / 3, F.lit(1.0))).when(s < 0, 1 - (1 - p.feedback_penalty) * F.least(F.abs(s) / 3, F.lit(1.0))).otherwise(1.0)


def hot_weight(hits: Column, p: Params = DEFAULT) -> Column:
    return F.when(hits >= 3, p.hot_boost).when(hits >= 1, 1 + (p.hot_boost - 1) * hits / 3).otherwise(1.0)


def attention_weight(matched: Column, total: Column, p: Params = DEFAULT) -> Column:
    return F.when(total > 0, 1 + (p.attention_max - 1) * F.least(matched / total, F.lit(1.0))).otherwise(1.0)


def similarity_of_distance(d: Column) -> Column:
    return 1 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), d / 2))
