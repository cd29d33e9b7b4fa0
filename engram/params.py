"""Parameters and their defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    #: The instant that ages are counted to. Never the clock: the same input gives the same result.
    as_of: str = "2026-02-05 00:00:00"
    final_limit: int = 5
    knn_limit: int = 10
    text_limit: int = 20
    bm25_k1: float = 1.2
    bm25_b: float = 0.75
    half_life_days: float = 60.0
    topic_half_life_days: float = 30.0
    feedback_boost: float = 1.3
    feedback_penalty: float = 0.5
    hot_boost: float = 1.2
    emotion_factor: float = 0.4
    attention_max: float = 1.5
    attention_base: float = 2.0
    attention_emotion: float = 1.5
    hot_topics: int = 10
    synonym_frequency: int = 10
    synonym_jaccard: float = 0.5
    synonym_together: int = 3
    expansion_limit: int = 3
    expansion_least: int = 2
    rrf_k: int = 60
    noise_chars: int = 600
    skip_least: int = 2
    group_least: int = 2
    group_age_hours: int = 72
    group_batch: int = 200
    forget_age_days: int = 30
    forget_intensity: float = 0.3
    forget_full_days: int = 60
    protect_attention: float = 1.1
    dedup_threshold: float = 0.65
    dedup_gap: float = 0.8
    dedup_candidates: int = 20
    dedup_terms: int = 8
    distill_chars: int = 4000
    distill_rows: int = 300
    distill_least: int = 20
    distill_most: int = 3000
    evaluation_top: int = 5
    evaluation_pass: float = 0.7


DEFAULT = Params()
