"""Thresholds and limits, passed explicitly to operators."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    # Defaults that results depend on.
    window_min_seconds: float = 60.0
    window_max_seconds: float = 90.0
    window_max_words: int = 450
    window_min_silence: float = 1.5

    match_threshold: float = 0.65
    match_margin: float = 0.10
    cluster_threshold: float = 0.55
    min_segment_seconds: float = 1.0
    promote_min_segments: int = 3
    promote_min_seconds: float = 5.0
    max_provisional: int = 50

    entity_min_confidence: float = 0.65
    thread_min_confidence: float = 0.65
    event_min_confidence: float = 0.60
    attribution_min_confidence: float = 0.60

    session_budget_usd: float = 5.0
    monthly_budget_usd: float = 20.0
    cost_per_1k_in: float = 0.0005
    cost_per_1k_out: float = 0.0015

    consent_required: bool = True
    consent_ttl_days: int = 365
    transcript_retention_days: int = 365
    app_mode: str = "private"

    content_profile: str = "roleplay"
    cooldown_minutes: float = 10.0
    offline_minutes: int = 5
    lease_ttl_seconds: float = 30.0
    unobserved_gap_seconds: float = 180.0
    close_grace_seconds: float = 180.0
    max_age_hours: float = 24.0

    model_retries: int = 2
    model_backoff_seconds: float = 0.5

    # Our own layout choice: the time span of one work unit of a session.
    chunk_seconds: float = 3600.0


DEFAULTS = Params()
