"""Tunable parameters, one frozen object per concern.

Every operator takes these as arguments with these defaults, so a run states
its own weights and thresholds and never reads a clock or an environment.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class ScoreWeights:
    # fixed values: score weights (risk is subtracted)
    fundamental: float = 0.30
    valuation: float = 0.20
    growth: float = 0.15
    technical: float = 0.10
    sentiment: float = 0.10
    catalyst: float = 0.10
    risk: float = 0.15


@dataclass(frozen=True)
class QualityWeights:
    # fixed values: data-quality weights
    price: float = 0.30
    fundamental: float = 0.30
    technical: float = 0.15
    news: float = 0.15
    events: float = 0.10


@dataclass(frozen=True)
class AnomalyWeights:
    # fixed values: anomaly component weights and trigger level
    price_change: float = 0.35
    volume: float = 0.25
    volatility: float = 0.20
    technical: float = 0.20
    trigger: float = 80.0


@dataclass(frozen=True)
class Settings:
    score: ScoreWeights = field(default_factory=ScoreWeights)
    quality: QualityWeights = field(default_factory=QualityWeights)
    anomaly: AnomalyWeights = field(default_factory=AnomalyWeights)
    # fixed values: recency windows in days for the completeness checks
    full_data_days = {"price": 30, "technical": 30, "news": 7, "events": 30}
    # fixed values: recommendation ladder, best first
    recommendation = (
        (80.0, "STRONG_OPPORTUNITY"),
        (70.0, "OPPORTUNITY"),
        (60.0, "WATCH"),
        (45.0, "NEUTRAL"),
        (30.0, "CAUTION"),
        (15.0, "HIGH_RISK"),
        (0.0, "AVOID"),
    )
    strong_level: float = 70.0
    base_confidence: float = 0.50
    min_quality: float = 0.40
    min_event_relevance: float = 0.8
    # fixed values: freshness limits in seconds
    freshness_seconds = (
        ("real_time", 60),
        ("near_real_time", 300),
        ("delayed", 900),
        ("daily", 86400),
        ("quarterly", 86400 * 90),
    )
    scoring_model: str = "investment_score_v1"
    scoring_version: str = "1.0"


SETTINGS = Settings()
