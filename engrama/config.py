"""Engine settings. A value of 0 or less switches a feature off unless noted."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

SETTING_PREFIX = "engrama."


@dataclass(frozen=True)
class Config:
    # dedup and input caps
    dedup_distance: float = 0.05
    min_dedup_chars: int = 8
    max_content_chars: int = 50_000
    max_tags: int = 64
    max_tag_chars: int = 256
    max_recall_k: int = 1000
    max_session_id_chars: int = 1024
    snippet_chars: int = 600
    embed_char_cap: int = 0
    # misses
    miss_report: bool = True
    semantic_fallback: bool = True
    semantic_fallback_k: int = 3
    # forgetting
    forget_d: float = 0.2
    strength_floor: float = 0.05
    access_history_cap: int = 32
    schema_unused_seconds: float = 0.0
    # consolidation
    min_cluster: int = 2
    max_candidates: int = 5000
    max_clusters: int = 256
    absorb_distance: float = 0.4
    schema_merge_distance: float = 0.25
    min_recurrence: int = 2
    candidate_max_age: int = 5
    min_hit_sessions: int = 1
    min_hit_epochs: int = 1
    min_schema_size: int = 0
    candidate_hit_decay: float = 0.0
    min_promotion_confidence: float = 0.0
    min_age_seconds: float = 60.0
    min_retrievals: int = 1
    min_salience: float = 0.3
    schema_margin_beta: float = 2.0
    confidence_full_at: int = 5
    # completion
    completion_iters: int = 0
    completion_beta: float = 8.0
    completion_anchor: float = 0.6
    # sparse codes
    code_expansion: int = 4
    code_sparsity: float = 0.05
    code_jaccard: float = 0.5
    code_candidates: int = 4
    code_seed: int = 0
    # segmentation
    segment_max_chars: int = 1024
    segment_max_items: int = 7
    segment_assoc_score: float = 0.8
    # relevance gate
    gate: bool = True
    elbow_sensitivity: float = 0.12
    elbow_min_points: int = 3
    elbow_min_spread: float = 0.05
    ceiling_alpha: float = 0.8
    ceiling_min_points: int = 4
    ceiling_standout: float = 0.15
    background_sample: int = 256
    background_min: int = 32
    background_drift: float = 0.25
    background_seed: int = 0
    gap: float = 0.35
    # co-access
    sr_gamma: float = 0.7
    sr_alpha: float = 0.1
    sr_window_seconds: float = 60.0
    sr_omega_max: float = 0.3
    sr_cold_start_ratio: float = 1.0
    # plasticity
    time_compression: float = 24.0
    e_ltp_seconds: float = 7200.0
    l_ltp_hits: int = 3
    habit_hits: int = 250
    ltd_per_day: float = 0.02
    habit_multiplier: float = 0.18
    habit_savings: float = 3.0
    prune_floor: float = 1e-3
    # reconsolidation
    drift_window_seconds: float = 21_600.0
    drift_alpha: float = 0.05
    drift_max: float = 0.15
    drift_min_score: float = 0.4
    # ranking
    spread_hops: int = 1
    spread_decay: float = 0.5
    spread_weight: float = 0.2
    spread_fanout: int = 8
    same_session_bonus: float = 0.05
    # encoding
    surprise_floor: float = 0.6
    surprise_boost: float = 0.1
    salience_base: float = 0.3
    # reactor
    novel_trigger: int = 32
    consolidate_cooldown: float = 600.0
    dream_events: int = 128
    dream_idle: float = 600.0
    log_capacity: int = 1024
    # replay
    replay_top_k: int = 16
    replay_min_salience: float = 0.3
    replay_gain: float = 0.3
    replay_max_scan: int = 2000
    # parity switches
    ltd_advance_clock: bool = False
    reflect_newest_first: bool = False

    @classmethod
    def from_session(cls, spark) -> Config:
        """Defaults, overridden by settings engrama.<name> of the session; a wrong value fails at once."""
        found = {}
        for f in fields(cls):
            raw = spark.conf.get(SETTING_PREFIX + f.name, None)
            if raw is None:
                continue
            kind = type(f.default)
            try:
                found[f.name] = {"true": True, "false": False}[raw.lower()] if kind is bool else kind(raw)
            except (KeyError, ValueError):
                raise ValueError(f"{SETTING_PREFIX}{f.name} takes a {kind.__name__}, not {raw!r}") from None
        return replace(cls(), **found)


DEFAULT = Config()
