"""Typed configuration: thresholds, weights and interaction rules.

Everything here ends up as literals in the plan, so Catalyst folds it.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace
from typing import Any

# Rule names in reporting order.
RULES = (
    "fast_downward_motion",
    "large_torso_angle",
    "prolonged_low_posture",
    "high_instability",
    "post_fall_low_movement",
    "low_guard",
    "facing_away",
    "reaction_delay_after_impact",
    "loss_of_control",
    "clear_danger_fall",
    "intervention_urgent",
    "high_risk_guard_strike",
    "limb_anomaly",
)
SURRENDER = "surrender_gesture"
REVIEW_HINT = "vlm_review_hint"

# Default rule weights.
RULE_WEIGHTS = {
    "fast_downward_motion": 0.0828,
    "large_torso_angle": 0.0828,
    "prolonged_low_posture": 0.0828,
    "high_instability": 0.0828,
    "post_fall_low_movement": 0.0828,
    "low_guard": 0.0736,
    "facing_away": 0.0736,
    "reaction_delay_after_impact": 0.0736,
    "loss_of_control": 0.092,
    "clear_danger_fall": 0.092,
    "intervention_urgent": 0.1012,
    "high_risk_guard_strike": 0.0,
    "limb_anomaly": 0.08,
}

# Fusion weights.
FUSION_WEIGHTS = {
    "fast_downward_motion": 0.0828,
    "large_torso_angle": 0.0828,
    "prolonged_low_posture": 0.0828,
    "high_instability": 0.0828,
    "post_fall_low_movement": 0.0828,
    "low_guard": 0.0736,
    "facing_away": 0.0736,
    "reaction_delay_after_impact": 0.0736,
    "loss_of_control": 0.086,
    "clear_danger_fall": 0.086,
    "intervention_urgent": 0.0952,
    "high_risk_guard_strike": 0.06,
    "limb_anomaly": 0.08,
    "surrender_gesture": 0.06,
    "vlm_review_hint": 0.0,
}

# Signal groups.
SIGNAL_GROUPS = {
    "fast_downward_motion": "biomechanics",
    "large_torso_angle": "biomechanics",
    "high_instability": "biomechanics",
    "prolonged_low_posture": "posture",
    "low_guard": "posture",
    "facing_away": "posture",
    "post_fall_low_movement": "inactivity",
    "reaction_delay_after_impact": "action",
    "loss_of_control": "action",
    "high_risk_guard_strike": "action",
    "clear_danger_fall": "anomaly",
    "intervention_urgent": "anomaly",
    "limb_anomaly": "anomaly",
    "surrender_gesture": "surrender",
    "vlm_review_hint": "vlm",
}


@dataclass(frozen=True)
class Interaction:
    """Adds ``boost`` when every required signal exceeds the threshold."""

    name: str
    required: tuple[str, ...]
    boost: float
    threshold: float | None = None
    rationale: str = ""


# Interaction rules.
INTERACTIONS = (
    Interaction("low_guard_instability_medium_tendency", ("low_guard", "high_instability"), 0.06, 0.08),
    Interaction("facing_away_instability_elevated", ("facing_away", "high_instability"), 0.07, 0.08),
    Interaction("low_guard_inbound_strike_review", ("low_guard", "high_risk_guard_strike"), 0.07, 0.08),
    Interaction(
        "fall_like_and_inactivity_critical_tendency", ("clear_danger_fall", "post_fall_low_movement"), 0.10, 0.08
    ),
    Interaction("surrender_like_critical_candidate_review", ("surrender_gesture",), 0.12, 0.25),
    Interaction("limb_anomaly_instability_high_review", ("limb_anomaly", "high_instability"), 0.08, 0.08),
)


@dataclass(frozen=True)
class Scale:
    """clip((x - threshold) / scale)."""

    threshold: float
    scale: float


@dataclass(frozen=True)
class RuleConfig:
    fast_downward: Scale = Scale(0.45, 0.9)
    large_torso: Scale = Scale(28.0, 40.0)
    low_posture_min_frames: float = 4.0
    low_posture_full_frames: float = 30.0
    instability: Scale = Scale(0.04, 0.10)
    post_fall_streak: float = 8.0
    post_fall_max_speed: float = 0.15
    post_fall_buffer: float = 0.05
    low_guard: Scale = Scale(0.2, 0.35)
    facing_away: Scale = Scale(0.2, 0.35)
    reaction_delay: Scale = Scale(0.2, 0.35)
    limb: Scale = Scale(0.2, 0.35)
    incoming_strike: Scale = Scale(0.15, 0.45)
    weights: Mapping[str, float] = field(default_factory=lambda: dict(RULE_WEIGHTS))
    trigger_epsilon: float = 0.08
    cuts: tuple[float, float, float] = (0.25, 0.5, 0.75)

    @classmethod
    def load(cls, values: Mapping[str, Any]) -> RuleConfig:
        """Build from a mapping; unknown keys are ignored."""
        known = {f.name for f in fields(cls)}
        kept = {}
        for k, v in values.items():
            if k not in known:
                continue
            if isinstance(v, Mapping) and k != "weights":
                v = Scale(float(v["threshold"]), float(v["scale"]))
            kept[k] = {**RULE_WEIGHTS, **v} if k == "weights" else v
        return cls(**kept)


@dataclass(frozen=True)
class FusionConfig:
    weights: Mapping[str, float] = field(default_factory=lambda: dict(FUSION_WEIGHTS))
    groups: Mapping[str, str] = field(default_factory=lambda: dict(SIGNAL_GROUPS))
    interactions: tuple[Interaction, ...] = INTERACTIONS
    threshold: float = 0.08
    cuts: tuple[float, float, float] = (0.25, 0.5, 0.75)
    damping: float = 0.35
    review_can_boost: bool = False
    review_max_boost: float = 0.0


@dataclass(frozen=True)
class EventConfig:
    merge_gap: int = 2
    min_duration: float = 0.0
    levels: tuple[str, ...] = ("HIGH", "CRITICAL")
    fps: float | None = None
    default_frame: float = 0.1


@dataclass(frozen=True)
class BusConfig:
    merge_gap: float = 0.45
    cooldown: float = 2.5
    type_cooldown: Mapping[str, float] = field(default_factory=dict)
    silence: float | None = None
    visible: float = 14.0
    capacity: int = 10_000
    cuts: tuple[float, float, float] = (0.28, 0.48, 0.72)

    @property
    def silence_seconds(self) -> float:
        return self.silence if self.silence is not None else max(2.0 * self.merge_gap, 0.6)


@dataclass(frozen=True)
class Ablation:
    """Which signals take part: groups kept (None = all), names dropped, boosts on or off."""

    name: str
    groups: tuple[str, ...] | None = None
    dropped: tuple[str, ...] = ()
    interactions: bool = True


# Ablation modes.
ABLATIONS = (
    Ablation("biomechanics_only", ("biomechanics",)),
    Ablation("posture_only", ("posture",)),
    Ablation("anomaly_only", ("anomaly",)),
    Ablation("biomechanics_plus_posture", ("biomechanics", "posture")),
    Ablation("full_fusion"),
    Ablation("full_fusion_without_interactions", interactions=False),
    Ablation("full_fusion_with_surrender_disabled", dropped=("surrender_gesture",)),
    Ablation("full_fusion_with_limb_anomaly_disabled", dropped=("limb_anomaly",)),
)

# Per profile, factor and bound of each band cut and of the trigger
# epsilon, threshold factors, and the shift and floor of the low-posture frame count.
SENSITIVITY = {
    "high": {
        "epsilon": (0.82, 0.02),
        "cuts": ((0.88, 0.05), (0.88, 0.12), (0.92, 0.28)),
        "fast_downward": 0.86,
        "large_torso": 0.90,
        "instability": 0.85,
        "posture_shift": -1,
        "band": 0.88,
    },
    "low": {
        "epsilon": (1.18, 0.25),
        "cuts": ((1.12, 0.45), (1.10, 0.65), (1.06, 0.92)),
        "fast_downward": 1.18,
        "large_torso": 1.12,
        "instability": 1.22,
        "posture_shift": 2,
        "band": 1.15,
    },
}


def with_sensitivity(cfg: RuleConfig, level: str) -> RuleConfig:
    """Thresholds for a ``low``, ``medium`` or ``high`` sensitivity profile."""
    name = str(level).strip().lower()
    if name == "medium":
        return cfg
    if name not in SENSITIVITY:
        raise ValueError(f"unknown sensitivity {level!r}")
    p = SENSITIVITY[name]
    bound = max if name == "high" else min

    def scaled(s: Scale, factor: float, cap: float | None = None) -> Scale:
        t = s.threshold * factor
        return Scale(t if cap is None else min(cap, t), s.scale)

    cap = 0.55 if name == "low" else None
    frames = int(cfg.low_posture_min_frames) + p["posture_shift"]
    return replace(
        cfg,
        trigger_epsilon=bound(p["epsilon"][1], cfg.trigger_epsilon * p["epsilon"][0]),
        cuts=tuple(bound(b, c * f) for c, (f, b) in zip(cfg.cuts, p["cuts"])),
        fast_downward=scaled(cfg.fast_downward, p["fast_downward"]),
        large_torso=scaled(cfg.large_torso, p["large_torso"]),
        instability=scaled(cfg.instability, p["instability"]),
        low_posture_min_frames=float(max(2, frames) if name == "high" else frames),
        low_guard=scaled(cfg.low_guard, p["band"], cap),
        facing_away=scaled(cfg.facing_away, p["band"], cap),
        incoming_strike=scaled(cfg.incoming_strike, p["band"], cap),
    )


__all__ = [
    "ABLATIONS",
    "Ablation",
    "BusConfig",
    "EventConfig",
    "FusionConfig",
    "INTERACTIONS",
    "Interaction",
    "RULES",
    "RULE_WEIGHTS",
    "RuleConfig",
    "Scale",
    "replace",
    "with_sensitivity",
]
