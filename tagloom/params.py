"""Parameter sets with defaults and legal ranges.

The numbers are fixed values: results depend on them.
"""

from __future__ import annotations

from dataclasses import dataclass, fields, replace


def _clamp(value, low, high):
    return max(low, min(high, value))


class Bounded:
    """Frozen dataclass mixin: `clamped()` returns a copy with every field inside BOUNDS."""

    BOUNDS: dict[str, tuple[float, float]] = {}

    def clamped(self):
        changes = {}
        for f in fields(self):
            if f.name in self.BOUNDS:
                low, high = self.BOUNDS[f.name]
                changes[f.name] = type(f.default)(_clamp(getattr(self, f.name), low, high))
        return replace(self, **changes)

    def check(self):
        for name, (low, high) in self.BOUNDS.items():
            value = getattr(self, name)
            if not low <= value <= high:
                raise ValueError(f"{name}={value} is outside [{low}, {high}]")
        return self


@dataclass(frozen=True)
class GraphParams(Bounded):
    max_tags: int = 100
    position_top: float = 0.9
    position_drop: float = 0.4
    forward_gain: float = 1.0
    reverse_gain: float = 0.42
    reverse_low: float = 0.25
    reverse_high: float = 0.70
    reverse_ceiling: float = 0.95
    distance_decay: float = 0.0
    unordered_gain: float = 0.49
    anchor_cap: float = 1.5
    reverse_anchor_boost: bool = False
    semantic_gain: bool = False
    low_similarity: float = 0.1
    low_branch: float = 0.15
    low_base: float = 0.4
    bell_base: float = 0.5
    bell_height: float = 0.8
    bell_center: float = 0.65
    bell_width: float = 0.25
    compression: float = 1.0
    tension: float = 1.0
    wormhole_gain: float = 1.35
    smooth_share: float = 0.1
    hub_exponent: float = 0.3
    hub_low: float = 0.55
    hub_high: float = 1.8
    row_mass: float = 0.95
    wormhole_reserve: float = 0.05
    provenance_forward: float = 1.0
    provenance_reverse: float = 0.35
    provenance_decay: float = 0.08
    independent_floor: float = 0.15
    specificity_floor: float = 0.35

    BOUNDS = {
        "reverse_gain": (0.0, 1.0),
        "distance_decay": (0.0, 2.0),
        "compression": (0.01, 100.0),
        "row_mass": (0.1, 0.99),
    }


@dataclass(frozen=True)
class SpikeParams(Bounded):
    hops: int = 4
    momentum: float = 2.0
    firing: float = 0.10
    decay: float = 0.25
    wormhole_decay: float = 0.70
    neighbours: int = 20
    return_factor: float = 0.15
    gamma: float = 0.6
    max_states: int = 2000
    min_current: float = 0.01
    tension: float = 1.0

    BOUNDS = {"gamma": (0.05, 0.95), "return_factor": (0.0, 1.0), "hops": (1, 16)}

    def hop_weights(self) -> list[float]:
        raw = [self.gamma**h for h in range(self.hops + 1)]
        total = sum(raw)
        return [v / total for v in raw]


@dataclass(frozen=True)
class FieldParams(Bounded):
    alpha_local: float = 0.15
    alpha_transfer: float = 0.55
    max_iterations: int = 80
    tolerance: float = 1e-9
    local_domain: float = 0.8
    transfer_domain: float = 0.9

    BOUNDS = {"alpha_local": (0.0, 0.95), "alpha_transfer": (0.0, 0.95), "max_iterations": (1, 200)}


@dataclass(frozen=True)
class PyramidParams(Bounded):
    levels: int = 3
    top_k: int = 10
    stop_ratio: float = 0.1
    level_decay: float = 0.7
    core_boost_low: float = 1.2
    core_boost_range: float = 0.2
    language_penalty_unknown: float = 0.05
    language_penalty: float = 0.2
    technical_output: float = 0.08
    plain_output: float = 0.015
    emergent_top: int = 50
    base_divisor: float = 1.33
    dedup_cosine: float = 0.88
    dedup_share: float = 0.2

    BOUNDS = {"levels": (1, 8), "top_k": (1, 100)}


@dataclass(frozen=True)
class TopologyParams(Bounded):
    query_k: int = 100
    denoised_k: int = 100
    local_k: int = 100
    transfer_k: int = 100
    bm25_k: int = 50
    time_k: int = 100
    anchor_k: int = 50
    max_candidates: int = 300
    direction_floor: float = 0.05
    local_weight: float = 0.6
    transfer_weight: float = 0.4
    semantic_node: float = 0.48
    min_edge_flow: float = 0.015
    max_edges: int = 96
    distance_temperature: float = 0.35
    reverse_credit: float = 0.25
    node_only_cap: float = 0.2
    semantic_anchor: float = 0.8
    semantic_discount: float = 0.7
    specificity_floor: float = 0.35
    rarity_floor: float = 0.15
    seed_saturation: float = 2.0
    fallback_cap: float = 0.5
    bandwidth: float = 0.04
    closure_bandwidth: float = 0.1
    direct_bandwidth: float = 0.12
    min_peers: int = 3
    min_effective_peers: float = 2.5
    innovation_scale: float = 0.5
    bonus_cap: float = 0.08
    anchor_floor: float = 0.05
    anchor_z: float = 2.0
    anchor_saturation: float = 0.2
    anchor_bonus: float = 0.1
    promote_floor: float = 0.1
    promote_contrast: float = 2.0
    struct_min_omega: float = 0.12
    top_k: int = 300

    BOUNDS = {"max_candidates": (1, 2000), "max_edges": (1, 2000)}


@dataclass(frozen=True)
class CurveParams(Bounded):
    min_field_nodes: int = 3
    max_field_nodes: int = 48
    field_mass: float = 0.95
    min_entropy: float = 0.12
    weak: float = 0.06
    strong: float = 0.16
    neighbour_floor: float = 0.5
    neighbours: int = 4
    closure_floor: float = 0.2
    tail_decay: float = 0.035
    mass_floor: float = 0.02
    specificity_floor: float = 0.35
    geo_floor: float = 0.015
    geo_range: float = 0.235
    bonus_scale: float = 0.35
    direct_cap: float = 0.18
    structural_cap: float = 0.10
    thematic_cap: float = 0.035
    semantic_direct_floor: float = 0.16
    semantic_direct_range: float = 0.19
    semantic_direct_confidence: float = 0.35
    continuity_floor: float = 0.08
    max_isolation: float = 0.65
    sparse_min_contacts: int = 3
    sparse_potential: float = 0.08
    sparse_closure: float = 0.2
    sparse_conductance: float = 0.015
    sparse_cosine: float = 0.48
    sparse_relief: float = 0.55
    target_contacts: int = 3
    top_k: int = 300

    BOUNDS = {
        "min_field_nodes": (1, 64),
        "max_field_nodes": (1, 512),
        "field_mass": (0.05, 1.0),
        "neighbours": (1, 32),
        "direct_cap": (0.0, 0.5),
        "structural_cap": (0.0, 0.5),
        "thematic_cap": (0.0, 0.5),
    }


@dataclass(frozen=True)
class AuxiliaryParams(Bounded):
    """Optional reward floors of the curve ranking; off unless passed."""

    max_bonus: float = 0.018
    direct_floor: float = 0.018
    structural_floor: float = 0.012
    thematic_floor: float = 0.006
    min_fused: float = 0.12
    min_closure: float = 0.55
    min_class: float = 0.10
    exponent: float = 1.5
    identity: bool = False
    identity_potential: float = 0.80
    identity_specificity: float = 0.55
    identity_closure: float = 0.35
    identity_strength: float = 0.55
    identity_floor: float = 0.018
    identity_exponent: float = 1.25

    BOUNDS = {"max_bonus": (0.0, 0.2), "exponent": (0.1, 8.0), "identity_exponent": (0.1, 8.0)}


@dataclass(frozen=True)
class SelectionParams(Bounded):
    k: int = 3
    adaptive_ratio: float = 0.6
    adaptive_max: int = 16
    pool_floor: int = 5
    token_budget: int = 600
    seat_overhead: int = 24
    exposure_weight: float = 0.08
    exposure_tau: float = 2.0
    exposure_half_hours: float = 24.0
    recency_weight: float = 0.05
    recency_hours: float = 24.0
    overlap_weight: float = 0.04
    tie_cap: float = 0.05
    tie_tau: float = 2.0
    tie_half_days: float = 30.0
    gate: float = 0.55
    assistant_margin: float = 0.07
    min_knn_for_reward: float = 0.6
    recency_floor_days: float = 7.0
    per_parent: int = 2
    max_parents: int = 4

    BOUNDS = {"k": (1, 32), "adaptive_max": (1, 64), "token_budget": (50, 20000), "gate": (0.0, 1.0)}


@dataclass(frozen=True)
class GovernanceParams(Bounded):
    min_tags: int = 3
    max_tags: int = 5
    max_tag_length: int = 20
    synonym: float = 0.92
    near_duplicate: float = 0.95
    merge_hint: float = 0.80
    patrol_duplicate: float = 0.80
    merge_candidate: float = 0.90
    merge_age_days: float = 14.0
    merge_max_recalls: int = 1
    hub_ratio: float = 1.0 / 3.0
    hub_min_files: int = 3
    uncovered_warn: float = 0.5
    stale_days: float = 14.0

    BOUNDS = {"min_tags": (1, 10), "max_tags": (1, 20), "synonym": (0.5, 1.0), "near_duplicate": (0.5, 1.0)}


@dataclass(frozen=True)
class ReminderParams(Bounded):
    active_minutes: float = 7.0
    report_turns: int = 2
    steps: int = 40
    growth_chars: int = 50_000
    spacing_minutes: float = 5.0
    tool_ring: int = 20
    tool_warmup: int = 8
    tool_default: int = 4000
    report_chars: int = 400
    cadence_steps: int = 15
    refresh_turns: int = 8

    BOUNDS = {"active_minutes": (0.0, 600.0), "report_turns": (0, 100), "steps": (0, 1000)}
