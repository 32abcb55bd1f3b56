"""Parameters of the junction engine, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    """One value for each tunable rule; ``compat`` keeps the documented quirks of the published tool."""

    min_clip: int = 20
    max_clip_distance: int = 10
    min_clip_len: int = 5
    clip_quality: int = 10
    seed_k: int = 18
    seed_segments: int = 6
    seed_min_hits: int = 2
    assoc_k: int = 13
    assoc_gap: int = 13
    near_best: float = 0.75
    match: int = 1
    mismatch: int = 4
    gap_open: int = 6
    gap_extend: int = 1
    min_span: int = 30
    min_score: int = 30
    region_snap: int = 500
    min_call_score: int = 100
    mismatch_rate: float = 0.06
    homopolymer_score: int = 10
    homopolymer_density: float = 0.8
    min_pairs: int = 4
    min_pbs: float = 0.8
    min_coverage: float = 0.5
    max_masked: float = 0.8
    mate_from: int = -50
    mate_to: int = 1000
    redundancy: float = 0.8
    split_flank: int = 10
    good_fraction: float = 0.75
    max_is_sigma: int = 5
    compat: bool = True


DEFAULT = Params()
