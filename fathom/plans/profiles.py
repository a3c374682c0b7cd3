"""Ranking profiles, the flags that change them, and the mode of a search."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

HYBRID, LEXICAL_ONLY, SEMANTIC_ONLY = "Hybrid", "Lexical Only", "Semantic Only"
RRF, WEIGHTED, ADAPTIVE = "RRF", "Weighted", "Adaptive"
DEFAULT_THRESHOLD = 0.55


@dataclass(frozen=True)
class RankingProfile:
    name: str
    strategy: str
    k: int = 60
    alpha_override: float | None = None
    semantic_threshold: float = 0.0
    agreement_bonus: float = 0.10
    phrase_match_bonus: float = 0.0
    rare_term_bonus: float = 0.0
    section_coverage_bonus: float = 0.0
    duplicate_penalty: float = 0.0
    metadata_ranking_enabled: bool = False
    candidate_window_multiplier: float = 2.0
    query_cache_enabled: bool = True
    embedding_cache_enabled: bool = True
    telemetry_enabled: bool = True

    @property
    def rrf_k(self) -> int | None:
        return max(1, self.k) if self.strategy == RRF else None

    @property
    def adaptive(self) -> bool:
        return self.strategy == ADAPTIVE

    @property
    def threshold(self) -> float:
        return min(1.0, max(0.0, self.semantic_threshold)) if math.isfinite(self.semantic_threshold) else DEFAULT_THRESHOLD


FAST = RankingProfile("Fast", RRF, semantic_threshold=0.55, agreement_bonus=0.05, candidate_window_multiplier=1.5)
BALANCED = RankingProfile("Balanced", WEIGHTED)
BEST = RankingProfile("Best", ADAPTIVE, 60, None, 0.55, 0.12, 0.10, 0.05, 0.03, 0.08, True, 3.0)
PROFILES = {p.name: p for p in (FAST, BALANCED, BEST)}


@dataclass(frozen=True)
class FeatureFlags:
    """None leaves the profile as it is. force_rrf goes before force_weighted."""

    force_rrf: bool | None = None
    force_weighted: bool | None = None
    rrf_k: int | None = None
    bm25_adaptive_normalization: bool | None = None
    semantic_threshold_override: float | None = None
    agreement_bonus_override: float | None = None
    phrase_match_enabled: bool | None = None
    phrase_match_bonus_override: float | None = None
    rare_term_enabled: bool | None = None
    rare_term_bonus_override: float | None = None
    section_coverage_enabled: bool | None = None
    duplicate_penalty_enabled: bool | None = None
    metadata_ranking_enabled: bool | None = None
    query_cache_enabled: bool | None = None
    embedding_cache_enabled: bool | None = None
    telemetry_enabled: bool | None = None

    def resolve(self, profile: RankingProfile) -> RankingProfile:
        p = profile
        if self.force_rrf:
            p = replace(p, strategy=RRF, k=max(1, 60 if self.rrf_k is None else self.rrf_k))
        elif self.force_weighted:
            p = replace(p, strategy=WEIGHTED)
        unit = lambda x: min(1.0, max(0.0, x))
        overrides = {"semantic_threshold": self.semantic_threshold_override, "agreement_bonus": self.agreement_bonus_override}
        for field, enabled, value in (("phrase_match_bonus", self.phrase_match_enabled, self.phrase_match_bonus_override), ("rare_term_bonus", self.rare_term_enabled, self.rare_term_bonus_override)):
            if enabled is False:
                p = replace(p, **{field: 0.0})
            else:
                overrides[field] = value
        p = replace(p, **{f: unit(v) for f, v in overrides.items() if v is not None and math.isfinite(v)})
        for field, enabled in (("section_coverage_bonus", self.section_coverage_enabled), ("duplicate_penalty", self.duplicate_penalty_enabled)):
            if enabled is False:
                p = replace(p, **{field: 0.0})
        switches = "metadata_ranking_enabled", "query_cache_enabled", "embedding_cache_enabled", "telemetry_enabled"
        p = replace(p, **{f: v for f in switches if (v := getattr(self, f)) is not None})
        if self.bm25_adaptive_normalization and p.strategy == WEIGHTED:
            p = replace(p, strategy=ADAPTIVE)
        return p


def actual_mode(requested: str, semantic_ran: bool) -> str:
    """A hybrid search whose semantic side didn't run is lexical; a semantic one stays that, and is empty."""
    return LEXICAL_ONLY if requested == HYBRID and not semantic_ran else requested


def effective_alpha(mode: str, alpha: float) -> float:
    return 1.0 if mode == LEXICAL_ONLY else 0.0 if mode == SEMANTIC_ONLY else alpha
