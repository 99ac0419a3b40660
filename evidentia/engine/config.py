"""Configuration numbers, read leniently."""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass


def positive(env: Mapping[str, str], name: str, default: float) -> float:
    """A setting that is missing, blank, no number, or not above zero takes its default."""
    try:
        value = float(env.get(name, "").strip() or "nan")
    except ValueError:
        return default
    return value if math.isfinite(value) and value > 0 else default


@dataclass(frozen=True)
class RetrievalConfig:
    """Cut-offs of retrieval: neighbours per arm, the largest distance, the least relevance."""

    top_k: int = 5
    pool: int = 30
    distance_cutoff: float = 0.48
    score_cutoff: float = 9.0
    rrf_constant: int = 60

    @classmethod
    def of(cls, env: Mapping[str, str]) -> RetrievalConfig:
        return cls(
            top_k=int(positive(env, "TOP_K", cls.top_k)), pool=int(positive(env, "POOL", cls.pool)),
            distance_cutoff=positive(env, "DISTANCE_CUTOFF", cls.distance_cutoff), score_cutoff=positive(env, "SCORE_CUTOFF", cls.score_cutoff),
        )
