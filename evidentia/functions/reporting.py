"""Numbers as reports show them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NOTHING = "—"


def ratio(x: Column, digits: int = 3) -> Column:
    return F.format_string(f"%.{digits}f", x.cast("double"))


def percent(part: Column, total: Column) -> Column:
    """One decimal; a dash where the total is zero."""
    return F.when(total == 0, F.lit(NOTHING)).otherwise(F.format_string("%.1f%%", part.cast("double") * 100 / F.nullif(total, F.lit(0))))


def policy_version(model: str, top_k: int, hybrid: bool = False, pool: int = 30, rrf: int = 60, cutoff: float | None = None) -> str:
    """How an answer was retrieved, in one string: arm, neighbours, fusion, cut-off."""
    base = f"{model}/hybrid-k{pool}-rrf{rrf}" if hybrid else f"{model}/vector-k{top_k}"
    return base if cutoff is None else f"{base}-cut{cutoff:g}"
