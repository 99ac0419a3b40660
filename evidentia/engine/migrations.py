"""Schema migrations: ordered, named changes from frame to frame, each applied once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass
class Migrations:
    """``add`` registers a step of a table; ``apply`` runs those not yet applied, in order of name."""

    steps: dict[str, list[tuple[str, Callable[[DataFrame], DataFrame]]]] = field(default_factory=dict)

    def add(self, table: str, name: str):
        def register(step: Callable[[DataFrame], DataFrame]):
            own = self.steps.setdefault(table, [])
            if any(n == name for n, _ in own):
                raise ValueError(f"{table} has a step {name} already")
            own.append((name, step))
            return step

        return register

    def apply(self, table: str, df: DataFrame, applied: set[str]) -> tuple[DataFrame, list[str]]:
        """The migrated frame, and the names to be recorded with it."""
        done = []
        for name, step in sorted(self.steps.get(table, []), key=lambda s: s[0]):
            if name not in applied:
                df = step(df)
                done.append(name)
        return df, done
