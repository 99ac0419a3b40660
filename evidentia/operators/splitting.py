"""Texts to pieces of bounded length."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from .guideline import cut_points


def split_by_length(df: DataFrame, key: str, text: str, limit: int) -> DataFrame:
    """key, piece_no, piece: cut after sentences where possible, else at the limit; an empty text has no piece."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, x in zip(pdf[key], pdf[text]):
                x = x or ""
                cuts = [0, *cut_points(x, limit), len(x)]
                rows += [(k, i, x[a:b]) for i, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
            yield pd.DataFrame(rows, columns=[key, "piece_no", "piece"])

    return df.select(key, text).mapInPandas(run, f"{key} {kind}, piece_no int, piece string")
