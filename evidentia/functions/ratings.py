"""Ratings, numerals and other fixed vocabularies, as lookups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Canonical codes and labels of recommendation grades and evidence levels, and full-width numerals.
GRADES = {"a": "A", "b": "B", "c": "C", "d": "D", "gpp": "GPP", "inconclusive": "Inconclusive"}
GRADE_LABELS = {"A": "강한 권고", "B": "중등도 권고", "C": "약한 권고", "D": "권고하지 않음", "GPP": "전문가 합의 권고", "Inconclusive": "권고 보류"}
LEVELS = {"very low": "Very Low", "high": "High", "moderate": "Moderate", "low": "Low", "ctb": "CTB", "insufficient": "Insufficient"}
LEVEL_LABELS = {"High": "높음", "Moderate": "중등도", "Low": "낮음", "Very Low": "매우 낮음", "CTB": "고전문헌 근거", "Insufficient": "근거 불충분"}
ROMAN = {"I": "Ⅰ", "II": "Ⅱ", "III": "Ⅲ", "IV": "Ⅳ", "V": "Ⅴ", "VI": "Ⅵ", "VII": "Ⅶ", "VIII": "Ⅷ", "IX": "Ⅸ", "X": "Ⅹ"}


def looked_up(x: Column, table: dict[str, str]) -> Column:
    """The table's entry for a value, or the value itself."""
    return F.coalesce(F.create_map(*[F.lit(v) for kv in table.items() for v in kv])[x], x)


def canonical(x: Column, table: dict[str, str]) -> Column:
    """The canonical code of a value written in any case and spacing, or the value as it is."""
    key = F.lower(F.regexp_replace(F.trim(x), r"\s+", " "))
    return F.coalesce(F.create_map(*[F.lit(v) for kv in table.items() for v in kv])[key], x)
