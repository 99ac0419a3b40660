"""Profiles of people as they were when a question was asked."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.crypto import encrypt


def snapshot(fields: dict[str, Column], keys: dict[int, bytes], version: int) -> Column:
    """The fields as encrypted JSON; absent ones are left out."""
    return encrypt(F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()])), keys, version)


def prefixed_question(question: Column, facts: dict[str, Column]) -> Column:
    """The question behind a line of what is known; alone where nothing is."""
    known = F.concat_ws(", ", *[F.when(c.isNotNull() & (c.cast("string") != ""), F.concat(F.lit(f"{k}: "), c.cast("string"))) for k, c in facts.items()])
    return F.when(known == "", question).otherwise(F.concat(F.lit("["), known, F.lit("] "), question))
