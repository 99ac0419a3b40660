"""All registered queries of the library."""

from __future__ import annotations

from . import aggregates, documents, filters, joins, lifecycle, metrics, registry, retrieval, scalars

MODULES = (filters, joins, aggregates, scalars, documents, retrieval, lifecycle, metrics)
QUERIES, ORACLE_SQL = registry.QUERIES, registry.ORACLE_SQL
