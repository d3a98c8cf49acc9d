"""Every registered query with its DuckDB equivalent; the modules that define them add themselves here."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import assembly, assessment, base, bridges, dashboard, decisions, entities, evidence, headings, joining, operations, planning, querying, ranking, records, retrieval, sections, selection, state, structure, texts, usage, views

Query = Callable[[SparkSession, str], DataFrame]

FLAGSHIP = "hybrid_retrieval"
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
for _module in (usage, retrieval, records, ranking, selection, texts, decisions, joining, sections, structure, evidence, dashboard, entities, state, assessment, assembly, views, querying, planning, headings, bridges, operations):
    QUERIES |= base.queries_of(_module)
    ORACLE_SQL |= base.oracles_of(_module)
