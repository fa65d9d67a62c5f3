"""All queries of the engine and their SQL."""

from __future__ import annotations

from lodestar.plans import chunk_queries, evaluation_queries, ledger_queries, retrieval_queries, stream_queries, text_queries

REGISTRIES = [m.R for m in (text_queries, retrieval_queries, chunk_queries, evaluation_queries, ledger_queries, stream_queries)]


def queries() -> dict:
    """Name to query(spark, sf_dir)."""
    return {name: f for r in REGISTRIES for name, f in r.queries.items()}


def oracle_sql() -> dict:
    """Name to DuckDB SQL."""
    return {name: sql for r in REGISTRIES for name, sql in r.oracles.items()}
