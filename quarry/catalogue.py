"""Every query of the library by name, with DuckDB SQL that gives the same rows where SQL can."""

from __future__ import annotations

from quarry.queries import catalog, engine_flows, flows, indexes, records, reports, retrieval  # noqa: F401  registers the queries
from quarry.queries.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
