"""All queries of the library proper and their SQL."""

from __future__ import annotations

from .plans import catalogue, pg_queries, statements

QUERIES = {**catalogue.QUERIES, **statements.QUERIES, **pg_queries.QUERIES}
ORACLES = {**catalogue.ORACLES, **statements.ORACLES, **pg_queries.ORACLES}
