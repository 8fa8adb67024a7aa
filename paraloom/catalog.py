"""Every query of the library on the driver's tables, with its SQL where one exists."""

from __future__ import annotations

from paraloom.plans import base_queries, match_queries, read_queries

QUERIES: dict = base_queries.QUERIES | match_queries.QUERIES | read_queries.QUERIES
ORACLES: dict = base_queries.ORACLES | match_queries.ORACLES | read_queries.ORACLES
