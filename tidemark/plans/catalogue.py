"""All queries of the core, and the SQL to hold them against."""

from __future__ import annotations

from tidemark.plans import desk, exchange, gauntlet, markets, panel, problems, relational, research, streams

_MODULES = (problems, exchange, panel, relational, research, desk, streams, gauntlet, markets)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
