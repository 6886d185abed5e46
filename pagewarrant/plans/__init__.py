"""Registered queries and their SQL."""

from __future__ import annotations

from . import audits, components, copies, drafts, exposed, jobs, pages, records, registry, scopes

_MODULES = (drafts, pages, audits, records, registry, components, jobs, scopes, copies, exposed)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
