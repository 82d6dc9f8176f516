"""Registered queries, the views they read, and the SQL that checks them."""

from __future__ import annotations

from rosterflow.catalog import access, answers, changes, events, privacy, retrieval

_AREAS = [changes, events, privacy, retrieval, answers, access]


def all_queries() -> dict:
    return {name: fn for area in _AREAS for name, fn in area.QUERIES.items()}


def all_oracles() -> dict:
    return {name: sql for area in _AREAS for name, sql in area.ORACLES.items()}
