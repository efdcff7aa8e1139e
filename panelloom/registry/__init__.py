"""Registered queries, and the SQL stating the same result for those SQL can state."""

from __future__ import annotations

from .base import ORACLES, QUERIES


def load():
    """Import every group of queries; returns ``(queries, oracles)``."""
    from . import aggregates, calendar, cleaning, features, joins, models, sources, tests  # noqa: F401

    return dict(QUERIES), dict(ORACLES)
