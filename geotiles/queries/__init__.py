"""Registered queries and their SQL, by area."""

from __future__ import annotations

from . import catalogue, features, planning, styles, tiles

AREAS = (planning, features, catalogue, tiles, styles)
QUERIES = {k: v for area in AREAS for k, v in area.QUERIES.items()}
ORACLES = {k: v for area in AREAS for k, v in area.ORACLES.items()}
