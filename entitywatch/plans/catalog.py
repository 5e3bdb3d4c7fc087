"""All registered queries: name -> (builder, SQL or None)."""

from __future__ import annotations

from . import alerting, behaviour, streams, tables
from .behaviour import fastest_moves

CATALOG = {**tables.QUERIES, **behaviour.QUERIES, **alerting.QUERIES, **streams.QUERIES}

__all__ = ["CATALOG", "fastest_moves"]
