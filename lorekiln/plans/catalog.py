"""All queries: importing the operator modules registers theirs."""

from __future__ import annotations

from ..functions import filters, scores, text
from ..operators import aggregates, communities, graph, positions, prune, reconcile, relational, relations, search, topics
from ..sources import caches, imports, snapshots, tables
from ..streaming import feeds, states
from . import serving
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "aggregates", "caches", "communities", "feeds", "filters", "graph", "imports", "positions", "prune", "reconcile", "relational", "relations", "scores", "search", "serving", "snapshots", "states", "tables", "text", "topics"]
