"""All registered queries and their oracles, gathered from the query modules."""

from __future__ import annotations

from factloom.plans import aggregates, asof, calendars, catalog, claims, decisions, entities, identity, intervals, knowledge, nested, ordered, packing, replay, retrieval, semantics, sets, signals, tasks, texts, vectors, verification  # noqa: F401
from factloom.plans import sources as _sources  # noqa: F401

QUERIES = catalog.QUERIES
ORACLES = catalog.ORACLES
FLAGSHIP = catalog.FLAGSHIP
