"""Queries over the star schema and the logs."""

from . import audits, candidates, catalog, identity, inference, ingest, lineage, lines, matching, maxima, observations, orders, plans, records, recovery, refinement, reports, scopes, weights  # noqa: F401
