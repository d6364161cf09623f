"""Registered queries over the given tables."""

from corrolith.plans import queries as _queries  # noqa: F401 - registers itself
from corrolith.plans import clustering, ingestion, registry, relational, retrieval, seeding  # noqa: F401
