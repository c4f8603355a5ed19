"""Every query of the library, by name, with the SQL that states its result."""

from __future__ import annotations

from .plans import corpus_queries, derive_queries, evaluate_queries, lifecycle_queries, more_queries, provenance_queries, reconcile_queries, request_queries, retrieve_queries, scalar_queries, stream_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401

FLAGSHIP = "dense_topk"
