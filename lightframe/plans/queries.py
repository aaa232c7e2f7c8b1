"""All queries of the library."""

from lightframe.plans import jobs, q_dedup, q_more, q_reconcile, q_scalars, q_sessions, q_stream, q_timeline, q_vectors  # noqa: F401
from lightframe.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
