"""All registered queries of the engine's own operators."""

from __future__ import annotations

from ..registry import ORACLES, QUERIES
from . import q_evidence, q_jobs, q_release, q_review, q_sampling, q_states, q_stats, q_validation, q_views  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
