"""All registered queries."""

from __future__ import annotations

from tallyguard.plans import (  # noqa: F401
    boosting_queries,
    case_queries,
    event_queries,
    metric_queries,
    model_queries,
    stream_queries,
)
from tallyguard.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
