"""All registered queries and their SQL counterparts."""

from __future__ import annotations

from bulwark.plans import checks, evaluation, policies, scoring, sessions, tools  # noqa: F401  (they register their queries)
from bulwark.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
