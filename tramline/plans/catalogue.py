"""All registered telemetry queries."""

from __future__ import annotations

from tramline.plans import roads, roundtrips, service, telemetry  # noqa: F401
from tramline.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
