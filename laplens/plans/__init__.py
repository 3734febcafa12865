"""Registered queries, grouped by the operators they exercise."""

from laplens.plans import bundles, facts, files, filters, jobs, merged, normalise, pace, reports, sessions, tags, telemetry, trend  # noqa: F401
from laplens.plans.pace import flagship  # noqa: F401
from laplens.plans.registry import ORACLES, QUERIES  # noqa: F401
