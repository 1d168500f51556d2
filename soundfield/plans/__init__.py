"""Named queries over the given tables."""

from soundfield.plans import counts, live, measurements, modelling, scenarios, spatial  # noqa: F401
from soundfield.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
