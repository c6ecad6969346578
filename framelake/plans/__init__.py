"""Registered queries over the driver's tables, one for each operator of the inventory, with the same results in SQL."""

from . import aggregates, geometry, ordered, pairs, projections, samples, sources  # noqa: F401
