"""Registered queries by family; importing this package fills the registry."""

from . import agg, clean, complexity, domain, flow, grid, join, models, rolling, scalar, segment, sources  # noqa: F401
