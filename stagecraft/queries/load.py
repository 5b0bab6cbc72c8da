"""Imports every query module, so that each registers its queries."""

from stagecraft.queries import catalog, changes, io, jobs, quality, scalar, scores, stages, streams  # noqa: F401
