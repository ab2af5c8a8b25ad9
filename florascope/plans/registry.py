"""All registered queries of the library (the training-data operators register their own)."""

from . import expressions, grid, models, scalars, services, spatial, stats, store, streams  # noqa: F401
from .catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
