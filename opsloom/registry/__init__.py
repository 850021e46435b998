"""All registered queries and their SQL twins."""

from . import aggregates, alarms, inventory, networks, ordering, records, scalars, series  # noqa: F401
from . import streams as _streams  # noqa: F401
from .core import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
