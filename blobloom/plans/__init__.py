"""Every operator as a query over the given tables, with the same result in SQL."""

from . import aggregates, joins, scalars, sequences, sets, similarity, sources  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
