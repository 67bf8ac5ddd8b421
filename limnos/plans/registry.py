"""Queries by name: each runs operators of the library on the given tables."""

from . import q_cases, q_eval, q_joins, q_models, q_more, q_rest, q_scalar, q_sources, q_summary  # noqa: F401  they register themselves
from .tables import QUERIES

__all__ = ["FLAGSHIP", "QUERIES"]

FLAGSHIP = "jn4_asof_nearest"
