"""SQL twins of the registered queries, by name."""

from . import registry  # noqa: F401
from .tables import SQL

__all__ = ["SQL"]
