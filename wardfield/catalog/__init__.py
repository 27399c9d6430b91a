"""Registered queries, each with the SQL that states the same result."""

from . import basic, clustering, geography  # noqa: F401
from .clustering import flagship  # noqa: F401
from .registry import QUERIES, SQL, forget  # noqa: F401
