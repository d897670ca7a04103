"""Operators bound to the given tables, with the SQL that each must agree with."""

from lodestar.bindings import documents, files, parsing, rates, requests, scalars, series, spatial, streams  # noqa: F401
from lodestar.bindings.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
