"""Registered queries: every operator on the star-schema tables, beside the SQL that checks it."""

from . import reshaping, samples, studies, summaries, testing, vectors  # noqa: F401  (they register)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
