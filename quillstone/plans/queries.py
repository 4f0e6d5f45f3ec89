"""All registered queries and their SQL."""

from . import corpus, evaluation, records, reference, retrieval, rules, text  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
