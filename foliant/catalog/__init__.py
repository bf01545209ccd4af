"""All queries over the given tables."""

from . import access, guardrails, intake, library, limits, prompts, search  # noqa: F401
from .registry import QUERIES, SQL


def all_queries():
    return dict(QUERIES)


def all_sql():
    return dict(SQL)
