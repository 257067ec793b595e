"""Named queries of the core, and the SQL that each is held against."""

from episodelake.plans.registry import queries, sql

__all__ = ["queries", "sql"]
