"""Queries over whole tables, one per operator, and their SQL where SQL can state the result."""

from laplens.llm.queries import ORACLES, QUERIES  # noqa: F401
