"""All queries of the library outside ``llm``."""

from __future__ import annotations

from importlib import import_module

GROUPS = ("corpus_queries", "question_queries", "retrieval_queries", "history_queries", "more_queries", "evidence_queries", "further_queries")


def all_queries() -> dict:
    found: dict = {}
    for group in GROUPS:
        found |= import_module(f"docketry.plans.{group}").QUERIES
    return found


def queries() -> dict:
    return {name: query for name, (query, _) in all_queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in all_queries().items() if sql}
