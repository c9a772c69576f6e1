"""Multi-operator jobs and the registered queries."""

from __future__ import annotations

import importlib

QUERY_MODULES = ("queries_pages", "queries_jobs", "queries_monitoring", "queries_prompts", "queries_scoring", "queries_streaming", "queries_requests")


def all_queries():
    """Imports the query modules and returns the registry."""
    from pagemill.plans.registry import registered

    for module in QUERY_MODULES:
        importlib.import_module(f"pagemill.plans.{module}")
    return registered()
