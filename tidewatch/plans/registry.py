"""Every query by name, with its oracle SQL. Importing the modules of queries fills both."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Registers a function of (spark, sf_dir)."""

    def add(function):
        QUERIES[name] = function
        if oracle:
            ORACLES[name] = oracle
        return function

    return add


from tidewatch.plans import graph_queries, ingest_queries, report_queries, stored_queries, text_queries  # noqa: E402, F401
