"""All registered queries of the engine, with the SQL that gives the same rows where SQL can.

A plan module registers its queries with @query; `covers` names the rows of the operator inventory that a query shows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
COVERS: dict[str, tuple[int, ...]] = {}


def query(*covers: int, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        COVERS[f.__name__] = covers
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


from tideline.plans import dates, desk, extras, feed, incidents, ledgers, marks, matching, pairs, parsers, places, rewriting, routes, rules, scalars, series, similar, sources, spelling, states, stories, streams, summaries, wording  # noqa: E402, F401
