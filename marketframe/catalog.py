"""All queries of the library over the given tables, and their SQL."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


from marketframe.plans import panel as P
from marketframe.plans import audit_queries, book_queries, contract_queries, desk_queries, detail_queries, event_queries, file_queries, limit_queries, message_queries, panel_queries, report_queries, stream_queries, study_queries
from marketframe.plans import portfolio as B
from marketframe.session import ship
from marketframe.sources import views

MODULES = [panel_queries, contract_queries, event_queries, study_queries, limit_queries, message_queries, desk_queries, stream_queries, audit_queries, book_queries, file_queries, report_queries, detail_queries]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The carry factor's portfolio on monthly bars: panel, universe, books, holding legs, turnover, summary."""
    panel = P.factors(P.usable(views.daily_bars(spark, sf_dir, "month")))
    scored = B.score_rows(P.universe(panel, 6, 1.0), "carry_3", 2, 1, 31)
    return B.summary(B.periods(B.weigh(B.books(scored, 0.2)), 2, 10.0), 2)


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(ship(spark), sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: _shipped(q) for m in MODULES for q in m.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}


