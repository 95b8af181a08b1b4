"""All queries of the engine by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.views import History
from . import check_queries, fixture_queries, history_queries, report_queries, section_queries

_ALL = history_queries.QUERIES | report_queries.QUERIES | check_queries.QUERIES | fixture_queries.QUERIES | section_queries.QUERIES


def _query(build: Callable[[History], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: build(History(spark, sf_dir))


QUERIES = {name: _query(build) for name, (build, _) in _ALL.items()}
ORACLE_SQL = {name: text for name, (_, text) in _ALL.items() if text}
