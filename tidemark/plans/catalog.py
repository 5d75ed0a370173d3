"""All registered queries of the factor engine and their SQL for the check engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import event_factors, kernel_factors, knn, leverage, slices, sql_factors
from . import kernel_check, leverage_check

_SQL = sql_factors.FACTORS | event_factors.FACTORS


def _of(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: sql_factors.run(spark, sf_dir, sql)


QUERIES = {**{name: _of(sql) for name, sql in _SQL.items()}, **leverage.QUERIES, **kernel_factors.QUERIES, **slices.QUERIES, "knn": knn.query}
ORACLES = {**{name: sql_factors.check_sql(sql) for name, sql in _SQL.items()}, **leverage_check.ORACLES, **kernel_check.ORACLES, "knn": knn.SQL, "hawkes_intensity": kernel_factors.hawkes_sql(), **slices.ORACLES}
