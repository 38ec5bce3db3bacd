"""All registered queries over the fixture tables, with their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import data_queries, evaluation_queries, fold_queries, join_queries, source_queries

Q = dict[str, tuple[Callable, str | None]]


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Doubles rounded, so that the order of summation doesn't show."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def _query(build: Callable) -> Callable:
    return lambda spark, sf_dir: rounded(build(spark, sf_dir))


_ALL: Q = {**evaluation_queries.QUERIES, **fold_queries.QUERIES, **data_queries.QUERIES, **join_queries.QUERIES, **source_queries.QUERIES}
QUERIES = {name: _query(build) for name, (build, _) in _ALL.items()}
ORACLES = {name: sql for name, (_, sql) in _ALL.items() if sql is not None}
