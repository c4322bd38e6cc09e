"""Every operator as a query over the given tables, with equivalent SQL beside it.

A query is a function of a session and a table folder. Where plain SQL can say the
same, the SQL stands under the same name. Both sides round computed doubles to six
decimals, and ranks and counts are whole numbers of 64 bits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kindred.catalog import (
    evaluation_queries,
    rating_queries,
    similarity_queries,
    table_queries,
    text_queries,
)

Query = Callable[[SparkSession, str], DataFrame]

_MODULES = (
    similarity_queries,
    table_queries,
    rating_queries,
    text_queries,
    evaluation_queries,
)


def all_queries() -> dict[str, Query]:
    return {name: q for module in _MODULES for name, q in module.QUERIES.items()}


def all_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.SQL.items()}
