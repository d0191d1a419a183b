"""Registration of queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: str = "") -> Callable[[Query], Query]:
    """Register ``name``; ``views`` lists the named sub-queries its SQL reads."""
    from tidemark.registry.views import with_views

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(views.split(), sql)
        return fn

    return register


def shaped(df: DataFrame, columns: Mapping[str, object]) -> DataFrame:
    """Select ``name -> digits`` (a rounded double), ``name -> type name`` (a cast) or
    ``name -> None`` (as is)."""
    out: list[Column] = []
    for name, how in columns.items():
        c = F.col(name)
        if isinstance(how, int):
            c = F.round(c.cast("double"), how)
        elif isinstance(how, str):
            c = c.cast(how)
        out.append(c.alias(name))
    return df.select(*out)
