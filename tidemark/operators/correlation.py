"""Correlation matrices from one aggregation over wide rows, without pairing rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date
from itertools import combinations_with_replacement

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.series import with_eras


def correlation_matrix(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Long matrix ``(keys, a, b, n, corr)`` with both orders of each pair, pairwise complete.

    Every unordered pair is one ``corr`` buffer of the same aggregation.
    """
    pairs = list(combinations_with_replacement(range(len(columns)), 2))
    measures = []
    for i, j in pairs:
        x, y = F.col(columns[i]).cast("double"), F.col(columns[j]).cast("double")
        both = x.isNotNull() & y.isNotNull()
        measures += [F.count_if(both).alias(f"n_{i}_{j}"), F.corr(x, y).alias(f"c_{i}_{j}")]
    wide = df.groupBy(*keys).agg(*measures)

    def entry(a: int, b: int, i: int, j: int):
        return F.struct(
            F.lit(columns[a]).alias("a"),
            F.lit(columns[b]).alias("b"),
            F.col(f"n_{i}_{j}").alias("n"),
            F.col(f"c_{i}_{j}").alias("corr"),
        )

    entries = []
    for i, j in pairs:
        entries.append(entry(i, j, i, j))
        if i != j:
            entries.append(entry(j, i, i, j))
    return wide.select(*keys, F.inline(F.array(*entries)))


def series_correlations(
    df: DataFrame,
    when: str,
    series: str,
    value: str,
    members: Sequence[str],
    eras: Mapping[str, tuple[date, date]],
    more_than: int = 3,
) -> DataFrame:
    """Correlation matrix of the member series inside each era that has more than ``more_than``
    dates. The members are a parameter: the matrix has one row per pair of them."""
    wide = df.groupBy(when).pivot(series, list(members)).agg(F.first(value))
    eras_rows = with_eras(wide, when, eras)
    sizes = eras_rows.groupBy("era").agg(F.count("*").alias("n_dates"))
    matrix = correlation_matrix(eras_rows, ["era"], list(members))
    return matrix.join(
        F.broadcast(sizes.where(F.col("n_dates") > more_than)), "era"
    )
