"""Group comparisons and simple regression as aggregates, with p-values on the result rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.tails import chi2_one_tail, t_tail


def _guarded(n: Column, minimum: int, value: Column) -> Column:
    return F.when(n >= minimum, value)


def welch_columns(prefix: str = "") -> dict[str, Column]:
    """t and degrees of freedom from columns mean_a, var_a, n_a, mean_b, var_b, n_b."""
    c = lambda name: F.col(f"{prefix}{name}").cast("double")
    va, vb = c("var_a") / c("n_a"), c("var_b") / c("n_b")
    enough = (c("n_a") >= 2) & (c("n_b") >= 2)
    t = F.try_divide(c("mean_a") - c("mean_b"), F.sqrt(va + vb))
    df = F.try_divide(
        (va + vb) * (va + vb), va * va / (c("n_a") - 1) + vb * vb / (c("n_b") - 1)
    )
    return {"t_stat": F.when(enough, t), "df": F.when(enough, df)}


def welch_test(df: DataFrame, group: Column, value: Column | str) -> DataFrame:
    """Unequal-variance t-test of the rows where ``group`` is true against the others; fewer than
    two values on a side give nulls."""
    rows = df.select(
        group.alias("_g"), (F.col(value) if isinstance(value, str) else value).alias("_v")
    ).na.drop()
    value_of = lambda g: F.when(F.col("_g") == F.lit(g), F.col("_v").cast("double"))
    sums = rows.agg(
        *[
            agg(value_of(flag)).alias(f"{name}_{side}")
            for side, flag in (("a", True), ("b", False))
            for name, agg in (("n", F.count), ("mean", F.avg), ("var", F.var_samp))
        ]
    )
    return (
        sums.withColumns(welch_columns())
        .withColumn("p_value", t_tail("t_stat", "df"))
        .select("n_a", "n_b", "mean_a", "mean_b", "t_stat", "df", "p_value")
    )


def yates_columns() -> Column:
    """Continuity-corrected chi-square of a 2x2 table in columns n11, n12, n21, n22; null when a
    margin is empty (the table is then not 2x2)."""
    cell = lambda i, j: F.col(f"n{i}{j}").cast("double")
    row = {i: cell(i, 1) + cell(i, 2) for i in (1, 2)}
    column = {j: cell(1, j) + cell(2, j) for j in (1, 2)}
    total = row[1] + row[2]
    filled = (row[1] > 0) & (row[2] > 0) & (column[1] > 0) & (column[2] > 0)
    terms = None
    for i in (1, 2):
        for j in (1, 2):
            expected = F.try_divide(row[i] * column[j], total)
            gap = F.abs(cell(i, j) - expected)
            corrected = gap - F.least(F.lit(0.5), gap)
            term = F.try_divide(corrected * corrected, expected)
            terms = term if terms is None else terms + term
    return F.when(filled, terms)


def yates_test(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """Chi-square independence of two flags with Yates' correction."""
    rows = df.select(a.alias("_a"), b.alias("_b")).na.drop()
    cells = [
        F.count_if((F.col("_a") == F.lit(x)) & (F.col("_b") == F.lit(y))).alias(f"n{i}{j}")
        for i, x in ((1, False), (2, True))
        for j, y in ((1, False), (2, True))
    ]
    return (
        rows.agg(*cells)
        .withColumn("chi2", yates_columns())
        .withColumn("p_value", chi2_one_tail("chi2"))
    )


def pearson_test(
    df: DataFrame, keys: Sequence[str], x: str, y: str, more_than: int = 10
) -> DataFrame:
    """Correlation with its two-sided p-value; null unless there are more than ``more_than``
    complete pairs."""
    pairs = df.na.drop(subset=[x, y])
    n = F.col("n")
    r = F.col("r")
    return (
        pairs.groupBy(*keys)
        .agg(F.count("*").alias("n"), F.corr(F.col(x).cast("double"), F.col(y).cast("double")).alias("r"))
        .withColumn("r", _guarded(n, more_than + 1, r))
        .withColumn("t_stat", F.try_divide(r * F.sqrt(n - 2), F.sqrt(1 - r * r)))
        .withColumn("p_value", t_tail("t_stat", n - 2))
    )


def line_fit(
    df: DataFrame, keys: Sequence[str], x: str, y: str, extra: Sequence[Column] = ()
) -> DataFrame:
    """Least-squares slope and intercept with the slope's two-sided p-value (null below three
    points or when x does not vary); ``extra`` aggregates join the same pass."""
    pairs = df.na.drop(subset=[x, y])
    xd, yd = F.col(x).cast("double"), F.col(y).cast("double")
    n, r2 = F.col("n"), F.col("r2")
    t = F.signum("slope") * F.sqrt(F.try_divide(r2 * (n - 2), 1 - r2))
    return (
        pairs.groupBy(*keys)
        .agg(
            F.count("*").alias("n"),
            F.regr_slope(yd, xd).alias("slope"),
            F.regr_intercept(yd, xd).alias("intercept"),
            F.regr_r2(yd, xd).alias("r2"),
            *extra,
        )
        .withColumn("t_stat", _guarded(n, 3, t))
        .withColumn("p_value", t_tail("t_stat", n - 2))
    )
