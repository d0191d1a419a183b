"""Regressors on a feature table, cross-validation and metrics, all through Spark ML."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.quantiles import exact_medians
from tidemark.runtime import cut_lineage


FEATURES = "_features"
PREDICTION = "prediction"


def hashed_bucket(key: str, buckets: int, seed: int = 42) -> Column:
    """Stable bucket of a row: the same however the table is partitioned."""
    return F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(buckets)).cast("int")


def with_split(
    df: DataFrame, key: str, test_percent: int = 20, folds: int = 5, seed: int = 42
) -> DataFrame:
    """Add ``is_test`` and a cross-validation ``fold``."""
    return df.withColumn("is_test", hashed_bucket(key, 100, seed) < test_percent).withColumn(
        "fold", hashed_bucket(key, folds, seed + 1)
    )


def impute_medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace nulls by the exact column median.

    Rows are written once, because the medians and the filling both read them.
    """
    df = cut_lineage(df)
    medians = exact_medians(df, [], {c: F.col(c) for c in columns}).select(F.struct(*columns)).scalar()
    return df.withColumns({c: F.coalesce(F.col(c), medians.getField(c)) for c in columns})


def one_hot(
    df: DataFrame, column: str, levels: Sequence[str], drop_first: bool = True
) -> DataFrame:
    """Indicator columns of the sorted levels, without the first one."""
    used = sorted(levels)[1:] if drop_first else sorted(levels)
    return df.withColumns(
        {f"{column}_{v}": (F.col(column) == F.lit(v)).cast("double") for v in used}
    )


def assemble(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol=FEATURES).transform(df)


def boosted_trees(label: str, trees: int = 200, depth: int = 5, rate: float = 0.05, seed: int = 42):
    return GBTRegressor(
        featuresCol=FEATURES, labelCol=label, predictionCol=PREDICTION, maxIter=trees,
        maxDepth=depth, stepSize=rate, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=seed,
    )


def random_forest(label: str, trees: int = 200, depth: int = 8, leaf: int = 5, seed: int = 42):
    return RandomForestRegressor(
        featuresCol=FEATURES, labelCol=label, predictionCol=PREDICTION, numTrees=trees,
        maxDepth=depth, minInstancesPerNode=leaf, featureSubsetStrategy="all", seed=seed,
    )


class Ridge:
    """``sum (y - x w)^2 + alpha |w|^2`` with a free intercept, solved by Spark's normal equations.

    Spark minimises the halved mean error on a label divided by its deviation, so the matching
    penalty is ``alpha * stddev_pop(y) / n``.
    """

    def __init__(self, label: str, alpha: float = 1.0):
        self.label, self.alpha = label, alpha

    def fit(self, train: DataFrame):
        row = train.agg(
            F.count(self.label).alias("n"), F.stddev_pop(self.label).alias("s")
        ).first()
        return LinearRegression(
            featuresCol=FEATURES, labelCol=self.label, predictionCol=PREDICTION,
            elasticNetParam=0.0, regParam=self.alpha * row["s"] / row["n"],
            standardization=False, solver="normal",
        ).fit(train)


def metric_columns(label: str, prediction: str = PREDICTION) -> list[Column]:
    """RMSE, MAE and R2 as plain aggregates (one pass; n and sample variance give the total)."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    error = y - p
    total = F.var_pop(y) * F.count(y)
    return [
        F.count(y).alias("n"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(F.abs(error)).alias("mae"),
        (1 - F.try_divide(F.sum(error * error), total)).alias("r2"),
    ]


def metrics(df: DataFrame, label: str, keys: Sequence[str] = (), prediction: str = PREDICTION):
    rows = df.na.drop(subset=[label, prediction])
    return rows.groupBy(*keys).agg(*metric_columns(label, prediction))


def cross_validate(train: DataFrame, learner, label: str, folds: int = 5) -> DataFrame:
    """One metric row per fold of the ``fold`` column."""
    scored = [
        learner.fit(train.where(F.col("fold") != i))
        .transform(train.where(F.col("fold") == i))
        .select("fold", label, PREDICTION)
        for i in range(folds)
    ]
    return metrics(reduce(DataFrame.unionByName, scored), label, ["fold"])


def evaluate(
    df: DataFrame,
    name: str,
    learner,
    label: str,
    columns: Sequence[str],
    folds: int = 5,
    scale: bool = False,
) -> tuple[DataFrame, object, DataFrame]:
    """Metric row, fitted model and scored test rows of one learner on a :func:`with_split` table.

    With ``scale`` the columns are z-scored by the training rows first.
    """
    rows = scale_by_training(df, columns) if scale else df
    rows = cut_lineage(assemble(rows, columns))  # read by every fold
    train, test = rows.where(~F.col("is_test")), rows.where(F.col("is_test"))
    folds_table = cross_validate(train, learner, label, folds)
    model = learner.fit(train)
    scored = model.transform(test)
    cv = folds_table.agg(
        F.avg("rmse").alias("cv_rmse_mean"),
        F.stddev_pop("rmse").alias("cv_rmse_std"),
        F.avg("mae").alias("cv_mae_mean"),
        F.avg("r2").alias("cv_r2_mean"),
        F.stddev_pop("r2").alias("cv_r2_std"),
    )
    final = metrics(scored, label).select(
        F.col("rmse").alias("test_rmse"), F.col("mae").alias("test_mae"), F.col("r2").alias("test_r2")
    )
    one = F.lit(name).alias("model")
    row = cv.select(one, "*").join(final.select(one, "*"), "model")
    return row, model, scored


def scale_by_training(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """z-scores with the mean and population deviation of the training rows."""
    train = df.where(~F.col("is_test"))
    summary = train.agg(
        F.struct(
            *[F.avg(c).alias(f"m_{c}") for c in columns],
            *[F.stddev_pop(c).alias(f"s_{c}") for c in columns],
        ).alias("s")
    ).scalar()
    return df.withColumns(
        {
            c: (F.col(c) - summary.getField(f"m_{c}"))
            / F.when(summary.getField(f"s_{c}") == 0, 1.0).otherwise(summary.getField(f"s_{c}"))
            for c in columns
        }
    )


def compare_models(rows: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, rows)


def correlation_signs(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """Sign of each feature's correlation with the label."""
    wide = df.agg(*[F.corr(F.col(c).cast("double"), F.col(label).cast("double")).alias(c) for c in columns])
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("feature"), F.col(c).alias("corr"), F.signum(c).alias("sign"))
            for c in columns
        ]
    )
    return wide.select(F.inline(rows))
