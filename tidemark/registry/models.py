"""Clustering, regression, attribution and forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import attribution as A
from tidemark.operators import boosting as B
from tidemark.operators import clustering as C
from tidemark.operators import forecast as T
from tidemark.operators import regression as G
from tidemark.operators.series import hold_out
from tidemark.registry.core import query, shaped
from tidemark.registry.stations import (
    _YEARLY_MEANS,
    FEATURES_SQL,
    station_features,
    yearly_features,
    yearly_stations,
)
from tidemark.registry.views import v_points, v_series
from tidemark.runtime import cut_lineage

_CLUSTER_COLUMNS = [
    "commute_ratio",
    "peak_morning",
    "peak_evening",
    "entries_cv",
    "avg_daily_entries",
    "recovery",
]
_LOGGED = ["peak_morning", "peak_evening", "avg_daily_entries"]


def cluster_input(spark, d):
    """Complete station rows; a missing recovery counts as 1, volumes are logged."""
    rows = station_features(spark, d).withColumn("recovery", F.coalesce("recovery", F.lit(1.0)))
    rows = rows.na.drop(subset=_CLUSTER_COLUMNS)
    return rows.withColumns({c: F.log1p(c) for c in _LOGGED})


@query(
    "j5_z_scores",
    f"""WITH {FEATURES_SQL}, k AS (SELECT station_id, commute_ratio, ln(1 + peak_morning)
          AS peak_morning, ln(1 + peak_evening) AS peak_evening, entries_cv,
          ln(1 + avg_daily_entries) AS avg_daily_entries, coalesce(recovery, 1.0) AS recovery FROM sf
          WHERE commute_ratio IS NOT NULL AND peak_morning IS NOT NULL AND entries_cv IS NOT NULL)
        SELECT station_id, """
    + ", ".join(
        f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 8) AS {c}"
        for c in _CLUSTER_COLUMNS
    )
    + " FROM k",
    "v_hourly",
)
def j5(spark, d):
    rows = cluster_input(spark, d).select("station_id", *_CLUSTER_COLUMNS)
    out = C.z_scores(rows, _CLUSTER_COLUMNS)
    return shaped(out, {"station_id": None, **{c: 8 for c in _CLUSTER_COLUMNS}})


@query("j6_station_clusters")
def j6(spark, d):
    """Clusters of scaled station features."""
    rows = C.z_scores(cluster_input(spark, d), _CLUSTER_COLUMNS, "_z")
    clustered, _ = C.kmeans(
        rows, [f"{c}_z" for c in _CLUSTER_COLUMNS], k=4, restarts=20
    )
    return clustered.select("station_id", "cluster")


@query("j6_vector_clusters")
def j6_vectors(spark, d):
    """Clusters of the generic vectors."""
    parts = [F.get("features", F.lit(i)).cast("double").alias(f"x{i}") for i in range(64)]
    points = v_points(spark, d).select("id", *parts)
    clustered, _ = C.kmeans(points, [f"x{i}" for i in range(64)], k=10, restarts=20)
    return clustered.select("id", "cluster")


@query(
    "j7_cluster_profile",
    f"""WITH {FEATURES_SQL}, k AS (SELECT CAST(substr(borough, 2) AS INTEGER) AS cluster, * FROM sf)
        SELECT cluster, count(*) AS n, round(median(commute_ratio), 8) AS median_commute_ratio,
          round(median(entries_cv), 8) AS median_entries_cv,
          CASE WHEN median(commute_ratio) >= 1.2 THEN 'residential'
               WHEN median(commute_ratio) <= 0.7 THEN 'commercial'
               WHEN median(commute_ratio) BETWEEN 0.8 AND 1.2 THEN 'commuter' ELSE 'mixed' END
            || ' (C' || cluster || ')' AS cluster_name FROM k GROUP BY 1""",
    "v_hourly",
)
def j7(spark, d):
    """Profile of given clusters: the borough number stands for the cluster."""
    rows = station_features(spark, d).withColumn("cluster", F.substring("borough", 2, 9).cast("int"))
    out = C.cluster_profile(rows, "cluster", "commute_ratio", ["commute_ratio", "entries_cv"])
    medians = {"median_commute_ratio": 8, "median_entries_cv": 8}
    return shaped(out, {"cluster": "long", "n": None, **medians, "cluster_name": None})


def split_features(spark, d, include_changes: bool = True):
    matrix, columns = yearly_features(spark, d, include_changes)
    return cut_lineage(G.with_split(matrix, "station_id", folds=5)), columns


@query("j8_seeded_split")
def j8(spark, d):
    rows, _ = split_features(spark, d)
    return rows.select("station_id", "is_test", "fold")


@query("j10_boosted_trees")
def j10(spark, d):
    """200 trees of depth 5 with leaf penalties and sampled columns, five folds."""
    rows, columns = split_features(spark, d)
    return B.evaluate_boosted(rows, "boosted trees", "station_id", "recovery", columns)[0]


@query("j11_random_forest")
def j11(spark, d):
    rows, columns = split_features(spark, d)
    learner = G.random_forest("recovery", trees=200)
    return G.evaluate(rows, "random forest", learner, "recovery", columns, folds=5)[0]


@query("j12_ridge")
def j12(spark, d):
    rows, columns = split_features(spark, d)
    learner = G.Ridge("recovery")
    return G.evaluate(rows, "ridge", learner, "recovery", columns, folds=5, scale=True)[0]


_TWO = ["entries_cv", "avg_daily_entries"]

# Ridge of two z-scored features by Cramer's rule.
RIDGE_SQL = f"""{_YEARLY_MEANS},
       ks AS (SELECT station_id, borough, entries_cv, avg_daily_entries, y2000 / nullif(y1998, 0)
         AS y FROM ym),
       kf AS (SELECT * FROM ks WHERE y IS NOT NULL),
       kz AS (SELECT station_id, y,
         (entries_cv - avg(entries_cv) OVER ()) / stddev_pop(entries_cv) OVER () AS z1,
         (avg_daily_entries - avg(avg_daily_entries) OVER ())
           / stddev_pop(avg_daily_entries) OVER () AS z2, y - avg(y) OVER () AS yc FROM kf),
       km AS (SELECT sum(z1 * z1) + 1 AS a, sum(z1 * z2) AS b, sum(z2 * z2) + 1 AS c,
         sum(z1 * yc) AS p, sum(z2 * yc) AS q, avg(y) AS y0 FROM kz),
       kr AS (SELECT (c * p - b * q) / (a * c - b * b) AS b1,
         (a * q - b * p) / (a * c - b * b) AS b2, y0 FROM km)"""


def two_features(spark, d):
    rows = yearly_stations(spark, d).na.drop(subset=[*_TWO, "recovery"])
    return C.z_scores(rows.select("station_id", *_TWO, "recovery"), _TWO)


def two_feature_ridge(rows):
    return G.Ridge("recovery").fit(G.assemble(rows, _TWO))


@query(
    "j12_ridge_two_features",
    f"""WITH {RIDGE_SQL} SELECT station_id, round(y0 + b1 * z1 + b2 * z2, 8) AS prediction
        FROM kz, kr""",
    "v_yearly",
)
def j12_two(spark, d):
    rows = two_features(spark, d)
    scored = two_feature_ridge(rows).transform(G.assemble(rows, _TWO))
    return shaped(scored, {"station_id": None, "prediction": 8})


_METRICS = """count(*) AS n, round(sqrt(avg(power(y - p, 2))), 8) AS rmse,
       round(avg(abs(y - p)), 8) AS mae,
       round(1 - sum(power(y - p, 2)) / sum(power(y - m, 2)), 8) AS r2"""


def _given_predictions(spark, d):
    """Recovery with two given predictions: the borough mean and the overall mean."""
    rows = yearly_stations(spark, d).na.drop(subset=["recovery"])
    by_borough = rows.groupBy("borough").agg(F.avg("recovery").alias("borough_mean"))
    overall = rows.agg(F.avg("recovery").alias("m")).scalar()
    return rows.join(by_borough, "borough").withColumn("overall_mean", overall)


@query(
    "j13_metrics",
    f"""WITH {RIDGE_SQL}, x AS (SELECT borough, y, avg(y) OVER (PARTITION BY borough) AS p,
          avg(y) OVER () AS m FROM kf)
        SELECT {_METRICS} FROM x""",
    "v_yearly",
)
def j13(spark, d):
    out = G.metrics(_given_predictions(spark, d), "recovery", prediction="borough_mean")
    return shaped(out, {"n": None, "rmse": 8, "mae": 8, "r2": 8})


@query(
    "j14_model_comparison",
    f"""WITH {RIDGE_SQL}, x AS (SELECT y, avg(y) OVER (PARTITION BY borough) AS g,
          avg(y) OVER () AS m FROM kf)
        SELECT 'borough mean' AS model, {_METRICS.replace('p,', 'g,').replace('y - p', 'y - g')} FROM x
        UNION ALL SELECT 'overall mean' AS model, {_METRICS.replace('p,', 'm,').replace('y - p', 'y - m')}
        FROM x""",
    "v_yearly",
)
def j14(spark, d):
    rows = _given_predictions(spark, d)
    out = G.compare_models(
        [
            G.metrics(rows, "recovery", prediction=c).withColumn("model", F.lit(name))
            for c, name in (("borough_mean", "borough mean"), ("overall_mean", "overall mean"))
        ]
    )
    return shaped(out, {"model": None, "n": None, "rmse": 8, "mae": 8, "r2": 8})


@query(
    "j15_linear_attribution",
    f"""WITH {RIDGE_SQL}, w AS (SELECT z.*, b1, b2, (SELECT avg(z1) FROM kz) AS m1,
          (SELECT avg(z2) FROM kz) AS m2 FROM kz z, kr)
        SELECT station_id, 'entries_cv' AS feature, round(b1 * (z1 - m1), 8) AS phi FROM w
        UNION ALL SELECT station_id, 'avg_daily_entries', round(b2 * (z2 - m2), 8) FROM w""",
    "v_yearly",
)
def j15_linear(spark, d):
    rows = two_features(spark, d)
    model = two_feature_ridge(rows)
    out = A.linear_attribution(rows, "station_id", _TWO, list(model.coefficients), rows)
    return shaped(out, {"station_id": None, "feature": None, "phi": 8})


def boosted_model(spark, d):
    """Rows, columns and the forest learned from the training rows."""
    rows, columns = split_features(spark, d)
    train = rows.where(~F.col("is_test")).withColumn("_all", F.lit(True))
    return rows, columns, B.fit(train, "station_id", "recovery", columns, ["_all"])[0]


@query("j15_tree_attribution")
def j15_trees(spark, d):
    """Exact contribution of each feature to the boosted prediction of every test row, 100 background rows."""
    rows, columns, forest = boosted_model(spark, d)
    reference = A.background(rows.where(~F.col("is_test")), "station_id", columns)
    return A.tree_attribution(rows.where("is_test"), "station_id", columns, forest, reference)


@query("j15_sampled_attribution")
def j15_sampled(spark, d):
    """Mean absolute contribution of each feature on the test rows, by the same exact values."""
    return A.importance(j15_trees(spark, d))


@query(
    "j16_correlation_signs",
    f"""WITH {RIDGE_SQL} SELECT 'entries_cv' AS feature, round(corr(z1, y), 8) AS corr,
          sign(corr(z1, y)) AS sign FROM kz
        UNION ALL SELECT 'avg_daily_entries', round(corr(z2, y), 8), sign(corr(z2, y)) FROM kz""",
    "v_yearly",
)
def j16(spark, d):
    out = G.correlation_signs(two_features(spark, d), _TWO, "recovery")
    return shaped(out, {"feature": None, "corr": 8, "sign": "long"})


def _train(spark, d, horizon: int):
    split = hold_out(v_series(spark, d), ["station_id"], "date", horizon)
    return cut_lineage(split.where(~F.col("is_test")))


@query("j17_boosted_forecast")
def j17(spark, d):
    train = _train(spark, d, 60)
    model = T.fit_lag_trees(train, "station_id", "date", "value", trees=100)
    return T.forecast_lag_trees(train, "station_id", "date", "value", 60, model)


@query("j18_arima_forecast")
def j18(spark, d):
    return T.forecast_arima(_train(spark, d, 60), "station_id", "date", "value", 60)


@query("j19_forecast_backtest")
def j19(spark, d):
    return T.backtest(v_series(spark, d), "station_id", "date", "value", horizon=60, trees=10)


