"""Model operators: invariants and numpy cross-checks."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import attribution, clustering, forecast, nmf, regression, tfidf
from tidemark.operators.density import density_curves
from tidemark.plans.topics import run_topic_model


def features(spark, n=60, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)) * [1.0, 5.0, 0.2] + [0.0, 10.0, 1.0]
    y = x @ [2.0, -0.3, 4.0] + rng.normal(scale=0.5, size=n)
    frame = pd.DataFrame(x, columns=["a", "b", "c"]).assign(id=np.arange(n), y=y)
    return frame, spark.createDataFrame(frame)


def test_ridge_equals_normal_equations(spark):
    frame, df = features(spark)
    z = clustering.z_scores(df, ["a", "b", "c"])
    model = regression.Ridge("y", alpha=3.0).fit(regression.assemble(z, ["a", "b", "c"]))
    x = frame[["a", "b", "c"]].to_numpy()
    x = (x - x.mean(0)) / x.std(0)
    yc = frame["y"] - frame["y"].mean()
    beta = np.linalg.solve(x.T @ x + 3.0 * np.eye(3), x.T @ yc)
    np.testing.assert_allclose(model.coefficients.toArray(), beta, rtol=1e-8)


def test_sampled_attribution_adds_up_and_equals_linear(spark):
    frame, df = features(spark)
    columns = ["a", "b", "c"]
    model = regression.Ridge("y", alpha=1.0).fit(regression.assemble(df, columns))
    reference = attribution.background(df, "id", columns, size=7)
    rows = df.where("id < 10")
    sampled = attribution.permutation_attribution(rows, "id", columns, model, reference)
    exact = attribution.linear_attribution(rows, "id", columns, list(model.coefficients), reference)
    merged = sampled.toPandas().merge(exact.toPandas(), on=["id", "feature"])
    assert len(merged) == 30
    np.testing.assert_allclose(merged["phi_x"], merged["phi_y"], atol=1e-8)
    base = model.transform(regression.assemble(reference, columns)).agg(F.avg("prediction")).first()[0]
    predicted = model.transform(regression.assemble(rows, columns)).toPandas()
    totals = merged.groupby("id")["phi_x"].sum()
    np.testing.assert_allclose(totals, predicted.set_index("id")["prediction"] - base, atol=1e-8)


def test_split_does_not_depend_on_partitioning(spark):
    _, df = features(spark)
    one = regression.with_split(df, "id").orderBy("id").select("is_test", "fold").collect()
    many = regression.with_split(df.repartition(7), "id").orderBy("id").select("is_test", "fold")
    assert one == many.collect()


def test_kmeans_cost_falls_with_more_clusters(spark):
    _, df = features(spark)
    costs = [clustering.kmeans(df, ["a", "b", "c"], k=k, restarts=2)[1] for k in (2, 4, 8)]
    assert costs[0] > costs[1] > costs[2]


WORDS = [["red", "green", "blue", "pink"], ["bolt", "gear", "ring", "wheel"], ["rain", "snow", "wind", "fog"]]


def corpus(spark, n=150):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(rng.choice(WORDS[i % 3], size=12))) for i in range(n)]
    return spark.createDataFrame(rows, "id long, t string")


def test_factorisation_finds_planted_topics(spark):
    weights, model = run_topic_model(
        corpus(spark), "id", "t", topics=3, max_iter=25, stop_words=[], min_documents=2
    )
    assert all(b <= a + 1e-9 for a, b in zip(model.errors, model.errors[1:]))
    best = {r["id"]: int(np.argmax(r["weights"])) for r in weights.collect()}
    groups = [{best[i] for i in best if i % 3 == g} for g in range(3)]
    assert all(len(g) == 1 for g in groups) and len(set.union(*groups)) == 3
    terms = nmf.topic_terms(spark, model, 4).toPandas()
    topic_of_red = groups[0].pop()
    assert set(terms[terms["topic"] == topic_of_red]["term"]) & set(WORDS[0])


def test_term_weights_equal_direct_computation(spark):
    rows = [(1, "aa bb aa"), (2, "bb cc"), (3, "aa cc cc x"), (4, "")]
    df = spark.createDataFrame(rows, "id long, t string")
    out = tfidf.fit_transform(df, "id", "t", stop_words=[], min_documents=2, max_share=1.0)
    got = {(r["id"], r["term"]): r["w"] for r in out.collect()}
    idf = np.log(5 / 3) + 1  # every kept term occurs in two of four documents
    raw = {1: {"aa": 1 + np.log(2), "bb": 1.0}, 2: {"bb": 1.0, "cc": 1.0}, 3: {"aa": 1.0, "cc": 1 + np.log(2)}}
    for key, weights in raw.items():
        norm = np.sqrt(sum((w * idf) ** 2 for w in weights.values()))
        for term, w in weights.items():
            assert got.pop((key, term)) == pytest.approx(w * idf / norm)
    assert not got


def test_fit_sample_is_stable(spark):
    df = corpus(spark)
    a = {r["id"] for r in tfidf.fit_sample(df, "id", 0.5).collect()}
    b = {r["id"] for r in tfidf.fit_sample(df.repartition(9), "id", 0.5).collect()}
    assert a == b and 40 < len(a) < 110


def test_arima_recovers_its_parameters():
    rng = np.random.default_rng(2)
    shocks = rng.normal(size=3000)
    w = np.zeros(3000)
    for t in range(1, 3000):
        w[t] = 0.1 + 0.6 * w[t - 1] + shocks[t] + 0.3 * shocks[t - 1]
    _, (constant, phi, theta) = forecast.arima_path(np.cumsum(w), 5)
    assert phi == pytest.approx(0.6, abs=0.06)
    assert theta == pytest.approx(0.3, abs=0.08)
    assert constant == pytest.approx(0.1, abs=0.05)


def test_forecast_fallbacks_and_recursion(spark):
    days = pd.date_range("2024-01-01", periods=80)
    wave = pd.DataFrame({"s": "wave", "d": days.date, "v": 10.0 + (np.arange(80) % 7)})
    short = pd.DataFrame({"s": "short", "d": days[:20].date, "v": np.arange(20.0)})
    train = spark.createDataFrame(pd.concat([wave, short]))
    model = forecast.fit_lag_trees(train, "s", "d", "v", trees=5)
    out = forecast.forecast_lag_trees(train, "s", "d", "v", 12, model).toPandas()
    assert out.groupby("s")["step"].max().to_dict() == {"wave": 12, "short": 12}
    np.testing.assert_allclose(out[out["s"] == "short"]["prediction"], 9.5)
    assert out[out["s"] == "wave"]["prediction"].between(9, 17).all()


def test_density_integrates_to_one(spark):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.normal(size=300), np.zeros(200)])
    frame = pd.DataFrame({"g": "a", "v": values})
    few = pd.DataFrame({"g": "b", "v": [1.0, 2.0]})
    curve = density_curves(spark.createDataFrame(pd.concat([frame, few])), "g", "v").toPandas()
    assert set(curve["g"]) == {"a"} and len(curve) == 200
    curve = curve.sort_values("x")
    assert np.trapezoid(curve["density"], curve["x"]) == pytest.approx(1.0, abs=0.01)


def test_metrics_formulas(spark):
    df = spark.createDataFrame([(1.0, 1.5), (2.0, 2.0), (4.0, 3.0)], "y double, prediction double")
    row = regression.metrics(df, "y").first()
    assert row["rmse"] == pytest.approx(np.sqrt(1.25 / 3))
    assert row["mae"] == pytest.approx(0.5)
    assert row["r2"] == pytest.approx(1 - 1.25 / (14 / 3))
