"""Operators against brute force on small hand-made tables."""

import re
from collections import Counter
from datetime import date, timedelta
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.functions import seeds, text
from tidemark.functions.tails import incomplete_beta
from tidemark.operators import breaks, cooccurrence, inference, order, quantiles, ranks, rollup, series
from tidemark.operators.unitroot import adf
from tidemark.plans import evidence, postings, recovery
from tidemark.sources import readers, tables


def test_exact_quantiles_on_a_hot_group(spark):
    rng = np.random.default_rng(1)
    hot = np.concatenate([rng.lognormal(size=60_000), np.full(30_000, 1.25)])
    frame = pd.DataFrame({"k": ["hot"] * len(hot) + ["cold"] * 7, "v": [*hot, *range(7)]})
    df = spark.createDataFrame(frame).repartition(7)
    probabilities = [0.0, 0.01, 0.37, 0.5, 0.99, 1.0]
    names = [f"q{i}" for i in range(6)]
    out = quantiles.exact_quantiles(df, ["k"], "v", probabilities, names, partitions=16).toPandas()
    for key, values in (("hot", hot), ("cold", np.arange(7.0))):
        row = out[out["k"] == key].iloc[0]
        np.testing.assert_allclose(row[names].astype(float), np.quantile(values, probabilities))
    overall = quantiles.exact_median(df, [], "v", "m").first()
    assert overall["m"] == pytest.approx(np.median(frame["v"]))


def test_quantiles_skip_nulls_and_keep_single_rows(spark):
    df = spark.createDataFrame([("a", 3.0), ("a", None), (None, 9.0)], "k string, v double")
    assert [tuple(r) for r in quantiles.exact_median(df, ["k"], "v", "m").collect()] == [("a", 1, 3.0)]


def test_medians_of_several_columns_keep_a_null_key(spark):
    rows = [("a", 3.0, None), ("a", 5.0, None), (None, 9.0, 2.0), ("b", None, None)]
    df = spark.createDataFrame(rows, "k string, v double, w double")
    values = {"v": F.col("v"), "w": F.col("w")}
    found = {r["k"]: (r["v"], r["w"]) for r in quantiles.exact_medians(df, ["k"], values).collect()}
    assert found == {"a": (4.0, None), None: (9.0, 2.0)}
    assert [tuple(r) for r in quantiles.exact_medians(df.limit(0), [], values).collect()] == [(None, None)]


def test_positions_and_sizes_of_ranges(spark):
    rng = np.random.default_rng(3)
    frame = pd.DataFrame({"k": np.where(rng.random(20_000) < 0.5, "hot", rng.integers(0, 50, 20_000).astype(str))})
    frame["v"] = rng.permutation(len(frame)).astype(float)
    df = spark.createDataFrame(frame).repartition(5)
    found = order.positions(df, ["k"], ["v"], "at", total="n", partitions=32).toPandas().set_index("v").sort_index()
    told = frame.set_index("v").sort_index()
    assert found["at"].tolist() == told.groupby("k").cumcount().tolist()
    assert found["n"].tolist() == told.groupby("k")["k"].transform("size").tolist()
    largest = {
        parts: order.range_parts(df, ["k", "v"], parts).groupBy("_part").count().agg(F.max("count")).first()[0]
        for parts in (4, 32)
    }
    assert largest[32] * 4 < largest[4]
    ranked = ranks.value_ranks(df, "v", keys=["k"], partitions=32).toPandas().set_index("v").sort_index()
    assert ranked["rank"].tolist() == told.reset_index().groupby("k")["v"].rank().tolist()


def average_ranks(values):
    return pd.Series(values).rank(method="average").to_numpy()


def test_ranks_spearman_and_mann_whitney(spark):
    rng = np.random.default_rng(2)
    x = np.where(rng.random(4000) < 0.4, 5.0, rng.integers(0, 900, 4000).astype(float))
    y = x + rng.normal(scale=200, size=4000).round(0)
    g = rng.random(4000) < 0.3
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y, "g": g}))
    table = ranks.value_ranks(df, "x").toPandas().set_index("v")["rank"]
    np.testing.assert_allclose(table.loc[x].to_numpy(), average_ranks(x))
    rho = np.corrcoef(average_ranks(x), average_ranks(y))[0, 1]
    assert ranks.spearman(df, "x", "y").first()["rho"] == pytest.approx(rho)
    row = ranks.mann_whitney(df, F.col("g"), "y").first()
    u = average_ranks(y)[g].sum() - g.sum() * (g.sum() + 1) / 2
    assert row["u"] == pytest.approx(u)


def test_spearman_of_rows_whose_cubed_number_is_no_long(spark):
    rows = 2_100_000
    assert rows**3 > 2**63
    df = spark.range(rows).select((F.col("id") % 10).alias("x"), (F.col("id") % 10 * F.col("id") % 7).alias("y"))
    i = np.arange(rows)
    rho = np.corrcoef(average_ranks(i % 10), average_ranks(i % 10 * i % 7))[0, 1]
    row = ranks.spearman(df, "x", "y").first()
    assert row["n"] == rows and row["rho"] == pytest.approx(rho, abs=1e-12)


def test_first_by_treats_null_keys_as_equal(spark):
    rows = [(3, None, "t"), (1, None, "t"), (2, "a", "t"), (5, "a", "t"), (4, None, None)]
    df = spark.createDataFrame(rows, "job_id long, company_name string, title string")
    kept = rollup.first_by(df, ["company_name", "title"], "job_id")
    # null keys group together, so 1 stands for (null, t)
    assert sorted(r["job_id"] for r in kept.collect()) == [1, 2, 4]


def test_item_pairs_equal_position_pairs(spark):
    rng = np.random.default_rng(3)
    lists = [list(rng.choice(list("abcdefg"), size=rng.integers(0, 9))) for _ in range(80)]
    lists.append(["a"] * 50 + ["b"] * 30)
    df = spark.createDataFrame([([str(v) for v in row],) for row in lists], "items array<string>")
    counts = Counter(v for row in lists for v in row)
    top = {v for v, _ in sorted(counts.items(), key=lambda p: (-p[1], p[0]))[:4]}
    expected = Counter(
        tuple(sorted(p)) for row in lists for p in combinations([v for v in row if v in top], 2)
    )
    got = cooccurrence.item_pairs(df, "items", top_n=4).collect()
    assert {(r["skill_a"], r["skill_b"]): r["weight"] for r in got} == dict(expected)


def test_clean_text_equals_the_two_step_definition(spark):
    samples = ["C++ & C#\tÜber—Straße", "  a,b ,, c ", " x y\U0001f600z", "", "KK9_-/."]
    df = spark.createDataFrame([(s,) for s in samples], "t string")

    def two_steps(s, allowed):
        return re.sub(r"\s+", " ", re.sub(rf"[^{allowed}\s]", " ", s.lower())).strip()

    out = df.select(
        text.clean_text("t").alias("a"), text.clean_text("t", keep_commas=True).alias("b")
    ).collect()
    assert [r["a"] for r in out] == [two_steps(s, "a-z0-9+#") for s in samples]
    assert [r["b"] for r in out] == [two_steps(s, "a-z0-9+#,") for s in samples]


def test_phrase_count_prefers_long_phrases(spark):
    df = spark.createDataFrame([("Renewable energy storage; energy",)], "t string")
    phrases = ["energy", "energy storage", "renewable energy"]
    assert df.select(text.count_phrases("t", phrases)).first()[0] == 2


def test_seed_merge_rules():
    merged = seeds.merge_seeds(seeds.BASE_SEEDS, seeds.DESCRIPTION_SEEDS)
    assert "ev" not in merged["renewable_energy"] and "aws" not in merged["cloud_devops"]
    assert {"kyc", "aml"} <= set(merged["fintech"])  # they return through the boost list


def test_null_and_zero_rules(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, 2.0), (None, 1.0)], "a double, b double")
    out = df.select(C.ratio("a", "b").alias("r"), C.clip("a", 2.0, 3.0).alias("c")).collect()
    assert [r["r"] for r in out] == [None, 0.5, None]
    assert [r["c"] for r in out] == [2.0, 2.0, None]
    bad = spark.createDataFrame([("NaN",), ("x",), ("7",)], "t string")
    assert [r[0] for r in bad.select(C.to_double("t")).collect()] == [None, None, 7.0]


def test_wall_clock_is_not_shifted(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.createDataFrame([("03/13/2022 02:30:00 AM",), ("bad",)], "t string")
        at = C.parse_wall_clock("t", "MM/dd/yyyy hh:mm:ss a")
        out = [r[0] for r in df.select(at.cast("string")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert out == ["2022-03-13 02:30:00", None]


def integrate(density, low, high, n=200_001):
    x = np.linspace(low, high, n)
    return np.trapezoid(density(x), x)


@pytest.mark.parametrize("a,b,x", [(0.5, 3.0, 0.2), (10.0, 1.5, 0.9), (40.5, 0.5, 0.97), (2.0, 2.0, 0.5)])
def test_incomplete_beta(a, b, x):
    # substitution t = sin(u)^2 removes the end-point singularities
    body = lambda u: np.sin(u) ** (2 * a - 1) * np.cos(u) ** (2 * b - 1)
    eps = 1e-9
    total = integrate(body, eps, np.pi / 2 - eps)
    part = integrate(body, eps, np.arcsin(np.sqrt(x)))
    assert incomplete_beta(a, b, x)[0] == pytest.approx(part / total, rel=1e-3, abs=1e-5)


def monthly_rows(values, mode="m"):
    months = pd.date_range("2015-01-01", periods=len(values), freq="MS")
    return pd.DataFrame({"mode": mode, "date": months.date, "recovery_rate": values})


def chow_by_least_squares(y, n_pre, degree):
    def rss(part):
        t = np.arange(len(part))
        fit = np.polynomial.Polynomial.fit(t, part, degree)
        return float(np.sum((part - fit(t)) ** 2))

    k = degree + 1
    split = rss(y[:n_pre]) + rss(y[n_pre:])
    return (rss(y) - split) / k / (split / (len(y) - 2 * k))


def test_break_test_equals_least_squares(spark):
    rng = np.random.default_rng(4)
    y = 1 + 0.01 * np.arange(70) + rng.normal(scale=0.1, size=70)
    df = spark.createDataFrame(monthly_rows(y))
    dates = F.array(
        *breaks.break_list([date(2017, 4, 1)], "linear"),
        *breaks.break_list([date(2017, 4, 1)], "quadratic"),
        *breaks.break_list([date(2015, 6, 1)], "linear"),
    )
    rows = breaks.break_tests(df, "mode", "date", "recovery_rate", dates).collect()
    by_key = {(r["break_date"], r["trend"]): r for r in rows}
    for degree, trend in ((1, "linear"), (2, "quadratic")):
        row = by_key[(date(2017, 4, 1), trend)]
        assert row["f_stat"] == pytest.approx(chow_by_least_squares(y, 27, degree), rel=1e-8)
    early = by_key[(date(2015, 6, 1), "linear")]
    assert early["f_stat"] is None and not early["is_break"] and early["note"] == "too few points"


def test_scan_finds_a_planted_break_and_flat_series_has_no_statistic(spark):
    rng = np.random.default_rng(5)
    y = np.where(np.arange(72) < 40, 1.0, 1.6) + rng.normal(scale=0.02, size=72)
    both = pd.concat([monthly_rows(y), monthly_rows(np.ones(72), "flat")])
    centre = date(2018, 5, 1)
    scan = breaks.sensitivity_scan(
        spark.createDataFrame(both), "mode", "date", "recovery_rate", centre
    )
    summary = {r["mode"]: r for r in breaks.scan_summary(scan, "mode", centre).collect()}
    assert summary["m"]["peak_date"] == centre and summary["m"]["shape"] == "abrupt"
    assert "flat" not in summary


def test_placebo_rejection_rate(spark):
    rng = np.random.default_rng(6)
    frames = [monthly_rows(rng.normal(size=60), f"s{i:03d}") for i in range(200)]
    dates = F.array(*breaks.break_list([date(2017, 6, 1)], "linear"))
    tests = breaks.break_tests(
        spark.createDataFrame(pd.concat(frames)), "mode", "date", "recovery_rate", dates
    )
    assert 0.01 <= tests.agg(C.share(F.col("is_break"))).first()[0] <= 0.11


def test_welch_needs_two_values_per_group(spark):
    df = spark.createDataFrame([(True, 1.0), (False, 2.0), (False, 3.0)], "g boolean, v double")
    assert inference.welch_test(df, F.col("g"), "v").first()["p_value"] is None


def test_yates_is_null_without_a_full_table(spark):
    df = spark.createDataFrame([(True, True), (False, True)], "a boolean, b boolean")
    row = inference.yates_test(df, F.col("a"), F.col("b")).first()
    assert row["chi2"] is None and row["p_value"] is None


def test_unit_root_separates_noise_from_random_walk():
    rng = np.random.default_rng(7)
    noise = rng.normal(size=200)
    assert adf(noise)[1] < 0.01
    assert adf(np.cumsum(noise))[1] > 0.05


def test_decomposition_parts_add_up(spark):
    t = np.arange(48)
    y = 10 + 0.5 * t + 3 * np.sin(2 * np.pi * t / 12)
    short = monthly_rows(np.arange(23.0), "short")
    df = spark.createDataFrame(pd.concat([monthly_rows(y), short]))
    out = series.seasonal_decompose(df, ["mode"], "date", "recovery_rate").toPandas()
    out = out.sort_values("date").reset_index(drop=True)
    assert set(out["mode"]) == {"m"}
    inner = out.dropna(subset=["trend"])
    assert len(inner) == 36
    total = inner["trend"] + inner["seasonal"] + inner["resid"]
    np.testing.assert_allclose(total, inner["recovery_rate"])
    np.testing.assert_allclose(inner["trend"], 10 + 0.5 * inner.index.to_numpy(), atol=1e-9)


def test_baseline_falls_back_per_mode(spark):
    days = [date(2020, 3, 1) + timedelta(days=i) for i in range(3)]
    rows = [(d, "old", 10.0) for d in days] + [(date(2023, 5, 1), m, 20.0) for m in ("old", "new")]
    daily = spark.createDataFrame(rows, "date date, mode string, value double")
    windows = [(date(2020, 3, 1), date(2020, 3, 15)), (date(2023, 1, 1), date(2023, 12, 31))]
    out = recovery.monthly_recovery(daily, windows).where("year = 2023").collect()
    assert {r["mode"]: r["recovery_rate"] for r in out} == {"old": 2.0, "new": 1.0}


def test_shock_fallbacks(spark):
    y = [0.9, 0.5, 0.7, 0.85, 0.9, 1.1, 1.2]
    df = spark.createDataFrame(pd.concat([monthly_rows(y), monthly_rows([1.0] * 5, "few")]))
    nowhere = (date(1990, 1, 1), date(1990, 2, 1))
    rows = recovery.shock_recovery(df, nowhere, nowhere).collect()
    assert [r["mode"] for r in rows] == ["m"]
    assert rows[0]["shock_month"] == "2015-02"
    assert rows[0]["months_to_80pct"] == pytest.approx(59 / 30)
    assert rows[0]["current_level"] == pytest.approx(np.mean(y[-6:]))


def test_verdict_labels(spark):
    one = lambda v: spark.createDataFrame([(v,)], "verdict string")
    row = evidence.overall_verdict({"L1": one("PASS"), "L2": one("WEAK"), "L3": one("PASS")}).first()
    assert (row["passed"], row["support"]) == (2, "medium")


def test_topic_labels_and_first_arg_max(spark):
    terms = spark.createDataFrame(
        [(0, "sql", 0.5), (0, "etl", 0.9), (1, "shop", 0.4)], "topic int, term string, w double"
    )
    labels = postings.topic_labels(terms, seeds.BASE_SEEDS)
    by_topic = {r["topic"]: r for r in labels.collect()}
    assert by_topic[0]["top_words"] == ["etl", "sql"] and by_topic[0]["label"] == "data_analytics"
    assert by_topic[1]["label"] == "traditional"
    weights = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.1, 0.3])], "id long, weights array<double>")
    out = {r["id"]: r for r in postings.classify_by_topic(weights, labels, "id").collect()}
    assert out[1]["primary_topic"] == 0 and out[1]["is_new_quality_nmf"]
    assert out[2]["primary_topic"] == 1 and not out[2]["is_new_quality_nmf"]


def test_broken_csv_lines_are_dropped(spark, tmp_path):
    path = tmp_path / "hourly.csv"
    path.write_text(
        "transit_timestamp,station_complex_id,station_complex,borough,ridership,transfers\n"
        '01/02/2024 03:00:00 PM,1,"Stop, A",Q,5,1\n'
        "01/02/2024 03:00:00 PM,1\n"
    )
    raw = readers.read_hourly_csv(spark, str(path))
    assert raw.select("station_complex_id").count() == 1
    assert raw.first()["station_complex"] == "Stop, A"


def test_multiline_quoted_csv(spark, tmp_path):
    path = tmp_path / "postings.csv"
    path.write_text('job_id,title,description,extra\n1,"a ""b""","line 1\nline 2",x\n')
    row = readers.read_postings_csv(spark, str(path)).first()
    assert row.asDict() == {"job_id": "1", "title": 'a "b"', "description": "line 1\nline 2"}


def test_unfinished_table_is_rebuilt(spark, tmp_path):
    path = str(tmp_path / "t")
    build = lambda n: (lambda: spark.range(n))
    assert tables.materialize(spark, path, build(3)).count() == 3
    assert tables.materialize(spark, path, build(9)).count() == 3
    (tmp_path / "t" / "_SUCCESS").unlink()
    assert tables.materialize(spark, path, build(9)).count() == 9
