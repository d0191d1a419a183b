"""The registered boosted forecast runs at the reference's horizon."""

import __spark_entry__ as entry_points


def test_j17_forecasts_sixty_days(spark):
    rows = entry_points.queries()["j17_boosted_forecast"](spark, "/root/testdata/sf0.001").collect()
    steps = {}
    for r in rows:
        assert r.prediction is not None
        steps.setdefault(r.station_id, []).append(r.step)
    assert steps and all(sorted(s) == list(range(1, 61)) for s in steps.values())
