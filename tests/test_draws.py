"""The registered nulls and bootstraps use the survey's number of draws."""

from pyspark.sql import functions as F

from panelwright.queries import ORACLES, QUERIES, inference

SF = "/root/testdata/sf0.001"


def test_draws_of_nulls(spark):
    assert inference.DRAWS >= 100
    draws = QUERIES["st1_rotation_null"](spark, SF).groupBy(F.split_part("symbol", F.lit("#"), F.lit(1))).count().collect()
    assert draws and all(r["count"] >= 100 for r in draws)


def test_resamples_of_means():
    assert "range(1, 10001)" in ORACLES["st12_bootstrap_mean"]
