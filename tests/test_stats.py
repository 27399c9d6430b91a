import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardfield.operators import ranks, stats


@pytest.mark.parametrize("values", [
    [1, 2, 4, 8, 16, 40], [5.0] * 50, [0.0] * 30 + [1e12], [1.5],
    [round(random.Random(3).random(), 2) for _ in range(700)],
    [random.Random(4).gauss(0, 1) for _ in range(2000)] + [1e300, -1e300],
])
def test_rank_search_quantiles_are_exact(spark, values):
    df = spark.createDataFrame([("a", float(v)) for v in values] + [("a", None)], "key string, v double")
    got = ranks.quantiles(df, [0.25, 0.5, 0.75])["a"]
    assert np.allclose(got, np.quantile(np.array(values, float), [0.25, 0.5, 0.75]), rtol=1e-12)


def test_rank_sums_with_ties(spark):
    values = [1.0] * 40 + [2.0] * 3 + [3.0, 9.0]
    df = spark.createDataFrame([("a", v) for v in values], "key string, v double")
    got = ranks.select_ranks(ranks.frame_bounds(df), [("a", r) for r in (1, 40, 41, 45)], ranks.frame_histogram(df))
    assert [got["a", r] for r in (1, 40, 41, 45)] == [(1.0, 1.0), (1.0, 40.0), (2.0, 42.0), (9.0, 58.0)]


def test_quantiles_equal_sorted_percentiles(spark):
    df = spark.range(300).select((F.col("id") * 37 % 101).cast("double").alias("x"), F.lit(None).cast("double").alias("none"),
                                 F.when(F.col("id") % 7 > 0, F.sqrt(F.col("id").cast("double"))).alias("holes"))
    probs = [0.0, 0.25, 0.5, 0.75, 1.0]
    got = stats.column_quantiles(df, ["x", "none", "holes"], probs)
    assert got["none"] == [None] * 5
    for c in ("x", "holes"):
        assert got[c] == pytest.approx(df.select(F.percentile(c, probs)).first()[0], abs=1e-12)


def test_constant_feature_scales_to_null(spark):
    df = spark.createDataFrame([(1.0, 3.0), (2.0, 3.0), (3.0, 3.0)], "a double, b double")
    rows = stats.robust_scale(df, ["a", "b"]).collect()
    assert [r["a"] for r in rows] == [-1.0, 0.0, 1.0]
    assert all(r["b"] is None for r in rows)


def test_correlation_leaves_out_constant_and_incomplete_columns(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0, 1.0), (2.0, 4.1, 5.0, None), (3.0, 5.9, 5.0, 3.0)],
                               "a double, b double, const double, holes double")
    got = {(r["reg1"], r["reg2"]): r["value"] for r in stats.correlation_matrix(df, df.columns).collect()}
    assert set(got) == {("a", "a"), ("a", "b"), ("b", "a"), ("b", "b")}
    assert math.isclose(got["a", "b"], np.corrcoef([1, 2, 3], [2, 4.1, 5.9])[0, 1])


def test_profile_of_single_and_constant_clusters(spark):
    units = spark.createDataFrame([(1, 5.0), (2, 7.0), (3, 7.0)], "unit long, v double")
    labels = spark.createDataFrame([("s", 1, 1), ("s", 2, 2), ("s", 3, 2)], "scenario string, unit long, cluster int")
    got = {r["cluster"]: r for r in stats.cluster_profile(units, labels, "v", ["scenario"]).collect()}
    assert got[1]["sd"] is None and got[1]["skew"] is None
    assert got[2]["mean"] == 7.0 and got[2]["sd"] == 0.0 and got[2]["kurt"] is None


def test_zscore_filters_after_standardising(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("b", "x", 3.0), ("c", "x", 5.0)], "reg1 string, reg2 string, value double")
    got = stats.heatmap_table(df, "m", ["a"]).collect()
    assert len(got) == 1 and got[0]["value_std"] == -1.0


def test_summary_counts_missing(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (3.0,)], "x double")
    r = stats.panel_summary(df, ["x"]).first()
    assert (r["min"], r["median"], r["max"], r["n_missing"]) == (1.0, 2.0, 3.0, 2)
