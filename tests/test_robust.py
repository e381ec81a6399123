"""Robust covariance over all rows and order statistics, against numpy."""

import numpy as np
import pandas as pd
import pytest

from statloom.functions.dist import chi2_quantile
from statloom.operators import bivariate


@pytest.mark.parametrize("k", [1, 2, 250, 499, 500])
def test_order_statistic(spark, k):
    v = np.random.default_rng(1).integers(0, 40, 500).astype(float)
    assert bivariate.order_statistic(spark.createDataFrame(pd.DataFrame({"v": v})), "v", k, 500) == np.sort(v)[k - 1]


@pytest.mark.parametrize("most", [300, 100_000])
def test_robust_covariance_counts_all_rows(spark, most):
    rng = np.random.default_rng(5)
    z = rng.multivariate_normal([1, 2], [[2, 0.8], [0.8, 1]], 3000)
    z[:400] += 25
    got = bivariate.robust_covariance(spark.createDataFrame(pd.DataFrame(z, columns=["x", "y"])), ["x", "y"], 10, most)
    assert got["outliers"] >= 400  # more than the sample of 300 could hold
    # brute force: concentration over all rows from the clean ones
    pick = np.arange(400, 3000)
    for _ in range(100):
        d = np.einsum("ij,jk,ik->i", z - z[pick].mean(0), np.linalg.inv(np.cov(z[pick].T)), z - z[pick].mean(0))
        pick = np.argsort(d, kind="stable")[: (3000 + 3) // 2]
    d = np.einsum("ij,jk,ik->i", z - z[pick].mean(0), np.linalg.inv(np.cov(z[pick].T)), z - z[pick].mean(0))
    keep = d * chi2_quantile(0.5, 2) / np.median(d) <= chi2_quantile(0.975, 2)
    np.testing.assert_allclose(got["location"], z[keep].mean(0), atol=0.03)
    np.testing.assert_allclose(got["covariance"], np.cov(z[keep].T), atol=0.08)
    assert abs(got["outliers"] - (~keep).sum()) <= 30


def test_robust_covariance_of_few_rows(spark):
    with pytest.raises(ValueError):
        bivariate.robust_covariance(spark.createDataFrame([(1.0, 2.0)], "x double, y double"), ["x", "y"])
