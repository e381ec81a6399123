"""Exact quantiles by selection against numpy: ties, hot values, null groups, many groups, and what is counted at once."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from statloom.operators import quantiles
from statloom.operators.quantiles import counted, exact_quantile, exact_quantiles

SHARES = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]


def check(spark, frame, groups, shares=SHARES):
    found = exact_quantiles(spark.createDataFrame(frame).withColumn("v", F.when(~F.isnan("v"), F.col("v"))), groups, "v", shares).toPandas()
    want = frame.dropna(subset=["v"]).groupby(groups, dropna=False).v if groups else None
    if not groups:
        np.testing.assert_allclose(found.q[0], np.quantile(frame.v.dropna(), shares), rtol=1e-12)
        return
    want = {tuple("" if pd.isna(x) else x for x in (k if isinstance(k, tuple) else (k,))): np.quantile(v, shares) for k, v in want}
    assert len(found) == len(want)
    for r in found.itertuples():
        np.testing.assert_allclose(r.q, want[tuple("" if pd.isna(getattr(r, g)) else getattr(r, g) for g in groups)], rtol=1e-12)


@pytest.mark.parametrize("n", [1, 2, 3, 1000])
def test_small(spark, n):
    rng = np.random.default_rng(n)
    check(spark, pd.DataFrame({"v": rng.normal(size=n)}), [])
    check(spark, pd.DataFrame({"g": [None if x == 3 else f"g{x}" for x in rng.integers(0, 4, n)], "h": rng.integers(0, 2, n), "v": np.where(rng.random(n) < 0.1, None, rng.integers(0, 9, n)).astype(float)}), ["g", "h"]) if n > 3 else None


@pytest.mark.parametrize("kind", ["distinct", "hot", "few", "infinite"])
def test_large_groups_are_bracketed(spark, kind):
    rng = np.random.default_rng(7)
    n = 300_000
    v = rng.normal(size=n)
    if kind == "hot":
        v[: n // 3] = v[5]
    if kind == "few":
        v = rng.integers(0, 5, n).astype(float)
    if kind == "infinite":
        v[:10], v[10:20] = np.inf, -np.inf
    frame = pd.DataFrame({"g": np.where(np.arange(n) < 1000, "small", "large"), "v": v})
    check(spark, frame, ["g"], [0.05, 0.25, 0.5, 0.75, 0.95])
    rows = counted(spark.createDataFrame(frame), ["g"], "v", [0.25, 0.5, 0.75], 10_000).groupBy("g").count().collect()
    held = {r.g: r["count"] for r in rows}
    assert held["large"] <= 3 * 5 * n / 10_000 + 10 and held["small"] <= 1001


def test_many_groups_join_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "SENT_GROUPS", 10)
    rng = np.random.default_rng(2)
    check(spark, pd.DataFrame({"g": rng.integers(0, 500, 20_000), "v": rng.normal(size=20_000).round(1)}), ["g"], [0.25, 0.5])


def test_empty(spark):
    rows = spark.range(5).select(F.lit(None).cast("double").alias("v"))
    assert exact_quantile(rows, "v", 0.5) is None and exact_quantiles(rows, [], "v", [0.5]).count() == 0
