"""Orders within groups over blocks, ranks of all variables at once, and greedy groups of near points."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from statloom.operators import bivariate, mlr, ordered


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(ordered, "RANGE_ROWS", 50)
    monkeypatch.setattr(ordered, "FEWEST_RANGES", 7)


def test_groups_are_cut_into_blocks(spark, small):
    """One group holds nearly all rows, others few, one is null: positions and frames equal pandas'."""
    rng = np.random.default_rng(0)
    frame = pd.DataFrame({"at": rng.permutation(1500), "g": ["hot" if i % 10 else None if i % 30 == 0 else f"g{i % 7}" for i in range(1500)], "v": rng.normal(size=1500)})
    df = spark.createDataFrame(frame)
    got = ordered.with_position(df, "at", "pos", ["g"]).toPandas().sort_values("at")
    want = frame.sort_values("at").groupby("g", dropna=False).cumcount()
    np.testing.assert_array_equal(got.pos, want)
    made = ordered.over_rows(df, "at", lambda w: {"s": F.sum("v").over(w.rowsBetween(-3, 2)), "n": F.count("v").over(w.rowsBetween(-3, 2))}, 3, 2, ["g"], block=40).toPandas().sort_values("at")
    sums = {}
    for _, g in frame.sort_values("at").groupby("g", dropna=False):
        v = g.v.to_numpy()
        for i, a in enumerate(g["at"]):
            sums[a] = (v[max(0, i - 3) : i + 3].sum(), len(v[max(0, i - 3) : i + 3]))
    np.testing.assert_allclose(made.s, [sums[a][0] for a in made["at"]], atol=1e-12)
    np.testing.assert_array_equal(made.n, [sums[a][1] for a in made["at"]])


def test_ranges_follow_the_rows(spark, small):
    assert len(ordered.range_bounds(spark.range(1000), "id", 50)) == 19
    assert len(ordered.range_bounds(spark.range(100), "id", 50)) == 6
    assert ordered.range_bounds(spark.range(0), "id") == []


def test_ranks_and_their_exchanges(spark):
    rng = np.random.default_rng(1)
    frame = pd.DataFrame({"row": range(900), "a": rng.normal(size=900), "b": rng.integers(0, 5, 900), "c": np.where(np.arange(900) % 3 == 0, 2.5, rng.normal(size=900)), "d": rng.integers(0, 300, 900)})
    df = spark.createDataFrame(frame)
    got = bivariate.ranked(df, ["a", "b", "c", "d"]).toPandas().sort_values("row")
    for c in "abcd":
        np.testing.assert_allclose(got[c], frame[c].rank())
    plans = [bivariate.ranked(df, list(v))._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") for v in ("ab", "abcd")]
    assert plans[0] == plans[1]
    want = frame[list("abcd")].corr("spearman")
    for r in bivariate.spearman(df, list("abcd")).collect():
        assert abs(r.r - want.loc[r.v1, r.v2]) < 1e-12


@pytest.mark.parametrize("frequent", [3, 20, 100_000])
@pytest.mark.parametrize("columns", ["abcd", "ab", "bd"])
def test_ranks_of_rare_and_frequent_values(spark, frequent, columns):
    rng = np.random.default_rng(2)
    frame = pd.DataFrame({"row": range(900), "a": rng.normal(size=900), "b": rng.integers(0, 5, 900) * -0.0 + rng.integers(0, 5, 900), "c": np.where(np.arange(900) % 3 == 0, 2.5, rng.normal(size=900)), "d": rng.integers(0, 300, 900)})
    frame.loc[frame.b == 0, "b"] = np.where(rng.random((frame.b == 0).sum()) < 0.5, -0.0, 0.0)
    got = bivariate.ranked(spark.createDataFrame(frame), list(columns), frequent=frequent).toPandas().sort_values("row")
    assert len(got) == 900
    for c in columns:
        np.testing.assert_allclose(got[c], frame[c].rank())


def test_rows_of_frequent_values_do_not_move(spark):
    df = spark.range(20_000).select((F.col("id") % 11).alias("a"), (F.col("id") % 7).alias("b"), F.hash("id").alias("c"))
    plan = bivariate.ranked(df.select("a", "b"), ["a", "b"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan
    plan = bivariate.ranked(df, ["a", "b", "c"])._jdf.queryExecution().executedPlan().toString()
    assert "_row" not in plan


def greedy(m, absolute=1e-10, relative=1e-5):
    lead = np.full(len(m), -1)
    for i in range(len(m)):
        if lead[i] < 0:
            near = (np.abs(m - m[i]) <= absolute + relative * np.abs(m)).all(1) & (lead < 0) & (np.arange(len(m)) >= i)
            lead[near] = i
    return lead


def test_near_groups_equal_the_greedy_search(spark):
    """Values on both sides of a rounding edge, chains of near points, zeros, signs and large numbers."""
    rng = np.random.default_rng(3)
    base = np.r_[0.0, 1e-10, -1e-10, 0.5, -0.5, 1.0, 1e6, 0.12345678905, rng.normal(size=4)]
    m = np.stack([rng.choice(base, 250), rng.choice(base[:6], 250)], 1)
    m *= 1 + rng.choice([0, 4e-6, 8e-6, -7e-6, 1.1e-5], (250, 2))
    m[:9, 0], m[:9, 1] = 3 * (1 + 6e-6 * np.arange(9)), 1.0  # a chain
    rng.shuffle(m)
    y = rng.normal(size=250)
    lead = greedy(m)
    frame = pd.DataFrame({"row": range(250), "a": m[:, 0], "b": m[:, 1], "y": y})
    got = mlr.replicates(spark.createDataFrame(frame), ["a", "b"], "y", "row").toPandas().sort_values(["a", "b"])
    groups = pd.DataFrame({"lead": lead, "y": y}).groupby("lead").y.agg(["count", "mean", "var"]).query("count > 1")
    want = pd.DataFrame(m[groups.index], columns=["a", "b"]).assign(n=groups["count"].to_numpy(), mean=groups["mean"].to_numpy()).sort_values(["a", "b"])
    np.testing.assert_array_equal(got[["a", "b", "n"]].to_numpy(), want[["a", "b", "n"]].to_numpy())
    np.testing.assert_allclose(got["mean"], want["mean"])
