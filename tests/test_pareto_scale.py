"""Dominance counts, fronts and densities beyond one task, against plain numpy."""

import numpy as np
import pandas as pd
import pytest

from statloom.operators import charts, pareto
from statloom.operators.pareto import dominance_count, dominators, fronts_of, peeled, weight_above


def plain_counts(m):
    return np.array([((m >= x).all(1) & (m > x).any(1)).sum() for x in m])


def points(kind, n, d, seed=0):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(n, d)).round(6)
    if kind == "ties":
        m = rng.integers(0, 7, (n, d)).astype(float)
    if kind == "hot":
        m[: n // 3, 0], m[n // 3 : n // 2, -1] = 1.5, -0.25
    if kind == "conflict":
        m[:, -1] = -m[:, :-1].sum(1)
    return m


@pytest.mark.parametrize("d", [1, 2, 3, 4])
def test_weights_above(d, monkeypatch):
    a, q = points("ties", 300, d), points("ties", 200, d, 1)
    w = np.random.default_rng(2).integers(1, 5, 300)
    want = np.array([w[(a >= x).all(1)].sum() for x in q])
    np.testing.assert_array_equal(weight_above(a, w, q), want)
    monkeypatch.setattr(pareto, "PAIRS", 0)
    np.testing.assert_array_equal(weight_above(a, w, q), want)


@pytest.mark.parametrize(("kind", "d"), [("ties", 2), ("hot", 3), ("conflict", 4)])
def test_dominance_counts(spark, monkeypatch, kind, d):
    monkeypatch.setattr(pareto, "GROUP", 40)
    m = points(kind, 400, d)
    frame = pd.DataFrame(m, columns=[f"x{i}" for i in range(d)]).assign(row_id=range(len(m)))
    found = dominance_count(spark.createDataFrame(frame), "row_id", {f"x{i}": ("maximize",) for i in range(d)}).toPandas().sort_values("row_id")
    np.testing.assert_array_equal(found.dominated_by, plain_counts(m))


def test_no_group_holds_a_frequent_value(spark, monkeypatch):
    """The old limit of 100,000 distinct points, with a third of them at one value of an objective."""
    n = 120_000
    m = points("hot", n, 2)
    frame = pd.DataFrame(m, columns=["a", "b"]).drop_duplicates()
    df = spark.createDataFrame(frame)
    found = dominators(df.selectExpr("a", "b", "1L as k"), ["a", "b"]).toPandas()
    assert len(found) == len(frame)
    order = frame.sort_values(["a", "b"], ascending=False)
    some = order.iloc[:: len(order) // 300]
    got = found.set_index(["a", "b"]).dominated_by
    for a, b in some.itertuples(index=False):
        assert got[(a, b)] == ((frame.a >= a) & (frame.b >= b)).sum() - 1


@pytest.mark.parametrize("kind", ["plain", "conflict"])
def test_fronts_beyond_one_task(spark, monkeypatch, kind):
    monkeypatch.setattr(pareto, "GROUP", 100)
    monkeypatch.setattr(pareto, "ONE_TASK", 50)
    monkeypatch.setattr(pareto, "CHUNK", 200)
    m = np.unique(points(kind, 1500, 4), axis=0)
    names = ["a", "b", "c", "d"]
    found = fronts_of(spark.createDataFrame(pd.DataFrame(m, columns=names)), names, 3).toPandas().sort_values(names)
    rank = peeled(m, 3)
    np.testing.assert_array_equal(found[names].to_numpy(), m[rank > 0])
    np.testing.assert_array_equal(found.pareto_rank, rank[rank > 0])


@pytest.mark.parametrize("kind", ["normal", "outlier", "two", "discrete"])
def test_density_is_exact(spark, kind):
    rng = np.random.default_rng(1)
    v = {"normal": rng.normal(50, 3, 4000), "outlier": np.r_[rng.normal(0, 1, 3000), 1e5], "two": np.array([1.0, 2.0]), "discrete": rng.integers(0, 6, 5000).astype(float)}[kind]
    found = charts.density(spark.createDataFrame(pd.DataFrame({"v": v})), "v").toPandas().sort_values("point")
    h = v.std(ddof=1) * len(v) ** -0.2
    x = np.linspace(v.min() - v.std(), v.max() + v.std(), 200)
    want = np.array([np.exp(-(((p - v) / h) ** 2) / 2).sum() for p in x]) / (len(v) * h * np.sqrt(2 * np.pi))
    np.testing.assert_allclose(found.x, x, rtol=1e-9, atol=1e-9)
    np.testing.assert_allclose(found.density, want, atol=1e-11 * want.max() + 1e-300, rtol=1e-9 if kind != "outlier" else 1e-6)


def test_sums_that_round_alike_hide_no_dominance():
    points = np.stack([np.full(1500, 1e16), np.arange(1500) * 1e-4], 1)
    assert pareto.front_mask(points).tolist() == [False] * 1499 + [True]


def test_survivors_of_many_tasks_are_dropped_again(spark, monkeypatch):
    rng = np.random.default_rng(8)
    points = rng.random((8000, 3))
    df = spark.createDataFrame(points.tolist(), "a double, b double, c double").repartition(8)
    monkeypatch.setattr(pareto, "ONE_TASK", 500)

    def unused(*_):
        raise AssertionError("the fronts fit into one task")

    monkeypatch.setattr(pareto, "dominators", unused)
    got = {(r.a, r.b, r.c): r.pareto_rank for r in pareto.fronts_of(df, ["a", "b", "c"], 3).collect()}
    want = pareto.peeled(points, 3)
    assert got == {tuple(p): r for p, r in zip(points.tolist(), want.tolist()) if r}
