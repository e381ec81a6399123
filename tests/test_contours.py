"""Contour lines against closed forms, and lists of links against a walk."""

import numpy as np
import pandas as pd
import pytest

from statloom.operators.contours import chained, contours, levels_between


def surface(spark, f, n=13, low=-1.0, high=1.0):
    step = (high - low) / (n - 1)
    return spark.createDataFrame(pd.DataFrame([(i, j, low + i * step, low + j * step, float(f(low + i * step, low + j * step))) for i in range(n) for j in range(n)], columns=["ix", "iy", "x", "y", "z"]))


def lines(df):
    got = df.toPandas().sort_values(["level", "line", "vertex"])
    for _, g in got.groupby(["level", "line"]):
        assert g.vertex.tolist() == list(range(len(g)))
    return got


def test_plane(spark):
    got = lines(contours(surface(spark, lambda x, y: x + 2 * y + 0.013), [-1.0, 0.0, 0.5, 9.0]))
    assert got.groupby("level").line.nunique().to_dict() == {-1.0: 1, 0.0: 1, 0.5: 1} and not got.closed.any()
    np.testing.assert_allclose(got.x + 2 * got.y + 0.013, got.level, atol=1e-12)
    for level, g in got.groupby("level"):
        along = np.hypot(g.x.diff(), g.y.diff()).sum()
        ends = np.hypot(g.x.iloc[0] - g.x.iloc[-1], g.y.iloc[0] - g.y.iloc[-1])
        assert abs(along - ends) < 1e-9 and abs(ends - np.hypot(2, 1)) < 1e-9 if level == 0.0 else along > 0
        assert g.x.is_monotonic_increasing or g.x.is_monotonic_decreasing


def test_paraboloid_is_a_ring_with_the_high_side_left(spark):
    got = lines(contours(surface(spark, lambda x, y: x * x + y * y, 41), [0.25]))
    assert got.line.nunique() == 1 and got.closed.all()
    assert tuple(got[["x", "y"]].iloc[0]) == tuple(got[["x", "y"]].iloc[-1])
    np.testing.assert_allclose(np.hypot(got.x, got.y), 0.5, atol=1e-3)
    area = (got.x.to_numpy()[:-1] * got.y.to_numpy()[1:] - got.x.to_numpy()[1:] * got.y.to_numpy()[:-1]).sum() / 2
    assert abs(area + np.pi / 4) < 5e-3  # against the clock the low middle would be left


def test_two_rings_a_saddle_and_gaps(spark):
    rows = surface(spark, lambda x, y: (x * x - 0.3) ** 2 + y * y, 25)
    got = lines(contours(rows, [0.02, 0.2]))
    assert got.groupby("level").line.nunique().to_dict() == {0.02: 2, 0.2: 1}
    cross = lines(contours(surface(spark, lambda x, y: x * y + 1e-9, 8), [0.0]))
    assert cross.line.nunique() == 2
    holed = lines(contours(rows.where("not (ix = 12 and iy > 12)"), [0.2]))
    assert not holed.closed.all() and contours(rows.limit(0), [0.2]).count() == 0
    assert levels_between(rows.limit(0)) == [] and len(levels_between(rows)) == 15


def test_links_are_walked(spark):
    rng = np.random.default_rng(5)
    names = [f"n{i:03d}" for i in rng.permutation(60)]
    paths, rings = [names[:17], names[17:19], names[19:40]], [names[40:52], names[52:60]]
    links = [(0.0, a, b) for p in paths for a, b in zip(p, p[1:])] + [(0.0, a, b) for r in rings for a, b in zip(r, r[1:] + r[:1])]
    got = {r.node: (r.line, r.at, r.closed) for r in chained(spark.createDataFrame(links, "level double, node string, next string")).collect()}
    for p in paths:
        assert [got[n] for n in p] == [(p[0], i, False) for i in range(len(p))]
    for r in rings:
        k = r.index(min(r))
        assert [got[n] for n in r[k:] + r[:k]] == [(min(r), i, True) for i in range(len(r))]
