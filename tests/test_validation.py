"""Validation tables, intervals at points, interpretation and export sets against numpy and by hand."""

import numpy as np
import pytest

from statloom.functions.dist import t_quantile
from statloom.operators import charts, mlr, monitor, multi, pca, surface, validation
from statloom.sources import reports
from statloom.sources.writers import write_tables


@pytest.fixture(scope="module")
def runs(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(-1, 1, (40, 2)).round(3)
    y = 3 + 2 * x[:, 0] - x[:, 1] + rng.normal(0, 0.1, 40)
    return x, y, spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))], "run bigint, a double, b double, y double")


def test_design_without_responses(runs):
    x, _, df = runs
    m = np.c_[np.ones(40), x]
    inverse = np.linalg.inv(m.T @ m)
    model = validation.design(df, ["Intercept", "a", "b"])
    np.testing.assert_allclose(model.inverse, inverse, atol=1e-12)
    row = validation.design_summary(df, model).first()
    assert row.trace == pytest.approx(np.trace(inverse)) and row.determinant == pytest.approx(np.linalg.det(inverse))
    got = {r.run: r for r in validation.leverages(df, model, ["run"], 0.5, 7).collect()}
    h = np.einsum("ij,jk,ik->i", m, inverse, m)
    assert all(got[i].leverage == pytest.approx(h[i]) and got[i].half_width == pytest.approx(t_quantile(0.975, 7) * 0.5 * np.sqrt(h[i])) for i in range(40))
    assert validation.leverages(df, model, ["run"]).where("half_width is not null").count() == 0


def test_linearly_dependent_design_is_none(runs):
    assert validation.design(runs[2].selectExpr("a", "2 * a as c"), ["Intercept", "a", "c"]) is None


def test_points_left_out(spark, runs):
    x, y, df = runs
    model = mlr.fit(df, "y", ["Intercept", "a", "b"])
    centre = spark.createDataFrame([(0.0, 0.0, 3.0), (0.0, 0.0, 3.2), (0.0, 0.0, None)], "a double, b double, y double")
    row = validation.left_out(centre, model, "y", 0.1, 5).first()
    h = model.inverse[0, 0]
    assert (row.n, row.mean) == (2, pytest.approx(3.1)) and row.predicted == pytest.approx(model.beta[0]) and row.leverage == pytest.approx(h)
    assert row.half_width == pytest.approx(t_quantile(0.975, 5) * 0.1 * np.sqrt(0.5 + h))
    assert row.within == (abs(row.predicted - 3.1) <= row.half_width) and row.valid == (row.rmse < 1.5 * model.s)
    assert validation.left_out(centre.where("false"), model, "y", 0.1, 5).count() == 0


def test_replicate_rows_with_nulls(spark):
    df = spark.createDataFrame([(1, 0.0, 1.0), (2, 0.0, 3.0), (3, 1.0, 5.0), (4, None, 2.0), (5, None, 4.0)], "run int, a double, y double")
    got = {r.run: (r.n, r.mean, r.deviation) for r in validation.replicate_rows(df, ["a"], "y", ["run"]).collect()}
    assert got == {1: (2, 2.0, -1.0), 2: (2, 2.0, 1.0), 4: (2, 3.0, -1.0), 5: (2, 3.0, 1.0)}


def test_intervals_at_points(runs):
    _, _, df = runs
    model = mlr.fit(df, "y", ["Intercept", "a", "b"])
    own = surface.with_interval(df, model).where("run = 4").first()
    both = surface.with_interval(df, model, s_exp=0.3, dof_exp=4, n_exp=2).where("run = 4").first()
    assert own.y_ci_semiwidth == pytest.approx(t_quantile(0.975, 37) * model.s * np.sqrt(own.y_leverage))
    assert both.y_ci_semiwidth == pytest.approx(np.hypot(own.y_ci_semiwidth, t_quantile(0.975, 4) * 0.3 / np.sqrt(2)))
    assert own.y_predicted_upper - own.y_predicted == pytest.approx(own.y_ci_semiwidth)
    with pytest.raises(ValueError):
        surface.with_interval(df, mlr.fit(df.where("run < 3"), "y", ["Intercept", "a", "b"]))


def test_best_cells(spark):
    rows = spark.createDataFrame([("y", 0, 0, 0.0, 0.0, 1.0, 0.1), ("y", 1, 0, 1.0, 0.0, 3.0, 0.1), ("y", 0, 1, 0.0, 1.0, 3.0, 0.1)], "response string, ix int, iy int, x double, y double, z double, ci double")
    best = lambda kind, low=0.0, high=0.0: surface.interpretation(rows, {"y": (kind, low, high)}).first()[2:5]
    assert best("Maximize") == (1.0, 0.0, 3.0) and best("Minimize") == (0.0, 0.0, 1.0) and best("Target", 1.0, 2.0) == (0.0, 0.0, 1.0)
    assert surface.target_share(rows, 0.5, 2.0).first()[:] == (3, 1, pytest.approx(100 / 3))


def test_separators():
    assert validation.separators(["Intercept", "a", "b", "a*b", "a^2"]) == {"linear_end": 2.5, "interaction_end": 3.5}
    assert validation.separators(["Intercept", "a"]) == {"linear_end": None, "interaction_end": None}


def test_rows_in_words(runs):
    _, _, df = runs
    model = pca.fit(df, ["a", "b", "y"], 2, scale=True)
    scores = {r.run: r for r in pca.scores(df, model, ["run"]).collect()}
    got = {r.run: r for r in pca.interpreted(df, model, "run").collect()}
    for i in range(40):
        side = ["HIGH" if scores[i][k] > 0 else "LOW" for k in ("PC1", "PC2")]
        assert [got[i].side_x, got[i].side_y] == side
        assert got[i].text.startswith(f"Sample {i} is positioned {side[0]} on PC1 (score={scores[i].PC1:.2f}) and {side[1]} on PC2")
    assert "no strong variable" in pca.interpreted(df, model, "run", threshold=1.5).first().text


def test_cloud_and_highlighted_rows(runs):
    _, _, df = runs
    got = charts.correlation_scatter(df, df.where("run = 1"), "a", "b", 10)
    assert got.groupBy("highlighted").count().orderBy("highlighted").collect() == [(False, 10), (True, 1)]


def test_profiles_by_category_and_notes(spark):
    df = spark.createDataFrame([(1, 0.5, None, 2.0), (2, 1.5, "k", 4.0)], "id int, v double, kind string, w double")
    got = {(r.id, r.variable): (r.value, r.category, r.text) for r in charts.shaded_profiles(df, "id", ["v", "w"], "kind", ["kind", "w"]).collect()}
    assert got[(1, "v")] == (0.5, "Unknown", "w: 2.00") and got[(2, "w")] == (4.0, "k", "kind: k | w: 4.00")


def test_export_sets(spark, runs, tmp_path):
    _, _, df = runs
    model = mlr.fit(df, "y", ["Intercept", "a", "b"])
    both = df.selectExpr("*", "2 * y as z")
    sets = {
        "mlr": reports.mlr_tables(df, model, ["run"]), "multi": reports.multi_tables(both, multi.fit_all(both, ["y", "z"], ["Intercept", "a", "b"]) | {"w": None}, ["run"]),
        "pca": reports.pca_tables(df, pca.fit(df, ["a", "b", "y"], 2, scale=True), ["run"]), "monitor": reports.monitor_tables(df, monitor.fit(df, ["a", "b", "y"], 1), ["run"]),
    }
    for name, tables in sets.items():
        written = write_tables(tables, f"{tmp_path}/{name}")
        assert len(written) == len(tables)
        for path, table in zip(written, tables.values()):
            back = spark.read.parquet(path)
            assert back.columns == table.columns and back.count() == table.count()
    assert sets["mlr"]["Dispersion"].count() == 9 and sets["multi"]["Error_w"].count() == 1 and sets["monitor"]["Contributions"].count() == 120
    assert {r.variable for r in sets["pca"]["Loadings"].collect()} == {"a", "b", "y"}
