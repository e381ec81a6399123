"""Operators against numpy, published tables and small worked cases."""

from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from statloom.dataset import Dataset
from statloom.functions import dist, scalars
from statloom.operators import bivariate, columns, doe, encode, mlr, monitor, multi, ordered, pareto, pca, rows, select, surface, univariate
from statloom.operators.charts import normal_quantile_column, quantile_pairs
from statloom.operators.gram import moments
from statloom.operators.missing import reconstructed
from statloom.plans.catalog import Workspace
from statloom.sources import readers, writers


@pytest.mark.parametrize(("got", "want"), [
    (dist.t_quantile(0.975, 10), 2.2281388520), (dist.t_quantile(0.995, 3), 5.8409093097), (dist.f_quantile(0.95, 3, 20), 3.0983912121), (dist.f_quantile(0.99, 10, 5), 10.0510172140), (dist.chi2_quantile(0.95, 5), 11.0704976935), (dist.chi2_quantile(0.005, 2), 0.0100250836),
    (dist.t_two_sided(2.228138852, 10), 0.05), (dist.normal_quantile(0.975), 1.9599639845),
])
def test_published_quantiles(got, want):
    assert got == pytest.approx(want, rel=1e-8)


def matrix(spark, x, names=None):
    names = names or [f"c{i}" for i in range(x.shape[1])]
    return spark.createDataFrame(pd.DataFrame(x, columns=names).assign(row_id=range(1, len(x) + 1))), names


def rowwise_nipals(x, k, steps=5000, threshold=1e-6):
    """The textbook iteration on rows."""
    r, scores, loadings, counts = x.copy(), [], [], []
    for _ in range(k):
        t, n = r[:, 0] / np.linalg.norm(r[:, 0]), 0
        while True:
            n += 1
            p = r.T @ t / (t @ t)
            p /= np.linalg.norm(p)
            new = r @ p
            change = ((new - t) ** 2).sum()
            t = new
            if change <= threshold or n >= steps:
                break
        r = r - np.outer(t, p)
        scores.append(t)
        loadings.append(p)
        counts.append(n)
    return np.array(scores).T, np.array(loadings).T, counts


@pytest.mark.parametrize("scale", [False, True])
def test_components_follow_the_rowwise_iteration(spark, scale):
    x = np.random.default_rng(1).standard_normal((100, 6)) @ np.random.default_rng(2).standard_normal((6, 6)) + 5
    df, names = matrix(spark, x)
    z = (x - x.mean(0)) / (x.std(0, ddof=1) if scale else 1)
    t, p, counts = rowwise_nipals(z, 4)
    m = pca.fit(df, names, 4, scale=scale)
    np.testing.assert_allclose(m.loadings, p, atol=1e-8)
    assert m.n_iterations == counts
    np.testing.assert_allclose(m.ratio, (t**2).sum(0) / (z**2).sum(), rtol=1e-8)
    got = pca.scores(df, m, ["row_id"]).orderBy("row_id").toPandas()
    np.testing.assert_allclose(got[m.names].to_numpy(), t, atol=1e-7)
    d = pca.diagnostics(df, m, ["row_id"]).orderBy("row_id").toPandas()
    np.testing.assert_allclose(d.t2, (t**2 / ((t**2).sum(0) / 99)).sum(1), rtol=1e-6)
    np.testing.assert_allclose(d.q, ((z - t @ p.T) ** 2).sum(1), atol=1e-6)
    v = pca.explained_by_variable(df, m).toPandas().set_index("variable").explained
    np.testing.assert_allclose(v[names], 1 - ((z - t @ p.T) ** 2).sum(0) / (z**2).sum(0), atol=1e-7)


def test_components_with_gaps(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((60, 2)) @ rng.standard_normal((2, 7))
    x[rng.random(x.shape) < 0.1] = np.nan
    df, names = matrix(spark, x)
    m = pca.fit_with_gaps(Dataset(df, "row_id", names).df, names, 2)
    r = x - np.nanmean(x, 0)
    for k in range(2):
        z = np.where(np.isnan(r), 0, r)
        t, p, _ = rowwise_nipals(z, 1)
        np.testing.assert_allclose(m.loadings[:, k], p[:, 0], atol=1e-6)
        r = r - np.outer(t[:, 0], p[:, 0])


def test_varimax_keeps_orthonormal_loadings(spark):
    df, names = matrix(spark, np.random.default_rng(4).standard_normal((80, 5)))
    m = pca.fit(df, names, 3)
    r = pca.rotated(df, m)
    np.testing.assert_allclose(r.loadings.T @ r.loadings, np.eye(3), atol=1e-8)
    assert (r.loadings**4).sum() >= (m.loadings**4).sum()
    assert r.ratio.sum() == pytest.approx(m.ratio.sum())


def test_cross_validation_against_refits(spark):
    x = np.random.default_rng(5).standard_normal((31, 4)) @ np.random.default_rng(6).standard_normal((4, 4))
    df, names = matrix(spark, x)
    press, total = np.zeros(3), 0
    for f in range(7):
        held = np.arange(f * 4, (f + 1) * 4 if f < 6 else 31)
        train = np.delete(x, held, 0)
        mean, sd = train.mean(0), train.std(0)
        v = np.linalg.svd((train - mean) / sd, full_matrices=False)[2]
        z = (x[held] - mean) / sd
        total += (z**2).sum()
        for a in range(3):
            press[a] += ((z - z @ v[: a + 1].T @ v[: a + 1]) ** 2).sum()
    got = pca.cross_validated(df, "row_id", names, 3, scale=True).toPandas()
    np.testing.assert_allclose(got.press, press, rtol=1e-8)
    np.testing.assert_allclose(got.q2, 1 - press / total, rtol=1e-8)


def test_monitor_limits_faults_and_json(spark):
    x = np.random.default_rng(7).standard_normal((200, 3)) * [1, 2, 3]
    x[5] = [9, -18, 27]
    df, names = matrix(spark, x)
    m = monitor.fit(df, names, 2)
    z = (x - x.mean(0)) / x.std(0)
    v = np.linalg.svd(z, full_matrices=False)[2][:2]
    t = z @ v.T
    q = ((z - t @ v) ** 2).sum(1)
    got = monitor.faults(df, m, ["row_id"]).orderBy("row_id").toPandas()
    np.testing.assert_allclose(got.t2, (t**2 / t.var(0, ddof=1)).sum(1), rtol=1e-6)
    np.testing.assert_allclose(got.q, q, atol=1e-8)
    assert m.t2_limits[0] == pytest.approx(199 * 2 / 198 * dist.f_quantile(0.975, 2, 198))
    assert m.q_limits[0] == pytest.approx(q.var() / (2 * q.mean()) * dist.chi2_quantile(0.975, 2 * q.mean() ** 2 / q.var()), rel=1e-8)
    assert got.fault[5] != "none"
    again = monitor.Monitor.from_json(m.to_json())
    assert monitor.faults(df, again, ["row_id"]).exceptAll(monitor.faults(df, m, ["row_id"])).count() == 0
    table = monitor.contribution_table(df, df, m, "row_id", "t2").where("row_id = 6")
    assert table.where("flagged").count() > 0


def test_reconstruction_restores_a_low_rank_matrix(spark):
    x = np.outer(np.arange(1, 41), [1.0, 2.0, 3.0]) + 4
    gap = x.copy()
    gap[10, 1] = gap[20, 2] = np.nan
    df, names = matrix(spark, gap)
    filled, m = reconstructed(Dataset(df, "row_id", names).df, names, 1)
    got = filled.orderBy("row_id").select(*names).toPandas().to_numpy()
    keep = ~np.isnan(gap)
    np.testing.assert_allclose(got[keep], x[keep])
    assert abs(got[10, 1] - x[10, 1]) < abs(np.nanmean(gap[:, 1]) - x[10, 1])


def test_regression_against_numpy_and_refits(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((40, 3))
    y = 1 + x @ [1, 2, 3] + x[:, 0] * x[:, 1] + rng.standard_normal(40)
    df, _ = matrix(spark, np.c_[x, y], ["a", "b", "c", "y"])
    terms = mlr.term_names(["a", "b", "c"], squares=False)
    d = np.c_[np.ones(40), x, x[:, 0] * x[:, 1], x[:, 0] * x[:, 2], x[:, 1] * x[:, 2]]
    m = mlr.fit(df, "y", terms)
    beta, rss = np.linalg.lstsq(d, y, rcond=None)[:2]
    np.testing.assert_allclose(m.beta, beta, rtol=1e-9)
    assert m.s == pytest.approx(np.sqrt(rss[0] / 33))
    np.testing.assert_allclose(m.inverse, np.linalg.inv(d.T @ d), rtol=1e-7, atol=1e-12)
    got = mlr.diagnostics(df, m, ["row_id"]).orderBy("row_id").toPandas()
    cv = [d[i] @ np.linalg.lstsq(np.delete(d, i, 0), np.delete(y, i), rcond=None)[0] for i in range(40)]
    np.testing.assert_allclose(got.cv_predicted, cv, rtol=1e-7)
    s = mlr.summary(df, m).first()
    assert s.q2 == pytest.approx(1 - ((y - np.array(cv)) ** 2).sum() / (y.var(ddof=1) * 40))
    for j in range(1, 7):
        others = np.delete(d, j, 1)
        rest = d[:, j] - others @ np.linalg.lstsq(others, d[:, j], rcond=None)[0]
        assert m.vif[j] == pytest.approx(((d[:, j] - d[:, j].mean()) ** 2).sum() / (rest @ rest))
    assert mlr.fit(df.withColumn("e", F.col("a") * 2), "y", ["Intercept", "a", "e"]) is None
    assert mlr.formula("y", ["Intercept", "a", "b", "a*b", "b^2"]) == "y = b₀ + b1·a + b2·b + b12·a*b + b22·b^2"
    assert mlr.ordered_terms(["b^2", "a*b", "b", "Intercept", "a"], ["a", "b"]) == ["Intercept", "a", "b", "a*b", "b^2"]


def test_replicates_centre_points_and_structure(spark):
    rows_ = [(1, -1.0, -1.0, 3.0), (2, 1.0, -1.0, 4.0), (3, -1.0, 1.0, 5.0), (4, 1.0, 1.0, 7.0), (5, 0.0, 0.0, 5.0), (6, 0.0, 0.0, 5.5), (7, 0.0, 0.0, 4.5)]
    df = spark.createDataFrame(rows_, "row_id int, a double, b double, y double")
    p = mlr.pooled(mlr.replicates(df, ["a", "b"], "y")).first()
    assert (p.n_groups, p.dof, p["std"]) == (1, 2, 0.5)
    assert {r.row_id for r in mlr.central_points(df, ["a", "b"]).collect()} == {5, 6, 7}
    s = mlr.design_structure(df, ["a", "b"])
    assert s["kind"] == "two_level" and s["terms"] == ["Intercept", "a", "b", "a*b"]


def test_designs(spark):
    pb = doe.plackett_burman(spark, 11).drop("run").toPandas().to_numpy()
    np.testing.assert_array_equal(pb.T @ pb, 12 * np.eye(11))
    assert doe.plackett_burman(spark, 15).count() == 16 and doe.plackett_burman(spark, 3, 1).count() == 16
    half = doe.fractional_factorial(spark, 5).toPandas()
    assert len(half) == 16 and (half.x5 == half.x1 * half.x2 * half.x3 * half.x4).all()
    ccd = doe.classified(doe.central_composite(spark, 3, "rotatable"), ["x1", "x2", "x3"])
    assert {r.point_type: r["count"] for r in ccd.groupBy("point_type").count().collect()} == {"corner": 8, "center": 3, "interior": 6}
    assert doe.axial_distance(2, "rotatable") == pytest.approx(2**0.5)
    assert doe.validated("plackett_burman", {"a": [1, 2, 3]}) and not doe.validated("two_level", {"a": [1, 2]})


def test_surface_rectangle_and_multi(spark):
    mask = np.array([[1, 1, 0], [1, 1, 1], [0, 1, 1]], bool)
    assert surface.largest_rectangle(mask) == (4, 0, 1, 0, 1)
    rng = np.random.default_rng(9)
    x = rng.uniform(-1, 1, (30, 2))
    df, _ = matrix(spark, np.c_[x, 3 + 2 * x[:, 0], 1 - x[:, 1], np.full(30, 1.0)], ["a", "b", "y1", "y2", "flat"])
    models = multi.fit_all(df, ["y1", "y2"], ["Intercept", "a", "b"])
    assert models["y1"].beta == pytest.approx([3, 2, 0])
    cells = surface.feasible(surface.surfaces(spark, models, "a", "b", {}, steps=10), {"y1": ("Threshold_Above", 3.0, 0), "y2": ("Threshold_Below", 0, 1.0)}, use_ci=False)
    found = surface.feasible_rectangle(cells)
    assert found["points"] >= 25 and found["x"][1] == pytest.approx(1.0)
    best = surface.optimum(surface.surface(spark, models["y1"], "a", "b", {}, steps=10)).first()
    assert best.x == pytest.approx(1.0)


def test_pareto_fronts_keep_equal_points(spark):
    rows_ = [(1, 1.0, 1.0), (2, 2.0, 1.0), (3, 1.0, 2.0), (4, 2.0, 2.0), (5, 2.0, 2.0), (6, None, 5.0)]
    df = spark.createDataFrame(rows_, "id int, u double, v double")
    got = {r.id: r.pareto_rank for r in pareto.ranked(df, {"u": ("maximize",), "v": ("maximize",)}).collect()}
    assert got == {4: 1, 5: 1, 2: 2, 3: 2, 1: 3, 6: 4}
    m = np.random.default_rng(1).integers(0, 9, (700, 3)).astype(float)
    want = np.array([not any((o >= p).all() and (o > p).any() for o in m) for p in m])
    np.testing.assert_array_equal(pareto.front_mask(m), want)


def test_order_survives_many_blocks(spark):
    n = 500
    v = np.random.default_rng(2).standard_normal(n)
    df = spark.createDataFrame(pd.DataFrame({"k": np.arange(n) * 7 + 3, "v": v})).repartition(7)
    for block in (4, 64):
        got = ordered.over_rows(df, "k", lambda w: {"s": F.sum("v").over(w.rowsBetween(-2, 1))}, 2, 1, block=block).orderBy("k").toPandas().s
        np.testing.assert_allclose(got, [v[max(i - 2, 0) : i + 2].sum() for i in range(n)])
        total = ordered.running_sum(df, "k", "v", "t", block=block).orderBy("k").toPandas().t
        np.testing.assert_allclose(total, v.cumsum())
    flags = spark.createDataFrame([(i, "ab"[i // 3 % 2]) for i in range(10)], "k int, c string")
    assert [tuple(r) for r in ordered.segments(flags, "k", "c").orderBy("segment").collect()] == [(1, "a", 0, 2, 3), (2, "b", 3, 5, 3), (3, "a", 6, 8, 3), (4, "b", 9, 9, 1)]


def test_row_transforms(spark):
    df = spark.createDataFrame([([1.0, 2.0, 4.0, 8.0, 16.0],), ([5.0] * 5,)], "a array<double>")
    got = df.select(rows.snv(F.col("a")).alias("s"), rows.second_derivative(F.col("a")).alias("d"), rows.moving_average(F.col("a"), 3).alias("m")).collect()
    x = np.array([1, 2, 4, 8, 16.0])
    np.testing.assert_allclose(got[0].s, (x - x.mean()) / x.std(ddof=1))
    assert got[1].s == [None] * 5 and got[0].d == [1.0, 2.0, 4.0] and got[0].m == pytest.approx([7 / 3, 14 / 3, 28 / 3])
    cubic = np.arange(12.0) ** 3
    np.testing.assert_allclose(rows.savgol_matrix(12, 5, 3) @ cubic, cubic, atol=1e-9)
    np.testing.assert_allclose(rows.savgol_matrix(12, 5, 3, 1) @ cubic, 3 * np.arange(12.0) ** 2, atol=1e-9)
    assert rows.bin_headers(["400", "410"], 2) == ["405.0"]
    with pytest.raises(ValueError):
        rows.bin_headers(list("abcdefg"), 3)


def test_columns_encoding_and_selection(spark):
    df = spark.createDataFrame([(0.0, "red", "x"), (1.0, "blue", "x"), (9.0, "red", "x")], "v double, c string, one string")
    assert [r.v for r in columns.log10_shifted(df, ["v"]).collect()] == pytest.approx(list(np.log10([1, 2, 10])))
    made, how = encode.auto_encoded(df, ["c", "one"])
    assert [r.c for r in made.collect()] == [1.0, -1.0, 1.0] and made.columns == ["v", "c"]
    assert columns.autoscaled(df.withColumn("v", F.lit(5.0)), ["v"]).first().v is None
    assert select.parse_rows("1,3-5", 10) == [0, 2, 3, 4] and select.parse_rows("1,x", 9) == []
    wide = spark.createDataFrame([(1, 2.0, 3.0)], "id int, `1104` double, note double")
    assert select.spectral_columns(wide) == (["1104"], ["id", "note"])
    assert univariate.descriptive("v") and df.agg(univariate.geometric_mean("v").alias("g")).first().g is None
    assert scalars.header_names(["a b", "a b", "_x!"]) == ["a_b", "a_b_1", "x_"]


def test_bivariate(spark):
    rng = np.random.default_rng(11)
    x = rng.integers(0, 6, 50).astype(float)
    y = x + rng.integers(0, 4, 50)
    df, _ = matrix(spark, np.c_[x, y], ["x", "y"])
    frame = pd.DataFrame({"x": x, "y": y})
    assert bivariate.spearman(df, ["x", "y"]).first().r == pytest.approx(frame.rank().corr().iloc[0, 1])
    s = np.sign(x[:, None] - x) * np.sign(y[:, None] - y)
    want = s.sum() / np.sqrt((x[:, None] != x).sum() * (y[:, None] != y).sum())
    assert bivariate.kendall(df, ["x", "y"]).first().r == pytest.approx(want)
    z = rng.standard_normal((300, 2))
    z[:20] += 30
    far, _ = matrix(spark, z, ["x", "y"])
    assert bivariate.robust_covariance(far, ["x", "y"])["outliers"] >= 20
    square = spark.createDataFrame([("a", float(i), float(j)) for i in range(4) for j in range(4)], "c string, x double, y double")
    assert bivariate.convex_hulls(square, "x", "y", "c").count() == 4
    assert quantile_pairs(df, "x").count() == 50


@pytest.mark.parametrize("most", [1_000_000, 50, 11])
def test_kendall_over_ranges(spark, most):
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 60, 400).astype(float), rng.integers(0, 50, 400).astype(float)
    x[:200], y[100:250] = 7.0, 3.0  # values that hold a half and more than a third of the rows
    points = spark.createDataFrame(pd.DataFrame({"x": x, "y": y}).groupby(["x", "y"]).size().reset_index(name="n"))
    assert bivariate.concordant_pairs(points, most) == ((x[:, None] < x) & (y[:, None] < y)).sum()


def test_kendall_of_odd_tables(spark):
    empty = spark.createDataFrame([], "x double, y double")
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (None, 1.0)], "x double, y double")
    assert bivariate.kendall(empty, ["x", "y"]).first()[2:] == (None, None, 0)
    assert bivariate.kendall(flat, ["x", "y"]).first()[2:] == (None, None, 2)
    steep = spark.createDataFrame([(float(i), 2.0 * i) for i in range(5)], "x double, y double")
    got = bivariate.kendall(steep, ["x", "y"]).first()
    assert (got.r, got.n) == (1.0, 5) and got.p == pytest.approx(0.014305878, abs=1e-8)


def test_correlation_with_a_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 1.0, 5.0), (4.0, 7.0, 5.0), (None, 9.0, 5.0)], "x double, y double, k double")
    for pairwise in (False, True):
        got = {(a.v1, a.v2): (a.r, a.p, a.n) for a in bivariate.pearson(df, ["x", "y", "k"], pairwise).collect()}
        assert got["x", "y"][0] == pytest.approx(np.corrcoef([1, 2, 4], [2, 1, 7])[0, 1])
        assert got["x", "k"][:2] == (None, None) and got["y", "k"] == (None, None, 4 if pairwise else 3)


def test_shares_lists_and_summary_against_numpy(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((60, 4)) @ rng.standard_normal((4, 4))
    x = np.c_[x, np.ones(60)]
    df, names = matrix(spark, x)
    watch = monitor.fit(df, names[:4], 2)
    z = (x[:, :4] - x[:, :4].mean(0)) / x[:, :4].std(0)
    p = watch.model.loadings
    t = z @ p
    got = monitor.variable_shares(df, watch, ["row_id"]).toPandas().sort_values(["row_id", "variable"])
    assert got.t2.to_numpy().reshape(60, 4) == pytest.approx((t**2 / t.var(0, ddof=1)) @ p.T)
    assert got.q.to_numpy().reshape(60, 4) == pytest.approx((z - t @ p.T) ** 2)
    one = monitor.summary(df, watch).first()
    assert (one.n_components, one.n_variables, one.n_rows, one.scaling) == (2, 4, 60, "auto")
    assert monitor.Monitor.from_json(watch.to_json()).scaling == "auto"
    r = np.corrcoef(x[:, :4].T)[1]
    want = sorted((i for i in (0, 2, 3)), key=lambda i: -abs(r[i]))
    rest = bivariate.one_against_rest(df, "c1", names, 2).collect()  # the constant column has no correlation
    assert [a.variable for a in rest] == [f"c{i}" for i in want[:2]] and rest[0].r == pytest.approx(r[want[0]])
    lists = pca.loading_lists(watch.model, df).toPandas()
    assert len(lists) == 8 and (lists.groupby("pc").share.max() == 100).all()
    for k, pc in enumerate(watch.model.names):
        up = lists[(lists.pc == pc) & (lists.side == "positive")].sort_values("rank")
        down = lists[(lists.pc == pc) & (lists.side == "negative")].sort_values("rank")
        assert up.loading.tolist() == sorted([v for v in p[:, k] if v >= 0], reverse=True)
        assert down.loading.tolist() == sorted(v for v in p[:, k] if v < 0)


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "t.csv").write_text("id;a;b\n1;1,5;x\n2;NA;y\n")
    df = readers.read(spark, str(tmp_path / "t.csv"), separator=";", decimal=",", index=True)
    assert [tuple(r) for r in df.orderBy("row_id").collect()] == [("1", 1.5, "x"), ("2", None, "y")]
    (tmp_path / "r.raw").write_text("head\n1 2\n2,5 4;\n")
    assert [(r["2Theta"], r.Intensity) for r in readers.read(spark, str(tmp_path / "r.raw")).orderBy("row").collect()] == [(1.0, 2.0), (2.5, 4.0)]
    assert readers.parse_raw(np.array([1.5, 2.5], "<f4").tobytes())[0][1] == 1.5
    with pytest.raises(ValueError):
        readers.read(spark, "x.sam")
    writers.write_tables({"A[1]": df}, str(tmp_path / "out"), metadata={"n": 2})
    assert spark.read.parquet(str(tmp_path / "out/A1")).count() == 2
    writers.write_spectral(df, str(tmp_path / "s"))
    assert any("0.0" in r.value for r in spark.read.text(str(tmp_path / "s")).collect())


def test_workspace(spark, tmp_path):
    w = Workspace(spark)
    df = spark.range(5).toDF("id")
    w.save("data", df)
    w.save("data_centred", df, "data", "transform", "centering", columns=["id"])
    a, b = w.split("data", "id", df.where("id < 2"))
    assert (a.count(), b.count()) == (2, 3) and spark.table(w.view("data_Selected")).count() == 2
    assert [e.transform for e in w.pretreatments("data_centred")] == ["centering"] and w.recent().count() == 1
    w.write(str(tmp_path / "ws"))
    assert Workspace.read(spark, str(tmp_path / "ws")).frames["data"].count() == 5
    assert w.clear("split") == 2 and w.delete("data") and not w.delete("data")


def test_normal_quantiles_at_any_size(spark):
    places = [1e-300, 1e-12, 1e-5, 0.01, 0.074, 0.075, 0.2, 0.5, 0.7, 0.925, 0.926, 0.99, 1 - 1e-9]
    rows = spark.createDataFrame([(p,) for p in places], "p double").select("p", normal_quantile_column(F.col("p")).alias("z")).collect()
    assert all(abs(r.z - dist.normal_quantile(r.p)) <= 1e-13 * max(1, abs(r.z)) for r in rows)
    big = quantile_pairs(spark.range(100_500).select(F.col("id").cast("double").alias("x")), "x").where("position % 1000 = 7").collect()
    assert len(big) == 101 and all(abs(r.theoretical - dist.normal_quantile(r.p)) < 1e-13 for r in big)


def test_crowding_ends_and_flat_objectives(spark):
    rows = [(1, 1.0, 9.0, 5.0), (2, 2.0, 7.0, 5.0), (3, 4.0, 4.0, 5.0), (4, 8.0, 1.0, 5.0), (5, 0.5, 0.5, 5.0), (6, None, 1.0, 5.0)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double").repartition(3)
    got = {r.id: r for r in pareto.ranked(df, {"a": ("maximize",), "b": ("maximize",), "c": ("maximize",)}, 2).collect()}
    assert [got[i].pareto_rank for i in range(1, 7)] == [1, 1, 1, 1, 2, 3]
    inf = float("inf")
    assert got[1].crowding_distance == got[4].crowding_distance == got[5].crowding_distance == inf and got[6].crowding_distance is None
    assert abs(got[2].crowding_distance - (3 / 7 + 5 / 8)) < 1e-12 and abs(got[3].crowding_distance - (6 / 7 + 6 / 8)) < 1e-12


def test_fronts_equal_peeling_all_points_at_once(spark):
    points = np.random.default_rng(3).integers(0, 30, (600, 3)).astype(float)
    df = spark.createDataFrame(pd.DataFrame(points, columns=["a", "b", "c"])).repartition(7)
    got = {(r.a, r.b, r.c): r.pareto_rank for r in pareto.ranked(df, {x: ("maximize",) for x in "abc"}, 3).collect()}
    left = np.unique(points, axis=0)
    for rank in (1, 2, 3, 4):
        best = np.array([not ((left >= p).all(1) & (left > p).any(1)).any() for p in left]) if rank < 4 else np.ones(len(left), bool)
        assert all(got[tuple(p)] == rank for p in left[best])
        left = left[~best]


def test_point_types_of_real_values(spark):
    design = spark.createDataFrame([(10.0, 1.0), (20.0, 3.0), (15.0, 2.0), (20.0, 2.0), (20.0, 2.5)], "t double, q double")
    got = {(r.t, r.q): r.point_type for r in doe.classified(design, ["t", "q"], real=True).collect()}
    assert got == {(10.0, 1.0): "corner", (20.0, 3.0): "corner", (15.0, 2.0): "center", (20.0, 2.0): "axial", (20.0, 2.5): "interior"}


def test_uneven_bins_raise(spark):
    df = spark.range(1).select(F.array(*[F.lit(float(i)) for i in range(7)]).alias("a"))
    with pytest.raises(Exception, match="do not divide"):
        df.select(rows.binned(F.col("a"), 3)).collect()


def test_rows_of_a_read_file_are_numbered_without_gaps(spark, tmp_path):
    for part in range(3):
        (tmp_path / f"{part}.csv").write_text("x,y\n" + "".join(f"{part},{i}\n" for i in range(4)))
    got = readers.read_csv(spark, [str(tmp_path / f"{i}.csv") for i in range(3)])
    assert sorted(r.row_id for r in got.collect()) == list(range(1, 13))
    (tmp_path / "head.csv").write_text("note\nmore\nx,y\n1,2\n3,4\n")
    assert [(r.row_id, r.x, r.y) for r in readers.read_csv(spark, str(tmp_path / "head.csv"), skip_rows=2).orderBy("row_id").collect()] == [(1, 1.0, 2.0), (2, 3.0, 4.0)]


def test_limit_of_rows_with_one_q():
    assert monitor.q_limit_box(2.5, 0.0, 0.95) == 2.5


def nearly_uncorrelated(spark, c):
    """Rows (row_id, a, b) whose correlation is c, with means and deviations of any size."""
    rng = np.random.default_rng(11)
    x = rng.standard_normal((600, 2))
    q = np.linalg.qr(x - x.mean(0))[0]
    pair = np.stack([q[:, 0], c * q[:, 0] + np.sqrt(1 - c * c) * q[:, 1]], 1) * np.sqrt(599)
    df, names = matrix(spark, pair * [3.0, 500.0] + [20.0, 4000.0])
    return df, names, pair


@pytest.mark.parametrize("c", [2e-4, -2e-4])
def test_leverage_of_nearly_equal_components(spark, c):
    df, names, pair = nearly_uncorrelated(spark, c)
    a, b = pair.T
    got = pca.leverage(df, pca.fit(df, names, 2, scale=True, threshold=1e-24), ["row_id"]).orderBy("row_id").toPandas()
    np.testing.assert_allclose(got.leverage, (a * a + b * b - 2 * c * a * b) / (1 - c * c) / 599, rtol=1e-9)


def test_loadings_of_nearly_equal_components(spark):
    df, names, _ = nearly_uncorrelated(spark, 2e-4)
    got = pca.loading_contributions(df, pca.fit(df, names, 2, scale=True)).toPandas()
    assert set(got.variable) == set(names)
    np.testing.assert_allclose(got.magnitude, np.sqrt(0.5), rtol=1e-9)


def test_loadings_where_the_first_step_is_under_the_threshold(spark):
    df, names, _ = nearly_uncorrelated(spark, 1e-5)
    got = pca.loading_contributions(df, pca.fit(df, names, 2, scale=True)).toPandas()
    assert set(got.variable) == set(names)
    np.testing.assert_allclose(got.magnitude, np.sqrt(0.5), rtol=1e-9)


def test_a_start_that_is_a_component_stays():
    p, values, _ = pca.nipals_gram(np.diag([1.0, 3.0]), 2)
    np.testing.assert_array_equal(p, np.eye(2))
    np.testing.assert_array_equal(values, [1, 3])


def test_q_of_nearly_equal_components(spark):
    df, names, (a, b) = (*(made := nearly_uncorrelated(spark, -2e-4))[:2], made[2].T)
    model = pca.fit(df, names, 1, scale=True, threshold=1e-24)
    got = df.select("row_id", pca.q_column(model).alias("q")).orderBy("row_id").toPandas()
    np.testing.assert_allclose(got.q, (a + b) ** 2 / 2, atol=1e-9)


def test_moments_of_many_rows_keep_their_last_digits(spark):
    """Sums over many rows against whole numbers: no error that grows with the rows."""
    n = 2_000_000
    i = F.col("id")
    cents = (i * 7919 + 13) % 10_409_911 + 90_000
    df = spark.range(0, n, 1, 1).select((i * i % 50 + 1).cast("double").alias("a"), (cents / 100).cast("double").alias("b"), cents.alias("c"), (i * i % 50 + 1).alias("q"))
    q, qq, c, cc, qc = (int(v) for v in df.agg(*[F.sum(x.cast("decimal(38,0)")) for x in (F.col("q"), F.col("q") * F.col("q"), F.col("c"), F.col("c") * F.col("c"), F.col("q") * F.col("c"))]).first())
    got = moments(df, ["a", "b"])
    want = np.array([[qq - Fraction(q * q, n), (qc - Fraction(q * c, n)) / 100], [(qc - Fraction(q * c, n)) / 100, (cc - Fraction(c * c, n)) / 10_000]], float)
    np.testing.assert_allclose(got.mean, [q / n, float(Fraction(c, 100 * n))], rtol=5e-16)
    np.testing.assert_allclose(np.diag(got.scatter), np.diag(want), rtol=1e-15)
    np.testing.assert_allclose(got.scatter[0, 1] / np.sqrt(want[0, 0] * want[1, 1]), want[0, 1] / np.sqrt(want[0, 0] * want[1, 1]), atol=1e-15)


def test_contributions_are_compiled(spark):
    """HotSpot compiles no method of more than 8000 bytes; the largest one of the generated code must be smaller."""
    df, names = matrix(spark, np.random.default_rng(5).standard_normal((50, 4)))
    found = monitor.contribution_table(df, df, monitor.fit(df, names, 2), "row_id").where("flagged")
    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    parts = debug.codegenStringSeq(found._jdf.queryExecution().executedPlan())
    sizes = [parts.apply(i)._3().maxMethodCodeSize() for i in range(parts.size())]
    assert sizes and max(sizes) < 8000, sizes
