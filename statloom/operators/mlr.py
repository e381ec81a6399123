"""Multiple linear regression from one pass of cross products, and its diagnostics as row expressions."""

from __future__ import annotations

from dataclasses import dataclass
from math import sqrt

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.functions.dist import f_cdf, f_quantile, t_quantile, t_two_sided
from statloom.operators.gram import moments
from statloom.settled import settled


def term_names(x: list[str], interactions: bool = True, squares: bool = True, intercept: bool = True, allowed: np.ndarray | None = None) -> list[str]:
    """Intercept, linear terms, a*b for each pair, a^2; ``allowed`` is a p x p 0/1 matrix over pairs and squares."""
    ok = np.ones((len(x), len(x)), int) if allowed is None else allowed
    pairs = [f"{x[i]}*{x[j]}" for i in range(len(x)) for j in range(i + 1, len(x)) if interactions and ok[i, j]]
    return ["Intercept"] * intercept + x + pairs + [f"{v}^2" for i, v in enumerate(x) if squares and ok[i, i]]


def term(name: str, values: dict[str, Column] | None = None) -> Column:
    """The column a term stands for."""
    value = lambda v: (values or {}).get(v, F.col(f"`{v}`")).cast("double")
    if name == "Intercept":
        return F.lit(1.0)
    if name.endswith("^2"):
        return value(name[:-2]) * value(name[:-2])
    a, star, b = name.partition("*")
    return value(a) * value(b) if star else value(a)


def term_kind(name: str) -> str:
    return "intercept" if name == "Intercept" else "quadratic" if name.endswith(("^2", "²")) else "interaction" if "*" in name or ":" in name else "linear"


def ordered_terms(names: list[str], variables: list[str]) -> list[str]:
    """Intercept, linear terms in variable order, interactions by their variables' order, squares."""
    at = {v: i for i, v in enumerate(variables)}

    def key(n: str) -> tuple:
        kind = term_kind(n)
        parts = n[:-2].split("*") if kind == "quadratic" else n.split("*")
        return (["intercept", "linear", "interaction", "quadratic"].index(kind), [at.get(p, len(at)) for p in parts], n)

    return sorted(names, key=key)


@dataclass
class Regression:
    y: str
    terms: list[str]
    beta: np.ndarray
    inverse: np.ndarray
    n: int
    rss: float
    var_y: float
    centred: np.ndarray  # sums of squares of the terms about their means

    @property
    def dof(self) -> int:
        return self.n - len(self.terms)

    @property
    def s(self) -> float | None:
        return sqrt(self.rss / self.dof) if self.dof > 0 else None

    @property
    def r2(self) -> float:
        return 1 - self.rss / (self.var_y * (self.n - 1))

    @property
    def r2_adjusted(self) -> float | None:
        return 1 - self.rss / self.dof / self.var_y if self.dof > 0 else None

    @property
    def se(self) -> np.ndarray:
        return (self.s or 0.0) * np.sqrt(np.maximum(np.diag(self.inverse), 0))

    @property
    def vif(self) -> list[float | None]:
        return [None if t == "Intercept" else float(c * v) for t, c, v in zip(self.terms, self.centred, np.diag(self.inverse))]

    def fitted(self, values: dict[str, Column] | None = None) -> Column:
        total = F.lit(0.0)
        for t, b in zip(self.terms, self.beta):
            total = total + term(t, values) * F.lit(float(b))
        return total

    def leverage(self, values: dict[str, Column] | None = None) -> Column:
        """x' (X'X)^-1 x."""
        x = [term(t, values) for t in self.terms]
        total = F.lit(0.0)
        for i in range(len(x)):
            inner = x[i] * F.lit(float(self.inverse[i, i]))
            for j in range(i + 1, len(x)):
                inner = inner + x[j] * F.lit(float(2 * self.inverse[i, j]))
            total = total + x[i] * inner
        return total


def fit(df: DataFrame, y: str | list[str], terms: list[str]) -> Regression | list[Regression | None] | None:
    """Least squares over complete rows, one pass for any number of responses; None where the terms are linearly dependent."""
    ys = [y] if isinstance(y, str) else y
    inner = [t for t in terms if t != "Intercept"]
    data = df.select(*[term(t).alias(f"t{i}") for i, t in enumerate(inner)], *[F.col(v).cast("double").alias(f"y{i}") for i, v in enumerate(ys)])
    m = moments(data, data.columns)
    p = len(inner)
    sx, sxy = m.scatter[:p, :p], m.scatter[:p, p:]
    out: list[Regression | None] = []
    scale = np.sqrt(np.where(np.diag(sx) > 0, np.diag(sx), 1.0))
    ok = m.n > 0 and (np.linalg.matrix_rank(sx / np.outer(scale, scale)) == p if p else True)
    for k, name in enumerate(ys):
        syy = m.scatter[p + k, p + k]
        if not ok:
            out.append(None)
            continue
        if "Intercept" in terms:
            inv = np.linalg.inv(sx / np.outer(scale, scale)) / np.outer(scale, scale) if p else np.zeros((0, 0))
            b = inv @ sxy[:, k]
            mean, my = m.mean[:p], m.mean[p + k]
            full = np.zeros((p + 1, p + 1))
            full[1:, 1:] = inv
            full[0, 1:] = full[1:, 0] = -inv @ mean
            full[0, 0] = 1 / m.n + mean @ inv @ mean
            at = [0 if t == "Intercept" else 1 + inner.index(t) for t in terms]
            beta = np.r_[my - mean @ b, b][at]
            inverse, rss = full[np.ix_(at, at)], syy - sxy[:, k] @ b
        else:
            g = m.raw
            inverse = np.linalg.inv(g[:p, :p])
            beta = inverse @ g[:p, p + k]
            rss = g[p + k, p + k] - g[:p, p + k] @ beta
        centred = np.array([0.0 if t == "Intercept" else sx[inner.index(t), inner.index(t)] for t in terms])
        out.append(Regression(name, terms, beta, inverse, m.n, max(float(rss), 0.0), float(syy) / (m.n - 1) if m.n > 1 else 0.0, centred))
    return out[0] if isinstance(y, str) else out


def stars(p: float | None) -> str:
    return "" if p is None else "***" if p <= 0.001 else "**" if p <= 0.01 else "*" if p <= 0.05 else ""


def coefficients(model: Regression, df: DataFrame, level: float = 0.95) -> DataFrame:
    """(term, coefficient, std_error, t, p, lower, upper, stars, vif); without degrees of freedom only the coefficient."""
    rows = []
    t = t_quantile(0.5 + level / 2, model.dof) if model.dof > 0 else None
    for name, b, se, vif in zip(model.terms, model.beta, model.se, model.vif):
        if t is None or se == 0:
            rows.append((name, float(b), None, None, None, None, None, "", vif))
            continue
        p = float(t_two_sided(float(b / se), model.dof))
        rows.append((name, float(b), float(se), float(b / se), p, float(b - t * se), float(b + t * se), stars(p), vif))
    return df.sparkSession.createDataFrame(rows, "term string, coefficient double, std_error double, t double, p double, lower double, upper double, stars string, vif double")


def diagnostics(df: DataFrame, model: Regression, keep: list[str]) -> DataFrame:
    """keep, observed, fitted, residual, leverage, cv_predicted, cv_residual; leaving one out follows from residual / (1 - leverage)."""
    variables = sorted({v for t in model.terms if t != "Intercept" for v in t.removesuffix("^2").split("*")})
    rows = df.dropna(subset=[*variables, model.y]).select(*keep, F.col(model.y).cast("double").alias("observed"), model.fitted().alias("fitted"), model.leverage().alias("leverage"))
    rows = rows.withColumn("residual", F.col("observed") - F.col("fitted")).withColumn("cv_residual", F.try_divide(F.col("residual"), 1 - F.col("leverage")))
    return rows.select(*keep, "observed", "fitted", "residual", "leverage", (F.col("observed") - F.col("cv_residual")).alias("cv_predicted"), "cv_residual")


def summary(df: DataFrame, model: Regression) -> DataFrame:
    """One row: n, n_terms, dof, r2, r2_adjusted, rmse, var_y, max and mean leverage and VIF, press, q2 (1 - PRESS / (var_y * n)), rmsecv."""
    d = diagnostics(df, model, [])
    vif = [v for v in model.vif if v is not None]
    lit = lambda v: F.lit(None if v is None else float(v)).cast("double")
    agg = d.agg(F.max("leverage").alias("max_leverage"), F.avg("leverage").alias("mean_leverage"), F.sum(F.col("cv_residual") * F.col("cv_residual")).alias("press"))
    return agg.select(
        F.lit(model.n).cast("bigint").alias("n"), F.lit(len(model.terms)).alias("n_terms"), F.lit(model.dof).cast("bigint").alias("dof"), lit(model.r2).alias("r2"), lit(model.r2_adjusted).alias("r2_adjusted"), lit(model.s).alias("rmse"), lit(model.var_y).alias("var_y"), "max_leverage", "mean_leverage",
        lit(max(vif, default=None)).alias("max_vif"), lit(sum(vif) / len(vif) if vif else None).alias("mean_vif"), "press", (1 - F.try_divide(F.col("press"), lit(model.var_y * model.n))).alias("q2"), F.sqrt(F.col("press") / model.n).alias("rmsecv"),
    )


def predicted(df: DataFrame, model: Regression, keep: list[str], y: str | None = None, s: float | None = None, dof: int | None = None, level: float = 0.95) -> DataFrame:
    """keep, predicted, leverage, std_error, lower, upper, and with ``y`` the residual predicted - observed."""
    s, dof = s or model.s or 0.0, dof or model.dof
    t = t_quantile(0.5 + level / 2, dof) if dof > 0 else 0.0
    rows = df.select(*keep, model.fitted().alias("predicted"), model.leverage().alias("leverage"), *([F.col(y).cast("double").alias("_y")] if y else []))
    rows = rows.withColumn("std_error", F.sqrt("leverage") * s)
    rows = rows.withColumn("lower", F.col("predicted") - F.col("std_error") * t).withColumn("upper", F.col("predicted") + F.col("std_error") * t)
    return rows.withColumn("residual", F.col("predicted") - F.col("_y")).drop("_y") if y else rows


#: Width of a cell of ``near_groups`` in tolerances.
CELL_WIDTH = 16


def near_groups(df: DataFrame, x: list[str], order: str | None = None, absolute: float = 1e-10, relative: float = 1e-5) -> DataFrame:
    """Rows (x..., leader): the distinct points of complete rows, each with the number of the group it is in.

    Points are taken in ``order`` (by x without it; a point's first row counts). The first one without a group leads a new one, and takes with it all later ones without a
    group whose coordinates b all have |a - b| <= absolute + relative * |b|. The leader is known by its point.

    A coordinate's cells are as wide as CELL_WIDTH tolerances there. A point lies in one cell, and is also sent to the neighbours it is near to;
    so each close pair meets, and only those do. Then all points whose earlier neighbours are decided are decided at once, round by round.
    """
    scale = absolute / relative
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in x], *([F.col(order).alias("_order")] if order else [])).dropna(subset=x)
    points = rows.groupBy(*x).agg((F.min("_order") if order else F.struct(*x)).alias("_first")).withColumn("_first", F.struct("_first", *x))
    place = [F.signum(c) * F.log1p(F.abs(F.col(c)) / scale) / (relative * CELL_WIDTH) for c in x]
    edge = 1.01 / CELL_WIDTH
    homes = points.select(F.struct(*x).alias("a"), F.col("_first").alias("a_first"), F.array(*[F.floor(p) for p in place]).alias("cell"))
    beside = [F.array_distinct(F.array(F.floor(p - edge), F.floor(p), F.floor(p + edge))) for p in place]
    spread = points.select(F.struct(*x).alias("b"), F.col("_first").alias("b_first"), *[s.alias(f"_s{i}") for i, s in enumerate(beside)])
    for i in range(len(x)):
        spread = spread.withColumn(f"_s{i}", F.explode(f"_s{i}"))
    spread = spread.select("b", "b_first", F.array(*[f"_s{i}" for i in range(len(x))]).alias("cell"))
    close = F.lit(True)
    for c in x:
        close = close & (F.abs(F.col("a")[c] - F.col("b")[c]) <= absolute + relative * F.abs(F.col("b")[c]))
    pairs = settled(homes.join(spread, "cell").where((F.col("a_first") < F.col("b_first")) & close).select("a", "a_first", "b"))
    decided = points.select(F.struct(*x).alias("p")).join(pairs.select(F.col("b").alias("p")), "p", "left_anti").withColumn("leader", F.col("p"))
    left = pairs.count()
    decided = settled(decided) if left else decided
    while left:
        seen = pairs.join(decided.select(F.col("p").alias("a"), "leader"), "a", "left").join(decided.select(F.col("p").alias("b")), "b", "left_anti")
        #: What leads among the earlier neighbours, the first of these; undecided ones have no leader yet.
        found = settled(seen.groupBy("b").agg(F.count_if(F.col("leader").isNull()).alias("open"), F.min(F.when(F.col("leader") == F.col("a"), F.struct("a_first", "a"))).alias("first")))
        fresh = found.where("open = 0").select(F.col("b").alias("p"), F.coalesce("first.a", "b").alias("leader"))
        decided = settled(decided.unionByName(fresh))
        left = found.where("open > 0").count()
    return decided.select("p.*", "leader")


def replicates(df: DataFrame, x: list[str], y: str, order: str | None = None) -> DataFrame:
    """Groups of rows with equal or nearly equal x (``near_groups``): (x... of the leader, n, mean, variance, dof), of two rows or more."""
    named = {c: F.col(c).cast("double") for c in x}
    rows = df.select(*[e.alias(c) for c, e in named.items()], F.col(y).alias("_y")).join(near_groups(df, x, order), x)
    groups = rows.groupBy("leader").agg(F.count("*").alias("n"), F.avg("_y").alias("mean"), F.var_samp("_y").alias("variance"))
    return groups.where("n > 1").select("leader.*", "n", "mean", "variance", (F.col("n") - 1).alias("dof"))


def pooled(groups: DataFrame) -> DataFrame:
    """One row: n_groups, dof, pooled variance and deviation of replicate groups."""
    return groups.agg(F.count("*").alias("n_groups"), F.sum("dof").alias("dof"), F.try_divide(F.sum(F.col("variance") * F.col("dof")), F.sum("dof")).alias("variance")).withColumn("std", F.sqrt("variance"))


def central_points(df: DataFrame, x: list[str], tolerance: float = 1e-6) -> DataFrame:
    """Rows at 0 in all of x, or at the middle of every varying column (at 0 for columns of levels -1, 0, 1)."""
    stats = df.agg(*[e for c in x for e in (F.min(c), F.max(c), F.count_if(~F.col(c).isin(-1, 0, 1)))]).first()
    zero, middle, varying = F.lit(True), F.lit(True), False
    for i, c in enumerate(x):
        low, high, other = stats[3 * i : 3 * i + 3]
        zero = zero & (F.abs(F.col(c)) <= tolerance)
        if low is not None and low != high:
            varying = True
            middle = middle & (F.abs(F.col(c) - (0.0 if other == 0 else (float(low) + float(high)) / 2)) <= tolerance)
    return df.where(zero | middle if varying else zero)


def pseudo_central_points(df: DataFrame, x: list[str], tolerance: float = 0.01) -> DataFrame:
    """Rows with some but not all coordinates near 0 of which at least two lie together (on a grid of the tolerance)."""
    near = sum((F.abs(F.col(c)) < tolerance).cast("int") for c in x)
    rows = df.withColumns({f"_g{i}": F.round(F.col(c) / tolerance) for i, c in enumerate(x)}).where((near > 0) & (near < len(x)))
    keys = [f"_g{i}" for i in range(len(x))]
    return rows.join(rows.groupBy(*keys).count().where("count > 1").drop("count"), keys, "left_semi").drop(*keys)


def f_tests(var_y: float, dof_y: int, mse: float, dof: int, pure: float, dof_pure: int, alpha: float = 0.95) -> list[tuple]:
    """(test, ratio, critical, p): the response's and the model's variance over that of replicates."""
    out = []
    for name, v, d in (("global", var_y, dof_y), ("lack_of_fit", mse, dof)):
        ratio = v / pure
        out.append((name, ratio, f_quantile(alpha, d, dof_pure), 1 - f_cdf(ratio, d, dof_pure)))
    return out


def vif_band(v: Column) -> Column:
    return F.when(v <= 1, "none").when(v <= 2, "low").when(v <= 4, "moderate").when(v <= 8, "high").otherwise("severe")


def formula(y: str, terms: list[str]) -> str:
    linear = [t for t in terms if term_kind(t) == "linear"]
    at = {v: i + 1 for i, v in enumerate(linear)}
    parts = []
    for t in terms:
        if t == "Intercept":
            parts.append("b₀")
        else:
            names = [t[:-2]] * 2 if t.endswith("^2") else t.split("*")
            parts.append(f"b{''.join(str(at.get(n, n)) for n in names)}·{t}")
    return f"{y} = {' + '.join(parts)}"


def equation(model: Regression, digits: int = 3) -> str:
    """The fitted equation with its numbers."""
    text = ""
    for t, b in zip(model.terms, model.beta):
        sign = "-" if b < 0 else "+"
        body = f"{abs(b):.{digits}f}" + ("" if t == "Intercept" else f"·{t}")
        text += f" {sign} {body}" if text else ("-" if b < 0 else "") + body
    return f"{model.y} = {text}"


def decimals(half_width: Column) -> Column:
    """Decimals that a half-width deserves: 1 to 3."""
    return F.greatest(F.lit(1), F.least(F.lit(3), (-F.floor(F.log10(half_width))).cast("int")))


def design_structure(df: DataFrame, x: list[str]) -> dict:
    """Levels of each factor without centre rows, which factors are qualitative (0/1), the kind of design and the terms it can carry."""
    centre = F.lit(True)
    for c in x:
        centre = centre & (F.abs(F.col(c).cast("double")) < 1e-10)
    row = df.where(~centre).agg(*[e for c in x for e in (F.count_distinct(c), F.count_if(~F.col(c).isin(0, 1)))]).first()
    levels = {c: row[2 * i] for i, c in enumerate(x)}
    qualitative = [c for i, c in enumerate(x) if row[2 * i + 1] == 0]
    allowed = np.ones((len(x), len(x)), int)
    for i, c in enumerate(x):
        if levels[c] <= 2:
            allowed[i, i] = 0
        if c in qualitative:
            allowed[i, :] = allowed[:, i] = 0
    kind = "qualitative_only" if len(qualitative) == len(x) else "two_level" if all(v <= 2 for v in levels.values()) else "multi_level"
    return {"levels": levels, "qualitative": qualitative, "kind": kind, "terms": term_names(x, allowed=allowed)}
