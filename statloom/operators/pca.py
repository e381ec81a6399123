"""Principal components from cross products: the driver iterates on p x p numbers, the rows are projected by generated arithmetic."""

from __future__ import annotations

from dataclasses import dataclass, field
from math import sqrt

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.functions.dist import f_quantile, t_quantile
from statloom.operators.gram import Moments, moments


#: Distance of loadings from the limit of their iteration beyond which small steps do not count as convergence.
FAR = 2e-3


@dataclass
class PcaModel:
    variables: list[str]
    mean: np.ndarray
    scale: np.ndarray
    loadings: np.ndarray  # p x k
    eigenvalues: np.ndarray  # t't
    ratio: np.ndarray
    n: int
    n_iterations: list[int] = field(default_factory=list)
    names: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.names = self.names or [f"PC{i + 1}" for i in range(self.loadings.shape[1])]

    def table(self, df: DataFrame) -> DataFrame:
        rows = [(v, n, float(self.loadings[i, k])) for i, v in enumerate(self.variables) for k, n in enumerate(self.names)]
        return df.sparkSession.createDataFrame(rows, "variable string, pc string, loading double")

    def prepared(self) -> list[Column]:
        return [(F.col(v).cast("double") - F.lit(float(m))) / F.lit(float(s)) for v, m, s in zip(self.variables, self.mean, self.scale)]


def dot(columns: list[Column], weights) -> Column:
    total = F.lit(0.0)
    for c, w in zip(columns, weights):
        total = total + c * F.lit(float(w))
    return total


def prepared_gram(m: Moments, center: bool, scale: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shift, divisor and cross products of the prepared matrix; a zero deviation divides by 1."""
    shift = m.mean if center else np.zeros_like(m.mean)
    sd = m.std
    div = np.where(sd > 0, sd, 1.0) if scale else np.ones_like(sd)
    gram = (m.scatter if center else m.raw) / np.outer(div, div)
    if center and scale:  # n - 1 by definition; a last digit there would turn the loadings of nearly equal components
        np.fill_diagonal(gram, np.where(sd > 0, m.n - 1.0, np.diag(gram)))
    return shift, div, gram


def settled(g: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Where the iteration from ``p`` leads: its part in the space of the largest eigenvalue of ``g``, of norm 1."""
    values, vectors = np.linalg.eigh(g)
    top = vectors[:, values >= values[-1] - 1e-14 * abs(values[-1])]
    part = top @ (top.T @ p)
    size = np.linalg.norm(part)
    return part / size if size > 1e-9 else p  # a start that is a component itself stays


def nipals_gram(gram: np.ndarray, k: int, max_steps: int = 5000, threshold: float = 1e-6) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """NIPALS on the cross products alone: the same loadings, signs and step counts as on the rows.

    The start is the first column of the residual, or the first of largest norm if that is zero. Scores never appear: their squared change is
    a quadratic form in the residual's cross products. Components of nearly equal variance take short steps and many of them, the more the nearer, so
    both a step under ``threshold`` and the last of ``max_steps`` may be far from any component. What is still moving after the last step is taken to its
    limit, and so is what stopped farther than ``FAR`` from it.
    """
    g = gram.copy()
    loadings, values, steps = [], [], []
    for _ in range(k):
        norms = np.diag(g)
        if norms.max() <= 1e-14 * max(np.trace(gram), 1e-300):
            break
        first = 0 if norms[0] > 1e-14 * norms.max() else int(np.argmax(norms))
        p = g[:, first] / np.linalg.norm(g[:, first])
        change = 1 - 2 * (g[first] @ p) / sqrt(g[first, first]) + p @ g @ p
        count = 1
        while change > threshold and count < max_steps:
            new = g @ p
            new /= np.linalg.norm(new)
            change = (new - p) @ g @ (new - p)
            p, count = new, count + 1
        limit = settled(g, p)
        if change > threshold or np.linalg.norm(limit - p) > FAR:
            p = limit
        v = g @ p
        value = p @ v
        loadings.append(p)
        values.append(value)
        steps.append(count)
        g = g - np.outer(p, v) - np.outer(v, p) + value * np.outer(p, p)
    return np.array(loadings).T.reshape(len(gram), -1), np.array(values), steps


def fit(df: DataFrame, variables: list[str], k: int, center: bool = True, scale: bool = False, max_steps: int = 5000, threshold: float = 1e-6) -> PcaModel:
    """NIPALS components of the complete rows; ``ratio`` is of the prepared matrix's total sum of squares."""
    if not 1 <= k <= len(variables):
        raise ValueError("the number of components must lie between 1 and the number of variables")
    m = moments(df, variables)
    shift, div, gram = prepared_gram(m, center, scale)
    loadings, values, steps = nipals_gram(gram, k, max_steps, threshold)
    return PcaModel(variables, shift, div, loadings, values, values / np.trace(gram), m.n, steps)


def fit_with_gaps(df: DataFrame, variables: list[str], k: int, center: bool = True, scale: bool = False, max_steps: int = 5000, threshold: float = 1e-6) -> PcaModel:
    """NIPALS in which missing cells add nothing: one masked pass of cross products for each component.

    For each step the scores come from the present cells only, so the pass sums, for residual r and mask w, what the
    iteration needs; the rows are never collected. The residual of each component is a column expression over the last.
    """
    stats = df.agg(*[e for v in variables for e in (F.avg(v), F.stddev_samp(v))]).first()
    mean = np.array([stats[2 * i] if center else 0.0 for i in range(len(variables))], float)
    scale_by = np.array([(stats[2 * i + 1] or 1.0) if scale else 1.0 for i in range(len(variables))], float)
    residual = [(F.col(v).cast("double") - float(a)) / float(b) for v, a, b in zip(variables, mean, scale_by)]
    loadings, values, steps = [], [], []
    total = 0.0
    for j in range(k):
        rows = df.select(*[F.coalesce(r, F.lit(0.0)).alias(f"r{i}") for i, r in enumerate(residual)])
        m = moments(rows, rows.columns)
        gram = m.raw
        total = total or np.trace(gram)
        p, value, count = nipals_gram(gram, 1, max_steps, threshold)
        if not len(value):
            break
        loadings.append(p[:, 0])
        values.append(value[0])
        steps += count
        t = dot([F.coalesce(r, F.lit(0.0)) for r in residual], p[:, 0])
        residual = [r - t * F.lit(float(w)) for r, w in zip(residual, p[:, 0])]
    return PcaModel(variables, mean, scale_by, np.array(loadings).T.reshape(len(variables), -1), np.array(values), np.array(values) / (total or 1.0), df.count(), steps)


def scores(df: DataFrame, model: PcaModel, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns and one score column per component; rows with a missing variable have null scores."""
    x = model.prepared()
    return df.select(*(keep or []), *[dot(x, model.loadings[:, k]).alias(n) for k, n in enumerate(model.names)])


def t2_column(model: PcaModel, x: list[Column] | None = None) -> Column:
    x = x or model.prepared()
    floor = np.maximum(model.eigenvalues / (model.n - 1), 1e-10)
    parts = [dot(x, model.loadings[:, k]) for k in range(len(floor))]
    return sum((p * p / F.lit(float(v)) for p, v in zip(parts[1:], floor[1:])), parts[0] * parts[0] / F.lit(float(floor[0])))


def q_column(model: PcaModel, x: list[Column] | None = None) -> Column:
    """Sum of squares that the components leave: of x less that of the scores, for orthonormal loadings; at least 0."""
    x = x or model.prepared()
    parts = [dot(x, model.loadings[:, k]) for k in range(model.loadings.shape[1])]
    return F.greatest(sum((c * c for c in x[1:]), x[0] * x[0]) - sum((p * p for p in parts[1:]), parts[0] * parts[0]), F.lit(0.0))


def t2_limit(n: int, a: int, alpha: float) -> float:
    return 1e10 if n <= a else (n - 1) * a / (n - a) * f_quantile(alpha, a, n - a)


def q_limit_lognormal(df: DataFrame, model: PcaModel, alpha: float) -> float:
    """10 ** (mean + t * sd) of log10(Q + 1e-10)."""
    m, s, n = df.select(F.log10(q_column(model) + 1e-10).alias("l")).agg(F.avg("l"), F.stddev_samp("l"), F.count("l")).first()
    return 10 ** (m + t_quantile(alpha, n - 1) * (s or 0.0))


def limits(df: DataFrame, model: PcaModel, joint: bool = False) -> DataFrame:
    """(alpha, t2_limit, q_limit) at the levels for one statistic alone or for both together (fixed values)."""
    a = len(model.eigenvalues)
    rows = [(alpha, float(t2_limit(model.n, a, alpha)), float(q_limit_lognormal(df, model, alpha))) for alpha in ((0.974679, 0.994987, 0.9995) if joint else (0.95, 0.99, 0.999))]
    return df.sparkSession.createDataFrame(rows, "alpha double, t2_limit double, q_limit double")


def diagnostics(df: DataFrame, model: PcaModel, keep: list[str]) -> DataFrame:
    return df.select(*keep, t2_column(model).alias("t2"), q_column(model).alias("q"))


def variance_table(model: PcaModel, df: DataFrame) -> DataFrame:
    """(pc, eigenvalue, ratio, cumulative)."""
    total = np.cumsum(model.ratio)
    return df.sparkSession.createDataFrame([(n, float(v), float(r), float(c)) for n, v, r, c in zip(model.names, model.eigenvalues, model.ratio, total)], "pc string, eigenvalue double, ratio double, cumulative double")


def suggested_components(model: PcaModel, share: float = 0.8) -> int:
    hit = np.flatnonzero(np.cumsum(model.ratio) >= share)
    return int(hit[0]) + 1 if len(hit) else len(model.ratio)


def contributions(model: PcaModel, df: DataFrame, k: int | None = None) -> DataFrame:
    """(variable, contribution %, cumulative %): squared loadings weighted by the components' variance, largest first."""
    k = k or len(model.ratio)
    c = (model.loadings[:, :k] ** 2) @ model.ratio[:k]
    c = c / c.sum() * 100
    order = sorted(range(len(c)), key=lambda i: (-c[i], model.variables[i]))
    return df.sparkSession.createDataFrame([(model.variables[i], float(c[i]), float(t)) for i, t in zip(order, np.cumsum(c[order]))], "variable string, contribution double, cumulative double")


def loading_lists(model: PcaModel, df: DataFrame) -> DataFrame:
    """(pc, side, rank, variable, loading, share): loadings at least 0 from the largest, those below 0 from the least; share is % of the component's largest |loading|."""
    out = []
    for k, pc in enumerate(model.names):
        of = sorted(zip(model.loadings[:, k].tolist(), model.variables), key=lambda x: (-abs(x[0]), x[1]))
        most = abs(of[0][0]) or 1.0
        for side, chosen in (("positive", [x for x in of if x[0] >= 0]), ("negative", [x for x in of if x[0] < 0])):
            out += [(pc, side, i, v, x, round(abs(x) / most * 100, 1)) for i, (x, v) in enumerate(chosen, 1)]
    return df.sparkSession.createDataFrame(out, "pc string, side string, rank int, variable string, loading double, share double")


def strong_loadings(model: PcaModel, x: int, y: int, threshold: float = 0.4) -> list[tuple[str, float, float, float]]:
    """(variable, loading on x, loading on y, larger magnitude) of variables that reach the threshold on either component, strongest first."""
    found = [(v, float(a), float(b), float(max(abs(a), abs(b)))) for v, a, b in zip(model.variables, model.loadings[:, x], model.loadings[:, y])]
    return sorted((f for f in found if f[3] >= threshold), key=lambda f: -f[3])


def loading_contributions(df: DataFrame, model: PcaModel, x: int = 0, y: int = 1, threshold: float = 0.4) -> DataFrame:
    return df.sparkSession.createDataFrame(strong_loadings(model, x, y, threshold), "variable string, x double, y double, magnitude double")


def interpreted(df: DataFrame, model: PcaModel, row_id: str, x: int = 0, y: int = 1, threshold: float = 0.4) -> DataFrame:
    """(row_id, side_x, side_y, text): on which side of both components a row lies, and the variables whose loadings there exceed the threshold."""
    strong, names = strong_loadings(model, x, y, threshold), (model.names[x], model.names[y])
    rows = scores(df, model, [row_id])
    if not strong:
        return rows.select(row_id, F.lit(None).cast("string").alias("side_x"), F.lit(None).cast("string").alias("side_y"), F.concat(F.lit("Sample "), F.col(row_id).cast("string"), F.lit(f" has no strong variable associations (threshold={threshold}).")).alias("text"))
    rest = ""
    for at, name in enumerate(names, 1):
        for level, sign in (("HIGH", 1), ("LOW", -1)):
            listed = [s[0] for s in strong if s[at] * sign > threshold]
            rest += f"\nOn {name}, this sample has {level} levels of: {', '.join(listed)}." if listed else ""
    side = {n: F.when(F.col(n) > 0, "HIGH").otherwise("LOW") for n in names}
    place = " and ".join([f"%s on {n} (score=%.2f)" for n in names])
    text = F.format_string(f"Sample %s is positioned {place}.", F.col(row_id).cast("string"), side[names[0]], F.col(names[0]), side[names[1]], F.col(names[1]))
    return rows.select(row_id, side[names[0]].alias("side_x"), side[names[1]].alias("side_y"), F.concat(text, F.lit(rest)).alias("text"))


def leverage(df: DataFrame, model: PcaModel, keep: list[str]) -> DataFrame:
    """t (T'T)^-1 t' of each row, T'T being diagonal with the eigenvalues."""
    x = model.prepared()
    parts = [dot(x, model.loadings[:, k]) for k in range(len(model.eigenvalues))]
    return df.select(*keep, sum((p * p / float(v) for p, v in zip(parts[1:], model.eigenvalues[1:])), parts[0] * parts[0] / float(model.eigenvalues[0])).alias("leverage"))


def explained_by_variable(df: DataFrame, model: PcaModel) -> DataFrame:
    """(variable, explained): 1 - residual over total sum of squares, kept within 0..1; 0 for a variable without variance."""
    x = model.prepared()
    t = [dot(x, model.loadings[:, k]) for k in range(model.loadings.shape[1])]
    rest = [c - dot(t, model.loadings[i]) for i, c in enumerate(x)]
    row = df.agg(*[e for c, r in zip(x, rest) for e in (F.sum(c * c), F.sum(r * r))]).first()
    out = [(v, 0.0 if row[2 * i] <= 1e-10 else min(1.0, max(0.0, 1 - row[2 * i + 1] / row[2 * i]))) for i, v in enumerate(model.variables)]
    return df.sparkSession.createDataFrame(out, "variable string, explained double").orderBy(F.desc("explained"), "variable")


def cross_validated(df: DataFrame, order: str, variables: list[str], most: int, folds: int = 7, center: bool = True, scale: bool = False) -> DataFrame:
    """(n_components, press, q2, rmsecv) over contiguous folds, the last with the remainder; one pass of cross products for all folds, one for PRESS."""
    from statloom.operators.ordered import with_position

    rows = with_position(df.dropna(subset=variables).select(order, *[F.col(v).cast("double").alias(v) for v in variables]), order, "_pos")
    n = rows.count()
    size = n // folds
    rows = rows.withColumn("_fold", F.least(F.floor(F.col("_pos") / size), F.lit(folds - 1)))
    p = len(variables)
    center0 = [float(v) for v in df.agg(*[F.avg(v) for v in variables]).first()]
    d = [F.col(v) - c for v, c in zip(variables, center0)]
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    parts = {}
    for r in rows.groupBy("_fold").agg(F.count("*").alias("n"), *[F.sum(x).alias(f"s{i}") for i, x in enumerate(d)], *[F.sum(d[i] * d[j]).alias(f"g{i}_{j}") for i, j in pairs]).collect():
        g = np.zeros((p, p))
        for i, j in pairs:
            g[i, j] = g[j, i] = r[f"g{i}_{j}"]
        parts[int(r["_fold"])] = (r.n, np.array([r[f"s{i}"] for i in range(p)]), g)
    press, total = np.zeros(most), 0.0
    for f, (m, s, g) in parts.items():
        k, ts, tg = (sum(parts[o][i] for o in parts if o != f) for i in range(3))
        mean = ts / k if center else -np.array(center0)
        cov = tg - np.outer(mean, ts) - np.outer(ts, mean) + k * np.outer(mean, mean)
        sd = np.sqrt(np.maximum(np.diag(cov) / k, 0)) if scale else np.ones(p)
        sd = np.where(sd > 0, sd, 1.0)
        held = (g - np.outer(mean, s) - np.outer(s, mean) + m * np.outer(mean, mean)) / np.outer(sd, sd)
        vectors = np.linalg.eigh(cov / np.outer(sd, sd))[1][:, ::-1]
        total += np.trace(held)
        for a in range(most):
            v = vectors[:, : a + 1]
            press[a] += np.trace(held) - np.trace(v.T @ held @ v)
    out = [(a + 1, float(press[a]), float(1 - press[a] / total), float(sqrt(max(press[a], 0) / (n * p)))) for a in range(most)]
    return df.sparkSession.createDataFrame(out, "n_components int, press double, q2 double, rmsecv double")


def varimax(loadings: np.ndarray, sweeps: int = 100) -> np.ndarray:
    """Plane rotations of pairs of components by the angle, of -90..90 degrees in steps of 0.1, that makes the sum of fourth powers largest, until none improves."""
    l = loadings.copy()
    angles = np.deg2rad(np.arange(-900, 901) / 10)
    c, s = np.cos(angles), np.sin(angles)
    for _ in range(sweeps):
        better = False
        for i in range(l.shape[1]):
            for j in range(i + 1, l.shape[1]):
                a, b = np.outer(l[:, i], c) + np.outer(l[:, j], s), np.outer(l[:, j], c) - np.outer(l[:, i], s)
                value = (a**4 + b**4).sum(0)
                at = int(np.argmax(value))
                if value[at] > (l[:, i] ** 4 + l[:, j] ** 4).sum() * (1 + 1e-12):
                    l[:, i], l[:, j], better = a[:, at], b[:, at], True
        if not better:
            break
    return l


def rotated(df: DataFrame, model: PcaModel) -> PcaModel:
    """The model after varimax, components by their share of variance, named RC1, RC2, ..."""
    l = varimax(model.loadings)
    x = model.prepared()
    t = [dot(x, l[:, k]) for k in range(l.shape[1])]
    row = df.agg(*[F.sum(p * p) for p in t], sum((F.sum(c * c) for c in x[1:]), F.sum(x[0] * x[0]))).first()
    values = np.array(row[:-1], float)
    order = np.argsort(-values, kind="stable")
    return PcaModel(model.variables, model.mean, model.scale, l[:, order], values[order], values[order] / row[-1], model.n, [], [f"RC{i + 1}" for i in range(len(order))])


def quadrant(x: Column, y: Column) -> Column:
    return F.when((F.abs(x) < 0.01) | (F.abs(y) < 0.01), "Axis").when((x > 0) & (y > 0), "Q1").when((x < 0) & (y > 0), "Q2").when((x < 0) & (y < 0), "Q3").otherwise("Q4")


def strength(l: Column) -> Column:
    return F.when(F.abs(l) >= 0.7, "Strong").when(F.abs(l) >= 0.4, "Moderate").when(F.abs(l) >= 0.2, "Weak").otherwise("Negligible")


def antiderivative(loadings: np.ndarray, order: int = 1) -> np.ndarray:
    """Cumulative trapezoids along the variables, starting at 0, ``order`` times."""
    for _ in range(order):
        loadings = np.vstack([np.zeros((1, loadings.shape[1])), np.cumsum((loadings[1:] + loadings[:-1]) / 2, axis=0)])
    return loadings
