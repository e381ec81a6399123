"""Process monitoring: a component model of good batches, control limits, and the faults of new rows."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.functions.dist import chi2_quantile
from statloom.operators.gram import moments
from statloom.operators.pca import PcaModel, dot, prepared_gram, q_column, t2_limit
from statloom.operators.quantiles import exact_quantiles

ALPHAS = (0.975, 0.995, 0.9995)


@dataclass
class Monitor:
    model: PcaModel
    variance: np.ndarray  # of the scores, n - 1
    alphas: tuple[float, ...]
    t2_limits: list[float]
    q_limits: list[float]
    scaling: str = "auto"

    def to_json(self) -> str:
        m = {k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in asdict(self.model).items()}
        return json.dumps({"model": m, "variance": self.variance.tolist(), "alphas": list(self.alphas), "t2_limits": self.t2_limits, "q_limits": self.q_limits, "scaling": self.scaling})

    @classmethod
    def from_json(cls, text: str) -> Monitor:
        d = json.loads(text)
        m = {k: np.array(v) if k in ("mean", "scale", "loadings", "eigenvalues", "ratio") else v for k, v in d["model"].items()}
        return cls(PcaModel(**m), np.array(d["variance"]), tuple(d["alphas"]), d["t2_limits"], d["q_limits"], d.get("scaling", "auto"))


def q_limit_box(mean: float, var: float, alpha: float) -> float:
    """g * chi2_h with g = var / (2 mean) and h = 2 mean^2 / var; where all rows have one Q, each of its percentiles is that."""
    if mean <= 0 or var <= 0:
        return mean
    return var / (2 * mean) * chi2_quantile(alpha, 2 * mean * mean / var)


def fit(df: DataFrame, variables: list[str], components: int | float | None = None, scaling: str = "auto", alphas: tuple[float, ...] = ALPHAS, q_ddof: int = 0) -> Monitor:
    """Fit on good rows. ``components``: a number, a share of variance to reach, or all; ``scaling``: none, auto (population sd) or pareto (its root)."""
    m = moments(df, variables)
    sd = np.sqrt(np.diag(m.scatter) / m.n)
    div = {"none": np.ones_like(sd), "auto": sd, "pareto": np.sqrt(sd)}[scaling]
    div = np.where(div > 0, div, 1.0)
    values, vectors = np.linalg.eigh(m.scatter / np.outer(div, div))
    values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
    signs = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(values))])
    vectors = vectors * np.where(signs == 0, 1, signs)
    share = values / values.sum()
    k = len(values) if components is None else int(np.searchsorted(np.cumsum(share), components) + 1) if isinstance(components, float) else components
    model = PcaModel(variables, m.mean, div, vectors[:, :k], values[:k], share[:k], m.n)
    mean, var = df.select(q_column(model).alias("q")).agg(F.avg("q"), F.var_pop("q") if q_ddof == 0 else F.var_samp("q")).first()
    return Monitor(model, values[:k] / (m.n - 1), alphas, [t2_limit(m.n, k, a) for a in alphas], [q_limit_box(mean, var, a) for a in alphas], scaling)


def t2_of(monitor: Monitor) -> Column:
    x = monitor.model.prepared()
    parts = [dot(x, monitor.model.loadings[:, k]) for k in range(len(monitor.variance))]
    floor = np.maximum(monitor.variance, 1e-10)
    return sum((p * p / float(v) for p, v in zip(parts[1:], floor[1:])), parts[0] * parts[0] / float(floor[0]))


def faults(df: DataFrame, monitor: Monitor, keep: list[str]) -> DataFrame:
    """keep, t2, q, fault (none, t2, q, both) against the lowest limits."""
    rows = df.select(*keep, t2_of(monitor).alias("t2"), q_column(monitor.model).alias("q"))
    t, q = F.col("t2") > monitor.t2_limits[0], F.col("q") > monitor.q_limits[0]
    return rows.withColumn("fault", F.when(t & q, "both").when(t, "t2").when(q, "q").otherwise("none"))


def outlier_levels(rows: DataFrame, monitor: Monitor) -> DataFrame:
    """(statistic, alpha, independent, joint): rows above each limit, and rows whose highest exceeded limit it is."""
    spark, parts = rows.sparkSession, []
    exprs, keys = [], []
    over = {"t2": monitor.t2_limits, "q": monitor.q_limits}
    for name in ("t2", "q", "t2 or q"):
        hit = [F.col(name) > over[name][i] if name in over else (F.col("t2") > monitor.t2_limits[i]) | (F.col("q") > monitor.q_limits[i]) for i in range(len(monitor.alphas))]
        for i, a in enumerate(monitor.alphas):
            keys.append((name, a))
            alone = hit[i] if i + 1 == len(hit) else hit[i] & ~hit[i + 1]
            exprs += [F.count_if(hit[i]), F.count_if(alone)]
    row = rows.agg(*exprs).first()
    parts = [(n, float(a), row[2 * i], row[2 * i + 1]) for i, (n, a) in enumerate(keys)]
    return spark.createDataFrame(parts, "statistic string, alpha double, independent bigint, joint bigint")


def limits_table(df: DataFrame, monitor: Monitor) -> DataFrame:
    return df.sparkSession.createDataFrame([(float(a), float(t), float(q)) for a, t, q in zip(monitor.alphas, monitor.t2_limits, monitor.q_limits)], "alpha double, t2_limit double, q_limit double")


def summary(df: DataFrame, monitor: Monitor) -> DataFrame:
    """One row: components, variables, training rows, explained share (whole and by component), scaling and limits."""
    m = monitor.model
    row = (len(m.ratio), len(m.variables), int(m.n), float(m.ratio.sum()), m.ratio.tolist(), monitor.scaling, list(monitor.alphas), [float(t) for t in monitor.t2_limits], [float(q) for q in monitor.q_limits])
    return df.sparkSession.createDataFrame([row], "n_components int, n_variables int, n_rows bigint, explained double, explained_by_pc array<double>, scaling string, alphas array<double>, t2_limits array<double>, q_limits array<double>")


def variable_shares(rows: DataFrame, monitor: Monitor, keep: list[str]) -> DataFrame:
    """keep, variable, t2, q: a variable's loading times t^2 over the score's variance, summed over components, and its squared residual."""
    m = monitor.model
    x = m.prepared()
    t = [dot(x, m.loadings[:, k]) for k in range(m.loadings.shape[1])]
    squares = [s * s / float(v) for s, v in zip(t, np.maximum(monitor.variance, 1e-10))]
    cells = [F.struct(F.lit(v).alias("variable"), dot(squares, m.loadings[i]).alias("t2"), F.pow(x[i] - dot(t, m.loadings[i]), 2).alias("q")) for i, v in enumerate(m.variables)]
    return rows.select(*keep, F.inline(F.array(*cells)))


def contributed(rows: DataFrame, monitor: Monitor, statistic: str = "q", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns and ``_c0``, ``_c1`` ...: each variable's part in Q, sign(r) * r^2, or in T2, the row of X P diag(1 / sd) P' (sd: population, of the scores).

    Prepared values, scores and residuals are columns of their own: one expression of them all repeats each score for every variable that
    uses it, in a generated method too large to be compiled.
    """
    m = monitor.model
    keep, p, a = keep or [], range(len(m.variables)), range(m.loadings.shape[1])
    x, t, r = ([F.col(f"_{name}{i}") for i in of] for name, of in (("x", p), ("t", a), ("r", p)))
    made = rows.select(*keep, *[c.alias(f"_x{i}") for i, c in enumerate(m.prepared())])
    made = made.select(*keep, *x, *[dot(x, m.loadings[:, k]).alias(f"_t{k}") for k in a])
    if statistic == "q":
        made = made.select(*keep, *[(x[i] - dot(t, m.loadings[i])).alias(f"_r{i}") for i in p])
        return made.select(*keep, *[(F.signum(r[i]) * r[i] * r[i]).alias(f"_c{i}") for i in p])
    sd = np.sqrt(m.eigenvalues / m.n)
    return made.select(*keep, *[dot(t, m.loadings[i] / np.where(sd > 0, sd, 1.0)).alias(f"_c{i}") for i in p])


def contribution_table(train: DataFrame, rows: DataFrame, monitor: Monitor, row_id: str, statistic: str = "q") -> DataFrame:
    """(row_id, variable, value, training_mean, difference, contribution, flagged): contributions over the training rows' 95th percentile of |contribution|."""
    variables = monitor.model.variables
    sizes = contributed(train, monitor, statistic).select(F.inline(F.array(*[F.struct(F.lit(v).alias("variable"), F.abs(f"_c{i}").alias("size")) for i, v in enumerate(variables)])))
    norm = {r.variable: r.q[0] for r in exact_quantiles(sizes, ["variable"], "size", [0.95], train.count()).collect()}  # one row a variable
    mean = dict(zip(variables, monitor.model.mean))
    cells = [
        F.struct(F.lit(v).alias("variable"), F.col(f"_v{i}").alias("value"), F.lit(float(mean[v])).alias("training_mean"), (F.col(f"_v{i}") - float(mean[v])).alias("difference"), (F.col(f"_c{i}") / float(norm.get(v) or 1.0)).alias("contribution"))
        for i, v in enumerate(variables)
    ]
    values = [f"_v{i}" for i in range(len(variables))]
    made = contributed(rows.withColumns({n: F.col(v).cast("double") for n, v in zip(values, variables)}), monitor, statistic, [row_id, *values])
    return made.select(row_id, F.inline(F.array(*cells))).withColumn("flagged", F.abs("contribution") > 1)


def ellipse(n: int, share: float, p: int, alpha: float, at: int = 100) -> tuple[float, float]:
    """Radius factor of a score ellipse; the constants are fixed values of the chi-square law with 2 degrees of freedom."""
    c = {0.95: 2.996, 0.99: 4.605, 0.999: 6.908}[alpha]
    return float(np.sqrt(share * (n - 1) / n * p) * np.sqrt(2 * (n * n - 1) / (n * (n - 2)) * c)), at
