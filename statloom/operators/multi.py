"""Several responses on one set of terms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from statloom.operators import mlr
from statloom.operators.mlr import Regression


def fit_all(df: DataFrame, ys: list[str], terms: list[str]) -> dict[str, Regression | None]:
    return dict(zip(ys, mlr.fit(df, ys, terms)))


def summaries(df: DataFrame, models: dict[str, Regression | None]) -> DataFrame:
    """(response, r2_adjusted, rmse, dof, q2, rmsecv, status)."""
    rows = []
    for name, m in models.items():
        if m is None:
            rows.append((name, None, None, None, None, None, "failed"))
            continue
        d = mlr.diagnostics(df, m, []).agg(F.sum(F.col("cv_residual") * F.col("cv_residual"))).first()[0]
        rows.append((name, m.r2_adjusted, m.s, m.dof, None if d is None else 1 - d / (m.var_y * m.n), None if d is None else (d / m.n) ** 0.5, "ok"))
    return df.sparkSession.createDataFrame(rows, "response string, r2_adjusted double, rmse double, dof bigint, q2 double, rmsecv double, status string")


def diagnostics(df: DataFrame, models: dict[str, Regression | None], keep: list[str]) -> DataFrame:
    """The diagnostics of every response's model in one table with a column ``response``; failed models have no rows."""
    parts = [mlr.diagnostics(df, m, keep).select(F.lit(n).alias("response"), *keep, "observed", "fitted", "residual", "leverage", "cv_predicted", "cv_residual") for n, m in models.items() if m is not None]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def comparison(df: DataFrame, models: dict[str, Regression | None]) -> DataFrame:
    """(term, response, coefficient, relative): relative to the largest |coefficient| of the response without the intercept."""
    rows = [(t, n, float(b)) for n, m in models.items() if m is not None for t, b in zip(m.terms, m.beta)]
    table = df.sparkSession.createDataFrame(rows, "term string, response string, coefficient double")
    largest = F.max(F.when(F.col("term") != "Intercept", F.abs("coefficient"))).over(Window.partitionBy("response"))
    return table.withColumn("relative", F.when(F.col("term") != "Intercept", F.try_divide(F.col("coefficient"), largest)).otherwise(F.col("coefficient")))


def predictions(df: DataFrame, models: dict[str, Regression | None], keep: list[str]) -> DataFrame:
    """keep and one predicted column per response, from one scan."""
    return df.select(*keep, *[m.fitted().alias(n) for n, m in models.items() if m is not None])


def weighted_objective(rows: DataFrame, weights: dict[str, float], directions: dict[str, str]) -> DataFrame:
    """Adds objective: weighted sum of min-max scaled responses, turned round for 'minimize', 0.5 for a flat one."""
    stats = rows.agg(*[e for n in weights for e in (F.min(n), F.max(n))]).first()
    total = F.lit(0.0)
    for i, (n, w) in enumerate(weights.items()):
        low, high = stats[2 * i], stats[2 * i + 1]
        u = F.lit(0.5) if low == high else (F.col(n) - float(low)) / float(high - low)
        total = total + float(w) * (1 - u if directions[n] == "minimize" and low != high else u)
    return rows.withColumn("objective", total)
