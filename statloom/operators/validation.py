"""Checks of designs and regressions: a design without responses, replicates row by row, points left out of the fit, model error against pure error."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.functions.dist import t_quantile
from statloom.operators import mlr
from statloom.operators.mlr import Regression


def design(df: DataFrame, terms: list[str]) -> Regression | None:
    """The terms' cross products alone, as the fit of a response of zeros; None where the terms are linearly dependent."""
    return mlr.fit(df.withColumn("_zero", F.lit(0.0)), "_zero", terms)


def leverages(df: DataFrame, model: Regression, keep: list[str], std: float | None = None, dof: int | None = None) -> DataFrame:
    """keep, leverage, high (above 2p / n), half_width t * std * sqrt(leverage) with the replicates' deviation, null without replicates."""
    width = F.sqrt("leverage") * (t_quantile(0.975, dof) * std) if std is not None and dof else F.lit(None).cast("double")
    return df.select(*keep, model.leverage().alias("leverage")).select(*keep, "leverage", (F.col("leverage") > 2.0 * len(model.terms) / model.n).alias("high"), width.alias("half_width"))


def design_summary(df: DataFrame, model: Regression) -> DataFrame:
    """One row: n, n_terms, dof, trace and determinant of the dispersion matrix, mean, max and number of high leverages, largest VIF."""
    found = leverages(df, model, []).agg(F.avg("leverage").alias("mean_leverage"), F.max("leverage").alias("max_leverage"), F.count_if("high").alias("n_high"))
    vif = max((v for v in model.vif if v is not None), default=None)
    return found.select(
        F.lit(model.n).cast("bigint").alias("n"), F.lit(len(model.terms)).alias("n_terms"), F.lit(model.dof).cast("bigint").alias("dof"), F.lit(float(np.trace(model.inverse))).alias("trace"),
        F.lit(float(np.linalg.det(model.inverse))).alias("determinant"), "mean_leverage", "max_leverage", "n_high", F.lit(vif).cast("double").alias("max_vif"),
    )


def dispersion(df: DataFrame, model: Regression) -> DataFrame:
    """(term, other, value): the inverse of X'X with its labels."""
    cells = [(a, b, float(model.inverse[i, j])) for i, a in enumerate(model.terms) for j, b in enumerate(model.terms)]
    return df.sparkSession.createDataFrame(cells, "term string, other string, value double")


def replicate_rows(df: DataFrame, x: list[str], y: str, keep: list[str]) -> DataFrame:
    """keep, y, n, mean, deviation: rows that share their x with another row, against the mean of those rows."""
    at = {f"_x{i}": F.round(F.col(c).cast("double"), 10) for i, c in enumerate(x)}
    rows = df.select(*dict.fromkeys([*keep, y]), *[e.alias(a) for a, e in at.items()])
    groups = rows.groupBy(*at).agg(F.count("*").alias("n"), F.avg(y).alias("mean")).where("n > 1")
    same = [rows[a].eqNullSafe(groups[a]) for a in at]
    return rows.join(groups, same).select(*[rows[c] for c in dict.fromkeys([*keep, y])], "n", "mean", (rows[y] - F.col("mean")).alias("deviation"))


def left_out(df: DataFrame, model: Regression, y: str, std: float, dof: int, by: list[str] | None = None) -> DataFrame:
    """Points kept out of the fit, one row a group of ``by`` (or one for all): n, predicted, mean, std, rmse of the prediction, leverage,
    half_width t * std * sqrt(1 / n + leverage) about the mean, whether the prediction lies within, and whether rmse is below 1.5 s of the model.

    ``std`` and ``dof`` are the replicates'. Rows without y take no part; squares of the model count like its other terms.
    """
    keys = by or []
    rows = df.where(F.col(y).isNotNull()).select(*keys, F.col(y).cast("double").alias("_y"), model.fitted().alias("_f"), model.leverage().alias("_h"))
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("_f").alias("predicted"), F.avg("_y").alias("mean"), F.coalesce(F.stddev_samp("_y"), F.lit(0.0)).alias("std"),
        F.sqrt(F.avg(F.pow(F.col("_y") - F.col("_f"), 2))).alias("rmse"), F.avg("_h").alias("leverage"),
    ).where("n > 0")
    out = out.withColumn("half_width", F.sqrt(1 / F.col("n") + F.col("leverage")) * (t_quantile(0.975, dof) * std))
    return out.withColumn("within", F.abs(F.col("predicted") - F.col("mean")) <= F.col("half_width")).withColumn("valid", F.col("rmse") < 1.5 * (model.s or 0.0))


def error_comparison(groups: DataFrame, model: Regression) -> DataFrame:
    """One row: rmse of the model, pooled deviation of the replicate groups, their ratio and its verdict: close (below 1.2), reasonable (below 2), exceeds."""
    out = mlr.pooled(groups).select(F.lit(model.s).cast("double").alias("rmse"), F.col("std").alias("experimental"))
    out = out.withColumn("ratio", F.try_divide("rmse", "experimental"))
    return out.withColumn("verdict", F.when(F.col("ratio") < 1.2, "close").when(F.col("ratio") < 2.0, "reasonable").when(F.col("ratio") >= 2.0, "exceeds"))


def term_table(df: DataFrame, names: list[str]) -> DataFrame:
    """(term, kind, colour) in the order given; the colours are fixed values."""
    colour = {"intercept": "#808080", "quadratic": "#00CED1", "interaction": "#32CD32", "linear": "#DC143C"}
    return df.sparkSession.createDataFrame([(n, mlr.term_kind(n), colour[mlr.term_kind(n)]) for n in names], "term string, kind string, colour string")


def separators(names: list[str]) -> dict[str, float | None]:
    """Where bars of linear terms end and where those of interactions end, half a bar before the next; None where nothing follows."""
    kinds = [mlr.term_kind(n) for n in names]
    first, linear, pairs, squares = (kinds.count(k) for k in ("intercept", "linear", "interaction", "quadratic"))
    return {"linear_end": first + linear - 0.5 if linear and pairs + squares else None, "interaction_end": first + linear + pairs - 0.5 if pairs and squares else None}
