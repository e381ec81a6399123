"""Response and confidence surfaces over a grid of two factors, for one response or many."""

from __future__ import annotations

from math import floor, sqrt

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.functions.dist import t_quantile
from statloom.operators.mlr import Regression


def grid(spark: SparkSession, low: float, high: float, steps: int) -> DataFrame:
    """(ix, iy, x, y): low, low + step, ... up to high in both directions, from whole numbers."""
    step = (high - low) / steps
    n = floor((high - low) / step + 1e-9) + 1
    return spark.range(n * n).select((F.col("id") % n).cast("int").alias("ix"), F.floor(F.col("id") / n).cast("int").alias("iy")).selectExpr("ix", "iy", f"{low!r}D + ix * {step!r}D as x", f"{low!r}D + iy * {step!r}D as y")


def surface(spark: SparkSession, model: Regression, v1: str, v2: str, fixed: dict[str, float], low: float = -1.0, high: float = 1.0, steps: int = 30, s: float | None = None, dof: int | None = None, s_exp: float | None = None, dof_exp: int | None = None, n_exp: int = 1) -> DataFrame:
    """(ix, iy, x, y, z, ci): response and the half-width of its 95 % interval; with ``s_exp`` that of n_exp experiments is added in squares."""
    values: dict[str, Column] = {k: F.lit(float(v)) for k, v in fixed.items()} | {v1: F.col("x"), v2: F.col("y")}
    s, dof = s or model.s or 0.0, dof or model.dof
    t = t_quantile(0.975, dof) if dof > 0 else 0.0
    own = F.sqrt(F.greatest(model.leverage(values), F.lit(0.0))) * (t * s)
    extra = t_quantile(0.975, dof_exp) * s_exp * sqrt(1 / n_exp) if s_exp and dof_exp else 0.0
    ci = F.sqrt(own * own + extra * extra) if extra else own
    return grid(spark, low, high, steps).select("ix", "iy", "x", "y", model.fitted(values).alias("z"), ci.alias("ci"))


def surfaces(spark: SparkSession, models: dict[str, Regression | None], v1: str, v2: str, fixed: dict[str, float], **how) -> DataFrame:
    """The surfaces of all responses in one table with a column ``response``; responses without a model are left out."""
    parts = [surface(spark, m, v1, v2, fixed, **how).withColumn("response", F.lit(n)) for n, m in models.items() if m is not None]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def conservative(objective: str) -> Column:
    """The surface that is safe for the objective: less, or more, its interval."""
    if objective in ("Maximize", "Threshold_Above"):
        return F.col("z") - F.col("ci")
    return F.col("z") + F.col("ci") if objective in ("Minimize", "Threshold_Below") else F.col("z")


def bounds(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    return rows.groupBy(*(by or [])).agg(F.min("z").alias("z_min"), F.max("z").alias("z_max"), (F.max("z") - F.min("z")).alias("z_range"), F.min("ci").alias("ci_min"), F.max("ci").alias("ci_max"))


def optimum(rows: DataFrame, largest: bool = True) -> DataFrame:
    """The grid point of the largest (smallest) response, the first in grid order among equals."""
    return rows.orderBy(F.desc("z") if largest else F.asc("z"), "iy", "ix").limit(1)


def feasible(rows: DataFrame, criteria: dict[str, tuple[str, float, float]], use_ci: bool = True) -> DataFrame:
    """(ix, iy, x, y, feasible): whether all responses meet (kind, low, high) of ``criteria``: Threshold_Above low, Threshold_Below high, Target low..high."""
    half = F.col("ci") if use_ci else F.lit(0.0)
    ok = F.lit(True)
    for name, (kind, low, high) in criteria.items():
        above, below = F.col("z") - half >= F.lit(low), F.col("z") + half <= F.lit(high)
        hold = above if kind == "Threshold_Above" else below if kind == "Threshold_Below" else above & below
        ok = F.when(F.col("response") == name, hold).otherwise(ok)
    return rows.withColumn("_ok", ok).groupBy("ix", "iy", "x", "y").agg(F.bool_and("_ok").alias("feasible"))


def overlay(rows: DataFrame, criteria: dict[str, tuple[str, float, float]], use_ci: bool = True) -> DataFrame:
    """(ix, iy, x, y, met, of, failing): how many of the criteria each grid point meets, of how many, and the first response, by name, that fails."""
    each = [feasible(rows.where(F.col("response") == name), {name: spec}, use_ci).select("ix", "iy", "x", "y", F.lit(name).alias("response"), "feasible") for name, spec in criteria.items()]
    out = each[0]
    for p in each[1:]:
        out = out.unionByName(p)
    return out.groupBy("ix", "iy", "x", "y").agg(F.count_if("feasible").alias("met"), F.count("*").alias("of"), F.min(F.when(~F.col("feasible"), F.col("response"))).alias("failing"))


def largest_rectangle(mask: np.ndarray) -> tuple[int, int, int, int, int]:
    """(area, row, row, column, column), bounds included, of the largest block of ones; the first found among equals."""
    best, height = (0, 0, -1, 0, -1), np.zeros(mask.shape[1], int)
    for r, row in enumerate(mask):
        height = np.where(row, height + 1, 0)
        stack: list[int] = []
        for c in range(len(height) + 1):
            h = height[c] if c < len(height) else 0
            while stack and height[stack[-1]] >= h:
                top = height[stack.pop()]
                left = stack[-1] + 1 if stack else 0
                if top * (c - left) > best[0]:
                    best = (int(top * (c - left)), r - int(top) + 1, r, left, c - 1)
            stack.append(c)
    return best


def feasible_rectangle(cells: DataFrame) -> dict | None:
    """Bounds of the largest axis-parallel block of feasible grid points; a grid is small by construction, so it comes to the driver."""
    rows = cells.select("ix", "iy", "x", "y", "feasible").collect()
    if not rows:
        return None
    mask = np.zeros((max(r.iy for r in rows) + 1, max(r.ix for r in rows) + 1), bool)
    xs, ys = {}, {}
    for r in rows:
        mask[r.iy, r.ix], xs[r.ix], ys[r.iy] = r.feasible, r.x, r.y
    area, top, bottom, left, right = largest_rectangle(mask)
    if not area:
        return None
    return {"points": area, "x": (xs[left], xs[right]), "y": (ys[top], ys[bottom]), "feasible_percent": 100.0 * mask.mean(), "coverage_percent": 100.0 * area / max(mask.sum(), 1)}


def with_interval(df: DataFrame, model: Regression, level: float = 0.95, s: float | None = None, dof: int | None = None, s_exp: float | None = None, dof_exp: int | None = None, n_exp: int = 1) -> DataFrame:
    """Adds <y>_predicted, <y>_leverage, <y>_ci_model, <y>_ci_semiwidth, <y>_predicted_lower and <y>_predicted_upper to points of the model's variables.

    With ``s_exp`` the half-width of n_exp experiments (its own degrees of freedom, the model's if none are given) is added in squares.
    """
    s, dof = s or model.s, dof or model.dof
    if not s or dof <= 0:
        raise ValueError("an interval needs degrees of freedom")
    extra = t_quantile(0.5 + level / 2, dof_exp or dof) * s_exp * sqrt(1 / n_exp) if s_exp else 0.0
    y = model.y
    out = df.withColumns({f"{y}_predicted": model.fitted(), f"{y}_leverage": F.greatest(model.leverage(), F.lit(0.0))})
    out = out.withColumn(f"{y}_ci_model", F.sqrt(F.col(f"`{y}_leverage`")) * (t_quantile(0.5 + level / 2, dof) * s))
    out = out.withColumn(f"{y}_ci_semiwidth", F.sqrt(F.pow(F.col(f"`{y}_ci_model`"), 2) + extra * extra))
    return out.withColumns({f"{y}_predicted_lower": F.col(f"`{y}_predicted`") - F.col(f"`{y}_ci_semiwidth`"), f"{y}_predicted_upper": F.col(f"`{y}_predicted`") + F.col(f"`{y}_ci_semiwidth`")})


def target_share(rows: DataFrame, low: float, high: float) -> DataFrame:
    """One row: cells, those whose whole interval lies within low..high, and their percentage."""
    inside = (F.col("z") - F.col("ci") >= low) & (F.col("z") + F.col("ci") <= high)
    return rows.agg(F.count("*").alias("n"), F.count_if(inside).alias("n_inside")).withColumn("percent", F.try_divide(F.col("n_inside") * 100.0, F.col("n")))


def interpretation(rows: DataFrame, criteria: dict[str, tuple[str, float, float]]) -> DataFrame:
    """(response, objective, x, y, z, ci): each response's best cell: largest, smallest, or nearest the middle of its target; the first in grid order among equals."""
    spec = F.lit(None).cast("string")
    loss = F.lit(None).cast("double")
    for name, (kind, low, high) in criteria.items():
        own = F.col("response") == name
        spec = F.when(own, kind).otherwise(spec)
        loss = F.when(own, -F.col("z") if kind in ("Maximize", "Threshold_Above") else F.col("z") if kind in ("Minimize", "Threshold_Below") else F.abs(F.col("z") - (low + high) / 2)).otherwise(loss)
    cell = F.struct(loss.alias("loss"), "iy", "ix", "x", "y", "z", "ci")
    best = rows.where(F.col("response").isin(*criteria)).groupBy("response", spec.alias("objective")).agg(F.min(cell).alias("b"))
    return best.select("response", "objective", "b.x", "b.y", "b.z", "b.ci")
