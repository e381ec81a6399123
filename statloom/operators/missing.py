"""Filling missing cells from a few principal components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.operators.gram import moments
from statloom.operators.pca import PcaModel, dot, nipals_gram
from statloom.operators.univariate import unpivoted


def reconstructed(df: DataFrame, variables: list[str], k: int, center: bool = True, scale: bool = False, max_steps: int = 1000, threshold: float = 1e-6) -> tuple[DataFrame, PcaModel]:
    """Missing cells become what k components of the mean-filled matrix give for them; present cells and other columns stay."""
    stats = df.agg(*[e for v in variables for e in (F.avg(v), F.stddev_samp(v))]).first()
    mean = [float(stats[2 * i] or 0.0) for i in range(len(variables))]
    sd = [float(stats[2 * i + 1] or 0.0) for i in range(len(variables))]
    sd = [s if s >= 1e-10 else 1.0 for s in sd] if scale else [1.0] * len(sd)
    shift = mean if center else [0.0] * len(mean)
    filled = [(F.coalesce(F.col(v).cast("double"), F.lit(m)) - c) / s for v, m, c, s in zip(variables, mean, shift, sd)]
    m = moments(df.select(*[f.alias(f"f{i}") for i, f in enumerate(filled)]), [f"f{i}" for i in range(len(filled))])
    loadings, values, steps = nipals_gram(m.raw, k, max_steps, threshold)
    t = [dot(filled, loadings[:, j]) for j in range(loadings.shape[1])]
    back = {v: F.coalesce(F.col(v).cast("double"), dot(t, loadings[i]) * s + c) for i, (v, c, s) in enumerate(zip(variables, shift, sd))}
    return df.withColumns(back), PcaModel(variables, np.array(shift), np.array(sd), loadings, values, values / max(np.trace(m.raw), 1e-300), m.n, steps)


def filled_report(before: DataFrame, after: DataFrame, row_id: str, variables: list[str]) -> DataFrame:
    """(variable, n_filled, mean, std (population), min, max) of the filled cells."""
    old = before.select(row_id, *[F.col(v).isNull().alias(v) for v in variables]).unpivot([row_id], variables, "variable", "gap")
    new = unpivoted(after, variables, [row_id])
    return old.where("gap").join(new, [row_id, "variable"]).groupBy("variable").agg(F.count("value").alias("n_filled"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
