"""Sums and cross products of many columns in one pass; only p x p numbers reach the driver."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Up to so many columns the cross products are SQL sums; beyond, per-batch matrix products that are then summed.
SQL_COLUMNS = 24


@dataclass
class Moments:
    names: list[str]
    n: int
    mean: np.ndarray
    scatter: np.ndarray  # sum of (x - mean)(x - mean)'

    @property
    def std(self) -> np.ndarray:
        return np.sqrt(np.maximum(np.diag(self.scatter), 0) / (self.n - 1)) if self.n > 1 else np.zeros(len(self.names))

    @property
    def raw(self) -> np.ndarray:
        """Sum of x x'."""
        return self.scatter + self.n * np.outer(self.mean, self.mean)


def moments(df: DataFrame, columns: list[str]) -> Moments:
    """Means and centred cross products over the rows in which all columns are there. Two passes: the means first, so that nothing cancels.

    A sum over n rows loses digits in proportion to what it has reached, so the second pass sums what the first one left: deviations from its
    means and products less its covariances. Such sums stay near 0, and last digits do not depend on n.
    Deviations are summed in two parts, as few distinct values would all be rounded the same way.
    """
    data = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)]).dropna()
    p = len(columns)
    pairs = [(i, j) for i in range(p) for j in range(i, p)] if p <= SQL_COLUMNS else []
    first = data.agg(F.count("*"), *[F.avg(f"c{i}") for i in range(p)], *[F.covar_pop(f"c{i}", f"c{j}") for i, j in pairs]).first()
    n = first[0]
    if not n:
        return Moments(columns, 0, np.zeros(p), np.zeros((p, p)))
    mean = np.array(first[1 : p + 1], float)
    scatter = np.zeros((p, p))
    if p <= SQL_COLUMNS:
        d = [F.col(f"c{i}") - F.lit(float(mean[i])) for i in range(p)]
        rough = [float(v) for v in first[p + 1 :]]
        unit = [2.0 ** (np.frexp(v)[1] // 2 - 24) if 0 < v < np.inf else 1.0 for (i, j), v in zip(pairs, rough) if i == j]
        high = [F.rint(x / F.lit(u)) * F.lit(u) for x, u in zip(d, unit)]
        rest = data.agg(*[F.sum(h) for h in high], *[F.sum(x - h) for x, h in zip(d, high)], *[F.sum(d[i] * d[j] - F.lit(v)) for (i, j), v in zip(pairs, rough)]).first()
        shift = (np.array(rest[:p], float) + np.array(rest[p : 2 * p], float)) / n
        for (i, j), v, left in zip(pairs, rough, rest[2 * p :]):
            scatter[i, j] = scatter[j, i] = n * v + (left - n * shift[i] * shift[j])
    else:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((p + 1, p))  # the last row: sums of deviations
            for b in batches:
                x = np.column_stack([np.asarray(c) for c in b.columns]) - mean if b.num_rows else np.zeros((0, p))
                total += np.column_stack([x, np.ones(len(x))]).T @ x
            yield pa.RecordBatch.from_arrays([pa.array(range(p + 1)), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "row"])

        parts = data.mapInArrow(run, "i bigint, row array<double>").groupBy("i").agg(F.array(*[F.sum(F.col("row")[j]) for j in range(p)]).alias("row"))
        found = {r.i: np.array(r.row) for r in parts.collect()}
        shift = found.pop(p) / n
        for i, row in found.items():
            scatter[i] = row - n * shift[i] * shift
    return Moments(columns, n, mean + shift, scatter)
