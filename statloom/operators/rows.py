"""Transforms along a row's ordered variables, held as one array<double> column."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_array(df: DataFrame, variables: list[str], name: str = "spectrum") -> DataFrame:
    return df.withColumn(name, F.array(*[F.col(c).cast("double") for c in variables]))


def _mean(a: Column) -> Column:
    seen = F.filter(a, lambda x: x.isNotNull())
    return F.try_divide(F.aggregate(seen, F.lit(0.0), lambda s, x: s + x), F.size(seen))


def _with(one: Column, then) -> Column:
    """``then`` of the only element of an array, which is computed once and not for each element that ``then`` visits."""
    return F.transform(one, then)[0]


def snv(a: Column) -> Column:
    """(x - row mean) / row sample deviation; nulls are skipped and stay; a constant row becomes null."""
    seen = F.filter(a, lambda x: x.isNotNull())
    state = F.aggregate(seen, F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("m"), F.lit(0.0).alias("s")), lambda t, x: F.struct((t["n"] + 1).alias("n"), (t["m"] + (x - t["m"]) / (t["n"] + 1)).alias("m"), (t["s"] + (x - t["m"]) * (x - t["m"]) * t["n"] / (t["n"] + 1)).alias("s")))
    found = F.transform(F.array(state), lambda t: F.struct(t["m"].alias("m"), F.sqrt(F.try_divide(t["s"], t["n"] - 1)).alias("sd")))
    return _with(found, lambda t: F.transform(a, lambda x: F.try_divide(x - t["m"], t["sd"])))


def first_derivative(a: Column) -> Column:
    """Differences of neighbours; one element shorter."""
    n = F.size(a)
    return F.when(n > 1, F.zip_with(F.slice(a, 2, F.greatest(n - 1, F.lit(0))), F.slice(a, 1, F.greatest(n - 1, F.lit(0))), lambda x, y: x - y)).otherwise(F.array().cast("array<double>"))


def second_derivative(a: Column) -> Column:
    return first_derivative(first_derivative(a))


def moving_average(a: Column, window: int) -> Column:
    """Means of ``window`` neighbours; window - 1 elements shorter; null where the window has a null."""
    return F.when(F.size(a) >= window, F.transform(F.sequence(F.lit(1), F.size(a) - (window - 1)), lambda i: F.aggregate(F.slice(a, i, F.lit(window)), F.lit(0.0), lambda s, x: s + x) / window)).otherwise(F.array().cast("array<double>"))


def sum_100(a: Column) -> Column:
    total = F.aggregate(F.filter(a, lambda x: x.isNotNull()), F.lit(0.0), lambda s, x: s + x)
    return _with(F.array(total), lambda t: F.transform(a, lambda x: F.try_divide(x, t) * 100))


def binned(a: Column, width: int) -> Column:
    """Means of ``width`` adjacent elements; nulls are skipped. Raises where the bins do not take up all elements."""
    uneven = F.raise_error(F.concat(F.size(a).cast("string"), F.lit(f" variables do not divide into bins of {width}"))).cast("array<double>")
    return F.when(F.size(a) % width != 0, uneven).otherwise(_bins(a, width))


def _bins(a: Column, width: int) -> Column:
    return F.transform(F.sequence(F.lit(0), (F.size(a) / width).cast("int") - 1), lambda i: _mean(F.slice(a, i * width + 1, F.lit(width))))


def bin_headers(names: list[str], width: int) -> list[str]:
    """Centre of each bin for numeric names, else first-last."""
    if len(names) % width:
        raise ValueError(f"{len(names)} variables do not divide into bins of {width}")
    out = []
    for i in range(0, len(names), width):
        part = names[i : i + width]
        try:
            out.append(str(sum(map(float, part)) / width))
        except ValueError:
            out.append(f"{part[0]}-{part[-1]}")
    return out


def savgol_matrix(p: int, window: int, degree: int, deriv: int = 0) -> np.ndarray:
    """The p x p linear operator of a Savitzky-Golay filter with unit spacing; the ends take the polynomial of the first and last window."""
    if window % 2 == 0 or window > p or degree >= window:
        raise ValueError("window must be odd, at most the number of variables, and above the degree")
    half, out = window // 2, np.zeros((p, p))
    for j in range(p):
        start = min(max(j - half, 0), p - window)
        at = np.arange(window) - half
        powers = np.linalg.pinv(np.vander(at, degree + 1, increasing=True))
        x = j - start - half
        basis = np.zeros(degree + 1)
        for k in range(deriv, degree + 1):
            factor = np.prod(np.arange(k, k - deriv, -1)) if deriv else 1.0
            basis[k] = factor * float(x) ** (k - deriv)
        out[j, start : start + window] = basis @ powers
    return out


def savgol(a: Column, p: int, window: int, degree: int, deriv: int = 0) -> Column:
    """Savitzky-Golay filter of arrays of ``p`` elements: each output is a short dot product with its row of the operator."""
    m, half = savgol_matrix(p, window, degree, deriv), window // 2
    dots = []
    for j in range(p):
        start = min(max(j - half, 0), p - window)
        weights = F.array(*[F.lit(float(w)) for w in m[j, start : start + window]])
        dots.append(F.struct(F.lit(start + 1).alias("at"), weights.alias("w")))
    return F.transform(F.array(*dots), lambda d: F.aggregate(F.zip_with(F.slice(a, d["at"], F.lit(window)), d["w"], lambda x, w: x * w), F.lit(0.0), lambda s, x: s + x))


def profiles(df: DataFrame, row_id: str, array: str) -> DataFrame:
    """One row per cell: (row_id, position, value)."""
    return df.select(row_id, F.posexplode(array).alias("position", "value"))
