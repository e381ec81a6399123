"""Transforms of whole columns: one aggregate for the statistics, one projection with them as constants."""

from __future__ import annotations

from math import sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_STATS = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max, "sum": F.sum}


def column_stats(df: DataFrame, variables: list[str], names: tuple[str, ...]) -> dict[str, dict[str, float | None]]:
    """The named statistics of each variable, from one pass; ``length`` is the root of the sum of squares."""
    exprs = [(F.sqrt(F.sum(F.col(c) * F.col(c))) if s == "length" else _STATS[s](c)).cast("double").alias(f"{s}:{i}") for i, c in enumerate(variables) for s in names]
    row = df.agg(*exprs).first()
    return {c: {s: row[f"{s}:{i}"] for s in names} for i, c in enumerate(variables)}


def _apply(df: DataFrame, variables: list[str], names: tuple[str, ...], made) -> DataFrame:
    stats = column_stats(df, variables, names)
    return df.withColumns({c: made(F.col(c).cast("double"), {s: F.lit(v).cast("double") for s, v in stats[c].items()}) for c in variables})


def centered(df: DataFrame, variables: list[str]) -> DataFrame:
    return _apply(df, variables, ("mean",), lambda x, s: x - s["mean"])


def scaled(df: DataFrame, variables: list[str]) -> DataFrame:
    return _apply(df, variables, ("std",), lambda x, s: F.try_divide(x, s["std"]))


def autoscaled(df: DataFrame, variables: list[str]) -> DataFrame:
    return _apply(df, variables, ("mean", "std"), lambda x, s: F.try_divide(x - s["mean"], s["std"]))


def to_unit_range(df: DataFrame, variables: list[str]) -> DataFrame:
    return _apply(df, variables, ("min", "max"), lambda x, s: F.try_divide(x - s["min"], s["max"] - s["min"]))


def to_symmetric_range(df: DataFrame, variables: list[str]) -> DataFrame:
    return _apply(df, variables, ("min", "max"), lambda x, s: F.try_divide(2 * (x - s["min"]), s["max"] - s["min"]) - 1)


def to_max_100(df: DataFrame, variables: list[str]) -> DataFrame:
    return _apply(df, variables, ("max",), lambda x, s: F.try_divide(x, s["max"]) * 100)


def to_sum_100(df: DataFrame, variables: list[str]) -> DataFrame:
    return _apply(df, variables, ("sum",), lambda x, s: F.try_divide(x, s["sum"]) * 100)


def to_length_1(df: DataFrame, variables: list[str]) -> DataFrame:
    return _apply(df, variables, ("length",), lambda x, s: F.try_divide(x, s["length"]))


def log10_shifted(df: DataFrame, variables: list[str]) -> DataFrame:
    """log10; if any selected cell is not positive, |least cell| + 1 is first added to all of them."""
    low = [s["min"] for s in column_stats(df, variables, ("min",)).values() if s["min"] is not None]
    delta = abs(min(low)) + 1 if low and min(low) <= 0 else 0.0
    return df.withColumns({c: F.log10(F.col(c).cast("double") + F.lit(float(delta))) for c in variables})


def block_scaled(df: DataFrame, blocks: dict[str, list[str]]) -> DataFrame:
    """Autoscale each block's variables and divide them by the root of their number; other columns stay."""
    for variables in blocks.values():
        df = autoscaled(df, variables).withColumns({c: F.col(c) / F.lit(sqrt(len(variables))) for c in variables})
    return df


def variance_ratio(before: DataFrame, after: DataFrame, variables: list[str]) -> float | None:
    """Mean column variance after over before a transform."""
    mean = lambda d: d.agg(sum((F.var_samp(c) for c in variables[1:]), F.var_samp(variables[0])) / len(variables)).first()[0]
    a, b = mean(before), mean(after)
    return b / a if a and b is not None else None


TRANSFORMS = {
    "centering": centered, "scaling": scaled, "autoscale": autoscaled, "range_01": to_unit_range, "range_11": to_symmetric_range, "max_100": to_max_100, "sum_100": to_sum_100, "length_1": to_length_1, "log": log10_shifted
}


def code_value(x: Column, low: float, high: float) -> Column:
    """(x - centre) / half range; 0 for a zero range."""
    half = (high - low) / 2
    return (x - F.lit((high + low) / 2)) / F.lit(half) if half else F.lit(0.0)


def decode_value(x: Column, low: float, high: float) -> Column:
    return x * F.lit((high - low) / 2) + F.lit((high + low) / 2)
