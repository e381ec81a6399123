"""Choosing rows and columns: by position, list, constraint, sample; top-k lists."""

from __future__ import annotations

import random
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.dataset import numeric_columns
from statloom.operators.ordered import with_position


def column_range(df: DataFrame, first: int, last: int, numeric_only: bool = True) -> DataFrame:
    """Columns first..last, counted from 1, both included."""
    part = df.select(*df.columns[first - 1 : last])
    return part.select(*numeric_columns(part)) if numeric_only else part


def row_range(df: DataFrame, order: str, first: int, last: int) -> DataFrame:
    """Rows first..last in ascending order, counted from 1, both included."""
    return with_position(df, order, "_pos").where(F.col("_pos").between(first - 1, last - 1)).drop("_pos")


def parse_rows(text: str, n: int) -> list[int]:
    """'1,3-5' as sorted 0-based row numbers below n; an empty list if anything does not parse."""
    found: set[int] = set()
    try:
        for part in text.split(","):
            a, _, b = part.strip().partition("-")
            low, high = int(a), int(b or a)
            found.update(range(max(low, 1) - 1, min(high, n)))
    except ValueError:
        return []
    return sorted(i for i in found if 0 <= i < n)


def row_list(df: DataFrame, order: str, text: str) -> DataFrame:
    wanted = parse_rows(text, df.count())
    return with_position(df, order, "_pos").where(F.col("_pos").isin(wanted) if wanted else F.lit(False)).drop("_pos")


def complete_rows(df: DataFrame, variables: list[str]) -> DataFrame:
    return df.dropna(subset=variables)


def constrained(df: DataFrame, constraints: list[str | Column]) -> DataFrame:
    """Rows for which every constraint holds: SQL text over the columns, or a column."""
    exprs = [F.expr(c) if isinstance(c, str) else c for c in constraints]
    return df.where(reduce(lambda a, b: a & b, exprs)) if exprs else df


def split(df: DataFrame, row_id: str, chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose id is in ``chosen``, and the others."""
    ids = chosen.select(row_id)
    return df.join(ids, row_id, "left_semi"), df.join(ids, row_id, "left_anti")


def mean_differences(selected: DataFrame, rest: DataFrame, variables: list[str]) -> DataFrame:
    """Rows (variable, selected_mean, rest_mean, difference), the largest absolute difference first."""
    means = lambda d, name: d.agg(F.array(*[F.struct(F.lit(c).alias("variable"), F.avg(c).alias(name)) for c in variables]).alias("r")).select(F.inline("r"))
    both = means(selected, "selected_mean").join(means(rest, "rest_mean"), "variable")
    return both.withColumn("difference", F.col("selected_mean") - F.col("rest_mean")).orderBy(F.desc(F.abs("difference")), "variable")


def overall_summary(selected: DataFrame, variables: list[str]) -> DataFrame:
    """One row: rows, mean of the variables' means and of their deviations, least and largest value of all."""
    stats = selected.agg(F.count("*").alias("count"), *[f(c).cast("double").alias(f"{n}{i}") for i, c in enumerate(variables) for n, f in (("m", F.avg), ("s", F.stddev_samp), ("l", F.min), ("h", F.max))])
    of = lambda n: F.array_compact(F.array(*[F.col(f"{n}{i}") for i in range(len(variables))]))
    mean = lambda a: F.try_divide(F.aggregate(a, F.lit(0.0), lambda t, v: t + v), F.size(a))
    return stats.select("count", mean(of("m")).alias("mean"), mean(of("s")).alias("std"), F.array_min(of("l")).alias("min"), F.array_max(of("h")).alias("max"))


def shuffled(df: DataFrame, seed: int) -> DataFrame:
    return df.orderBy(F.rand(seed))


def shuffled_columns(df: DataFrame, seed: int) -> DataFrame:
    names = list(df.columns)
    random.Random(seed).shuffle(names)
    return df.select(*names)


def sampled(df: DataFrame, n: int, seed: int) -> DataFrame:
    """Exactly n rows without replacement."""
    return df.orderBy(F.rand(seed)).limit(n)


def spectral_columns(df: DataFrame, low: float = 200, high: float = 25000) -> tuple[list[str], list[str]]:
    """Numeric columns whose names are numbers within low..high, and all others."""

    def spectral(c: str) -> bool:
        try:
            return low <= float(c) <= high
        except ValueError:
            return False

    found = [c for c in numeric_columns(df) if spectral(c)]
    return found, [c for c in df.columns if c not in found]


def transposed(df: DataFrame, row_id: str, variables: list[str]) -> DataFrame:
    """One row per variable and one column per row id; for few rows, since each becomes a column."""
    return df.select(row_id, *[F.col(c).cast("double").alias(c) for c in variables]).transpose(F.col(row_id)).withColumnRenamed("key", "variable")


def top_by_magnitude(table: DataFrame, value: str, n: int, by: list[str] | None = None, name: str = "variable") -> DataFrame:
    """The n rows of largest absolute value (of each group), ties by name, with their rank from 1."""
    over = f"over ({'partition by ' + ', '.join(by) + ' ' if by else ''}order by abs({value}) desc, {name})"
    if by:
        return table.withColumn("rank", F.expr(f"row_number() {over}")).where(F.col("rank") <= n)
    return table.orderBy(F.desc(F.abs(value)), name).limit(n).withColumn("rank", F.expr(f"row_number() {over}"))
