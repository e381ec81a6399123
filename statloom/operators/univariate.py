"""Descriptive, dispersion and robust statistics, per column, per group and per row. Nulls are skipped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.operators.quantiles import exact_quantiles

QUARTILES = [0.25, 0.5, 0.75]


def geometric_mean(c: str) -> Column:
    """exp(mean(ln x)); null if any value is not positive."""
    return F.when(F.min(c) > 0, F.exp(F.avg(F.when(F.col(c) > 0, F.ln(F.col(c))))))


def rsd(c: str) -> Column:
    return F.try_divide(F.stddev_samp(c), F.abs(F.avg(c))) * 100


def descriptive(c: str) -> dict[str, Column]:
    return {"mean": F.avg(c), "geometric_mean": geometric_mean(c), "n": F.count(c), "n_missing": F.count_if(F.col(c).isNull())}


def dispersion(c: str) -> dict[str, Column]:
    return {"std": F.stddev_samp(c), "variance": F.var_samp(c), "rsd": rsd(c), "min": F.min(c), "max": F.max(c), "range": F.max(c) - F.min(c)}


def robust(df: DataFrame, variables: list[str]) -> DataFrame:
    """Rows (variable, iqr, mad, robust_cv, q1, q3, median): quartiles of all variables at once, then the medians of the distances from the medians."""
    rows, cells = df.count(), unpivoted(df, variables)
    found = exact_quantiles(cells, ["variable"], "value", QUARTILES, rows).collect()  # one row a variable
    quartiles = df.sparkSession.createDataFrame([(r.variable, *r.q) for r in found], "variable string, q1 double, median double, q3 double")
    apart = cells.join(F.broadcast(quartiles), "variable").select("variable", F.abs(F.col("value") - F.col("median")).alias("value"))
    mad = exact_quantiles(apart, ["variable"], "value", [0.5], rows).select("variable", F.col("q")[0].alias("mad"))
    names = df.sparkSession.createDataFrame([(v,) for v in variables], "variable string")
    return names.join(quartiles.join(mad, "variable"), "variable", "left").selectExpr("variable", "q3 - q1 as iqr", "mad", "try_divide(mad, abs(median)) * 100 as robust_cv", "q1", "q3", "median")


def summary(df: DataFrame, variables: list[str]) -> DataFrame:
    """Rows (variable, descriptive and dispersion statistics): one pass for what adds up, one selection for all medians."""
    structs = [F.struct(F.lit(c).alias("variable"), *[e.cast("double" if n not in ("n", "n_missing") else "bigint").alias(n) for n, e in {**descriptive(c), **dispersion(c)}.items()]) for c in variables]
    sums = df.agg(F.array(*structs).alias("r")).select(F.inline("r"))
    medians = exact_quantiles(unpivoted(df, variables), ["variable"], "value", [0.5], df.count()).select("variable", F.col("q")[0].alias("median"))
    joined = sums.join(medians, "variable", "left")
    return joined.select("variable", "mean", "geometric_mean", "median", *[c for c in sums.columns if c not in ("variable", "mean", "geometric_mean")])


def with_quartiles(sums: DataFrame, cells: DataFrame, groups: list[str], value: str, names: tuple[str, str, str], rows: int | None = None) -> DataFrame:
    """Adds the exact quartiles of each group's values to one row a group."""
    found = exact_quantiles(cells, groups, value, QUARTILES, rows).select(*[F.col(g).alias(f"_own{i}") for i, g in enumerate(groups)], *[F.col("q")[i].alias(n) for i, n in enumerate(names)])
    if not groups:
        return sums.withColumn("_one", F.lit(1)).join(found.withColumn("_one", F.lit(1)), "_one", "left").drop("_one")
    return sums.join(found, [sums[g].eqNullSafe(F.col(f"_own{i}")) for i, g in enumerate(groups)], "left").drop(*[f"_own{i}" for i in range(len(groups))])


def by_category(df: DataFrame, variable: str, category: str) -> DataFrame:
    """Count, Mean, Median, Std, Min, Max, Q1, Q3, IQR of each category; rows without a category or value do not count."""
    v = F.col(variable)
    rows = df.where(F.col(category).isNotNull() & v.isNotNull())
    sums = rows.groupBy(category).agg(F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
    both = with_quartiles(sums, rows, [category], variable, ("q1", "median", "q3"))
    return both.select(category, "count", "mean", "median", "std", "min", "max", "q1", "q3", (F.col("q3") - F.col("q1")).alias("iqr"))


def by_batch(df: DataFrame, batch: str, variables: list[str]) -> DataFrame:
    stats = [e for c in variables for e in (F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std"), F.count(c).alias(f"{c}_n"))]
    return df.where(F.col(batch).isNotNull()).groupBy(batch).agg(F.count("*").alias("n_samples"), *stats)


def batch_profile(df: DataFrame, batch: str, value, variables: list[str]) -> DataFrame:
    """Mean, std, min, max, q1, median, q3 of each variable within one batch."""
    cells = unpivoted(df.where(F.col(batch) == value), variables)
    sums = cells.groupBy("variable").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    return with_quartiles(sums, cells, ["variable"], "value", ("q1", "median", "q3"), df.count())


def unpivoted(df: DataFrame, variables: list[str], ids: list[str] | None = None) -> DataFrame:
    return df.select(*(ids or []), *[F.col(c).cast("double").alias(c) for c in variables]).unpivot(ids or [], variables, "variable", "value")


def grand(df: DataFrame, variables: list[str]) -> DataFrame:
    """Mean, median, std (population), min and max over all cells of the block."""
    cells = unpivoted(df, variables)
    sums = cells.agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    median = exact_quantiles(cells, [], "value", [0.5], df.count() * len(variables)).select(F.col("q")[0].alias("median"))
    one = F.lit(1).alias("_one")
    return sums.select("*", one).join(median.select("*", one), "_one", "left").select("mean", "median", "std", "min", "max")


def describe(df: DataFrame, variables: list[str]) -> DataFrame:
    cells = unpivoted(df, variables)
    sums = cells.groupBy("variable").agg(F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    return with_quartiles(sums, cells, ["variable"], "value", ("p25", "p50", "p75"), df.count()).select("variable", "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def value_counts(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """The ``n`` most frequent values, ties by value."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("count")).orderBy(F.desc("count"), column).limit(n)


def missing(df: DataFrame, variables: list[str]) -> DataFrame:
    n = sum((F.count_if(F.col(c).isNull()) for c in variables[1:]), F.count_if(F.col(variables[0]).isNull()))
    return df.agg(n.alias("n_missing"), (F.count("*") * len(variables)).alias("n_total")).withColumn("percent", F.try_divide(F.col("n_missing") * 100.0, F.col("n_total")))


def row_profile(df: DataFrame, row_id: str, variables: list[str]) -> DataFrame:
    """Mean, min, max, sample std, range and missing count across each row's variables."""
    a = F.array(*[F.col(c).cast("double") for c in variables])
    rows = df.select(row_id, F.filter(a, lambda x: x.isNotNull() & ~F.isnan(x)).alias("v"))
    n, total = F.size("v"), F.aggregate("v", F.lit(0.0), lambda s, x: s + x)
    rows = rows.withColumn("mean", F.try_divide(total, n))
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + (x - F.col("mean")) * (x - F.col("mean")))
    return rows.select(
        row_id, "mean", F.array_min("v").alias("min"), F.array_max("v").alias("max"), F.when(n > 1, F.sqrt(square / (n - 1))).alias("std"), (F.array_max("v") - F.array_min("v")).alias("range"), (F.lit(len(variables)) - n).cast("bigint").alias("n_missing")
    )


def is_quantitative(df: DataFrame, column: str) -> bool:
    """Numeric with more than 20 distinct values, or more than half of the values distinct."""
    if dict(df.dtypes)[column] not in ("tinyint", "smallint", "int", "bigint", "float", "double") and not dict(df.dtypes)[column].startswith("decimal"):
        return False
    n, k = df.agg(F.count(column), F.count_distinct(column)).first()
    return bool(n) and (k / n > 0.5 or k > 20)


def column_kinds(df: DataFrame, columns: list[str], threshold: float = 0.05) -> DataFrame:
    """Per column: n, numeric share, distinct values, level type (numeric, binary_cat, multiclass_cat) and whether it reads as categorical."""
    number = lambda c: F.expr(f"try_cast(`{c}` as double)")
    parts = [
        F.struct(F.lit(c).alias("column"), F.count(c).alias("n"), F.count(number(c)).alias("n_numeric"), F.count_distinct(F.col(c).cast("string")).alias("levels"), F.count_distinct(number(c)).alias("numeric_levels")) for c in columns
    ]
    rows = df.agg(F.array(*parts).alias("r")).select(F.inline("r"))
    kind = F.when(F.col("n_numeric") == F.col("n"), "numeric").when(F.col("levels") == 2, "binary_cat").otherwise("multiclass_cat")
    few = (F.col("n_numeric") == 0) | (F.col("n_numeric") < F.col("n") * 0.5) | (F.try_divide(F.col("numeric_levels"), F.col("n")) < threshold)
    return rows.select("column", "n", "n_numeric", "levels", kind.alias("kind"), few.alias("categorical"))
