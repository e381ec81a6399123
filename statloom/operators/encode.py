"""Codes for categories and factors: levels are counted in one pass, then every code is a projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A column of more levels is not a factor; its levels are not brought to the driver.
MOST_LEVELS = 1000


def levels(df: DataFrame, column: str, order: str | None = None) -> list[tuple[str, int]]:
    """(level, count), most frequent first, ties by the first row in ``order`` (by name without it)."""
    found = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("level")).agg(F.count("*").alias("n"), (F.min(order) if order else F.min(F.lit(0))).alias("first"))
    rows = found.orderBy(F.desc("n"), "first", "level").limit(MOST_LEVELS + 1).collect()
    if len(rows) > MOST_LEVELS:
        raise ValueError(f"{column} has more than {MOST_LEVELS} levels")
    return [(r.level, r.n) for r in rows]


def two_level(column: str, low: str, high: str) -> Column:
    c = F.col(column).cast("string")
    return F.when(c == low, -1.0).when(c == high, 1.0)


def dummies(column: str, names: list[str]) -> dict[str, Column]:
    """0/1 columns <column>_<level>; a null is none of the levels."""
    return {f"{column}_{n}": F.coalesce((F.col(column).cast("string") == n).cast("int"), F.lit(0)) for n in names}


def dummies_but_last(column: str, names: list[str]) -> dict[str, Column]:
    """The same without the last level, which is the reference."""
    return dummies(column, names[:-1])


def coding_table(spark: SparkSession, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """(variable, real_min, real_max, real_center, real_range, coded_min, coded_max): how real values map to -1..1; real_range is half the span."""
    rows = [(v, float(low), float(high), (high + low) / 2, (high - low) / 2, -1.0, 1.0) for v, (low, high) in ranges.items()]
    return spark.createDataFrame(rows, "variable string, real_min double, real_max double, real_center double, real_range double, coded_min double, coded_max double")


def auto_encoded(df: DataFrame, columns: list[str], order: str | None = None, code_numeric: bool = False, references: dict[str, str] | None = None) -> tuple[DataFrame, dict]:
    """Encode columns by their levels and tell how.

    Two levels become -1 and +1 (numbers by size, text by name); text of more levels becomes dummies, appended at the end, without the
    reference level (given, else the most frequent); numbers of more levels stay, or with ``code_numeric`` are put onto
    -1..1; one-level columns stay when ``code_numeric``, else one-level text goes.
    """
    made: dict[str, Column] = {}
    extra: dict[str, Column] = {}
    how: dict[str, dict] = {}
    keep = list(df.columns)
    numbers = [c for c in columns if dict(df.dtypes)[c] != "string"]
    stats = df.agg(*[e for c in numbers for e in (F.min(c), F.max(c), F.count_distinct(c))]).first() if numbers else ()
    for i, c in enumerate(numbers):
        low, high, k = stats[3 * i : 3 * i + 3]
        if k == 2 or (code_numeric and k > 2):
            made[c] = F.lit(2.0) * (F.col(c).cast("double") - float(low)) / F.lit(float(high) - float(low)) - 1
            how[c] = {"type": "numeric", "min": low, "max": high}
    for c in columns:
        if c in numbers:
            continue
        found = levels(df, c, order)
        if len(found) == 2:
            low, high = sorted(x for x, _ in found)
            made[c] = two_level(c, low, high)
            how[c] = {"type": "binary", "low": low, "high": high}
        elif len(found) > 2:
            reference = (references or {}).get(c, found[0][0])
            names = sorted(x for x, _ in found if x != reference)
            extra |= dummies(c, names)
            how[c] = {"type": "dummies", "reference": reference, "levels": names}
            keep.remove(c)
        elif not code_numeric:
            keep.remove(c)
    return df.select(*[made[c].alias(c) if c in made else F.col(c) for c in keep], *[e.alias(n) for n, e in extra.items()]), how


def blocks_by_position(names: list[str], ranges: list[tuple[str, int, int]]) -> list[tuple[str, str]]:
    """(name, block) by 1-based inclusive position ranges, the first that fits; otherwise Unassigned."""
    return [(n, next((b for b, lo, hi in ranges if lo <= i <= hi), "Unassigned")) for i, n in enumerate(names, 1)]
