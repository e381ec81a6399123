"""Designed experiments: candidate points, screening and composite designs, coding and classification of points."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: First rows of the cyclic Plackett-Burman designs, from which the others follow by rotation.
PLACKETT_BURMAN = {8: "+--+-++", 12: "++-+++---+-", 16: "++++-+-++--+---"}


def full_factorial(spark: SparkSession, levels: dict[str, list]) -> DataFrame:
    """All combinations of the factors' levels, the last factor fastest, with run numbers from 1: decoded from a range, so no join is needed."""
    size = [len(v) for v in levels.values()]
    total = int(np.prod(size)) if size else 0
    runs, columns, step = spark.range(total), [], total
    for (name, values), k in zip(levels.items(), size):
        step //= k
        kind = "double" if all(isinstance(v, int | float) for v in values) else "string"
        column = F.array(*[F.lit(v).cast(kind) for v in values])
        columns.append(F.get(column, (F.floor(F.col("id") / step) % k).cast("int")).alias(name))
    return runs.select((F.col("id") + 1).alias("run"), *columns)


def factorial_of(df: DataFrame, factors: list[str]) -> DataFrame:
    """All combinations of the levels that a table's columns have, in their order, the last factor fastest, with run numbers from 1; nulls are no level.

    Each run's number tells its level of each factor; levels come by joins on their places, so the runs are never crossed.
    """
    levels, size = [], []
    for i, f in enumerate(factors):
        found = df.select(F.col(f).alias(f)).where(F.col(f).isNotNull()).distinct()
        placed = found.withColumn(f"_p{i}", F.row_number().over(Window.orderBy(f)) - 1)  # one row a level
        levels.append(placed)
        size.append(placed.count())
    total = int(np.prod(size)) if size else 0
    runs, step = df.sparkSession.range(total), total
    for i, k in enumerate(size):
        step //= max(k, 1)
        runs = runs.withColumn(f"_p{i}", (F.floor(F.col("id") / step) % k).cast("int")).join(levels[i], f"_p{i}")
    return runs.select((F.col("id") + 1).alias("run"), *factors)


def over_groups(design: DataFrame, x: list[str], rows: DataFrame, by: list[str], factors: list[str]) -> DataFrame:
    """(by..., run, factors...): a design of coded points for every group of a table, each coordinate put onto the group's own range of its factor.

    The design's runs, small by construction, go along as a literal, so each group spreads where it is. A group without a value of a factor has nulls there.
    """
    runs = [(r[0], *map(float, r[1:])) for r in design.select("run", *x).collect()]
    points = F.array(*[F.struct(F.lit(r[0]).cast("bigint").alias("run"), *[F.lit(v).alias(f"_x{i}") for i, v in enumerate(r[1:])]) for r in runs])
    ranges = rows.groupBy(*by).agg(*[f(c).cast("double").alias(f"_{n}{i}") for i, c in enumerate(factors) for n, f in (("l", F.min), ("h", F.max))])
    spread = ranges.select(*by, *[f"_{n}{i}" for i in range(len(factors)) for n in "lh"], F.explode(points).alias("_p"))
    return spread.select(*by, "_p.run", *[(F.col(f"_l{i}") + (F.col("_p")[f"_x{i}"] + 1) * (F.col(f"_h{i}") - F.col(f"_l{i}")) / 2).alias(c) for i, c in enumerate(factors)])


def linspace_grid(spark: SparkSession, ranges: dict[str, tuple[float, float, int]]) -> DataFrame:
    """A grid of evenly spaced points (low, high, number) for each factor; the points come from whole numbers, so none is lost to rounding."""
    size = [n for _, _, n in ranges.values()]
    total, columns = int(np.prod(size)), []
    step = total
    for name, (low, high, n) in ranges.items():
        step //= n
        at = F.floor(F.col("id") / step) % n
        columns.append((F.lit(float(low)) + at * ((high - low) / max(n - 1, 1))).alias(name))
    return spark.range(total).select("id", *columns)


def _runs(spark: SparkSession, rows: list[list[float]], names: list[str], replicates: int = 0) -> DataFrame:
    rows = rows * (replicates + 1)
    return spark.createDataFrame([(i + 1, *map(float, r)) for i, r in enumerate(rows)], "run bigint, " + ", ".join(f"`{n}` double" for n in names))


def plackett_burman(spark: SparkSession, k: int, replicates: int = 0) -> DataFrame:
    """Screening design of k two-level factors in 8, 12 or 16 runs; more factors get the full factorial."""
    names, n = [f"x{i + 1}" for i in range(k)], max(8, 4 * -(-(k + 1) // 4))
    if n not in PLACKETT_BURMAN:
        return full_factorial(spark, {x: [-1.0, 1.0] for x in names})
    first = [1 if c == "+" else -1 for c in PLACKETT_BURMAN[n]]
    rows = [[first[(j - i) % (n - 1)] for j in range(n - 1)] for i in range(n - 1)] + [[-1] * (n - 1)]
    return _runs(spark, [r[:k] for r in rows], names, replicates)


def fractional_factorial(spark: SparkSession, k: int, replicates: int = 0) -> DataFrame:
    """Half fractions: 2^(4-1) with D = ABC, 2^(5-1) with E = ABCD."""
    if k not in (4, 5):
        raise ValueError("half fractions are given for 4 and 5 factors")
    base = [[1 if i >> b & 1 else -1 for b in range(k - 1)] for i in range(2 ** (k - 1))]
    return _runs(spark, [[*r, int(np.prod(r))] for r in base], [f"x{i + 1}" for i in range(k)], replicates)


def axial_distance(k: int, alpha: str | float, centres: int | None = None) -> float:
    nf = 2**k
    if alpha == "orthogonal":
        return float(np.sqrt((np.sqrt(nf * (nf + 2)) - nf) / 2))
    return float(nf**0.25) if alpha == "rotatable" else 1.0 if alpha == "face" else float(alpha)


def central_composite(spark: SparkSession, k: int, alpha: str | float = "orthogonal") -> DataFrame:
    """Corners, axial points at ``alpha`` (orthogonal, rotatable, face or a number) and max(3, k) centre runs."""
    a, names = axial_distance(k, alpha), [f"x{i + 1}" for i in range(k)]
    corners = [[1 if i >> (k - 1 - b) & 1 else -1 for b in range(k)] for i in range(2**k)]
    axial = [[s * a if j == i else 0 for j in range(k)] for i in range(k) for s in (1, -1)]
    return _runs(spark, corners + axial + [[0] * k] * max(3, k), names)


def coded(design: DataFrame, ranges: dict[str, tuple[float, float]], digits: int | None = 3) -> DataFrame:
    """Real values onto -1..1 by each factor's range."""
    made = {n: 2 * (F.col(n).cast("double") - low) / (high - low) - 1 for n, (low, high) in ranges.items()}
    return design.withColumns({n: F.round(e, digits) if digits is not None else e for n, e in made.items()})


def decoded(design: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    return design.withColumns({n: low + (F.col(n) + 1) * (high - low) / 2 for n, (low, high) in ranges.items()})


def classified(design: DataFrame, x: list[str], tolerance: float = 0.1, real: bool = False) -> DataFrame:
    """Adds point_type: center, corner, axial (one coordinate at -1 or 1, the others 0), edge (some at -1 or 1, some at 0) or interior.

    ``real``: the coordinates are first coded onto -1..1 by each one's range in the design; one of a single value is taken as it is.
    """
    if real:
        ends = design.agg(*[f(c).cast("double") for c in x for f in (F.min, F.max)]).first()
        ranges = {c: (ends[2 * i], ends[2 * i + 1]) for i, c in enumerate(x) if ends[2 * i] is not None and ends[2 * i] != ends[2 * i + 1]}
        copy = design.withColumns({f"_{c}": F.col(c) for c in x})
        return classified(coded(copy, ranges, None), x, tolerance).withColumns({c: F.col(f"_{c}") for c in x}).drop(*[f"_{c}" for c in x])
    near = lambda c, v: (F.abs(F.abs(F.col(c)) - v) <= tolerance).cast("int")
    ones, zeros = (reduce(lambda a, b: a + b, [near(c, v) for c in x]) for v in (1.0, 0.0))
    p = len(x)
    kind = F.when(zeros == p, "center").when(ones == p, "corner").when((ones == 1) & (zeros == p - 1), "axial").when((ones > 0) & (zeros > 0), "edge").otherwise("interior")
    return design.withColumn("point_type", kind)


def parse_levels(text: str) -> tuple[list, bool]:
    """Comma-separated levels, as numbers if all are, and whether they are."""
    parts = [p.strip() for p in text.split(",") if p.strip()]
    try:
        return [float(p) for p in parts], True
    except ValueError:
        return parts, False


def is_numeric_list(text: Column) -> Column:
    """Whether every comma-separated item is a number."""
    return F.forall(F.split(text, ","), lambda x: F.trim(x).rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"))


def validated(design: str, factors: dict[str, list]) -> list[str]:
    """What speaks against a kind of design for these factors' levels; nothing if it fits."""
    issues = []
    for name, levels in factors.items():
        numeric = all(isinstance(v, int | float) for v in levels)
        if design in ("plackett_burman", "fractional_factorial", "two_level") and len(levels) != 2:
            issues.append(f"{name} needs 2 levels")
        if design == "central_composite" and not numeric:
            issues.append(f"{name} must be quantitative")
        if design == "three_level" and len(levels) != 3:
            issues.append(f"{name} needs 3 levels")
    return issues
