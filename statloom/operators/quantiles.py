"""Exact quantiles of many groups by selection, without sorting their values.

One pass brackets every asked rank between two values of an approximate summary, whose error is bounded. A second pass counts: rows
outside the brackets by the gap that they lie in, rows inside by their value, so ties are one number. The running counts of what is
left, a bounded share of the rows, give each rank's value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Groups of at most WHOLE rows are counted by value from end to end. Larger ones have about INSIDE rows in all their brackets, while the summary's accuracy allows it.
WHOLE, INSIDE = 40_000, 2_000_000
ACCURACY, MOST_ACCURACY = 10_000, 4_000_000
#: Groups whose brackets are sent to all tasks; with more they meet the values by a shuffled join.
SENT_GROUPS = 100_000


def brackets(cells: DataFrame, groups: list[str], value: str, shares: list[float], accuracy: int) -> DataFrame:
    """Rows (groups, n, low, high): for each share values between which its quantile lies.

    The summary is wrong by n / accuracy ranks at most; shares are moved by twice that, which is 4 ranks or more where n is above WHOLE.
    """
    at = [min(1.0, max(0.0, p + d / accuracy)) for d in (-2, 2) for p in shares]
    made = cells.groupBy(*groups).agg(F.count(value).alias("n"), F.min(value).alias("_min"), F.max(value).alias("_max"), F.percentile_approx(value, at, accuracy).alias("_a"))
    k, few = len(shares), F.col("n") <= WHOLE * accuracy // ACCURACY
    pick = lambda end, first: F.when(few, F.array(*[F.col(end)] * k)).otherwise(F.slice("_a", first, k))
    return made.select(*groups, "n", pick("_min", 1).alias("low"), pick("_max", k + 1).alias("high"))


def counted(cells: DataFrame, groups: list[str], value: str, shares: list[float], accuracy: int) -> DataFrame:
    """Rows (groups, n, _k, _gap, _c): how many rows have the value _k, or lie in the gap above _k where _gap is true."""
    found = brackets(cells, groups, value, shares, accuracy)
    some = found.limit(SENT_GROUPS + 1).collect()
    if len(some) <= SENT_GROUPS:
        found = F.broadcast(cells.sparkSession.createDataFrame(some, found.schema))
    found = found.withColumnsRenamed({g: f"_own{i}" for i, g in enumerate(groups)})
    both = cells.join(found, on=[F.col(g).eqNullSafe(F.col(f"_own{i}")) for i, g in enumerate(groups)])
    v = F.col(value)
    inside, below = F.lit(False), []
    for i in range(len(shares)):
        low, high = F.col("low")[i], F.col("high")[i]
        inside = inside | v.between(low, high)
        below.append(F.when(v > high, high))
    rows = both.select(*groups, "n", F.when(inside, v).otherwise(F.greatest(*below) if len(below) > 1 else below[0]).alias("_k"), (~inside).alias("_gap"))
    return rows.groupBy(*groups, "n", "_k", "_gap").agg(F.count("*").alias("_c"))


def exact_quantiles(cells: DataFrame, groups: list[str], value: str, shares: list[float], rows: int | None = None, places: list[int] | None = None) -> DataFrame:
    """Rows (groups, q): q has the exact quantile of each share, between two values in proportion to their distance.

    With ``places`` the value at each 0-based place is taken, of which the share tells about where it is. Nulls do not count, a null group is
    a group, a group without values gives no row. ``rows`` is an upper bound of a group's rows, where the caller
    knows one; else they are counted. Two passes over the values; what is sorted is bounded by INSIDE or WHOLE distinct values a group.
    """
    cells = cells.select(*groups, F.col(value).cast("double").alias(value)).where(F.col(value).isNotNull())
    keys = groups
    if not groups:
        keys, cells = ["_all"], cells.withColumn("_all", F.lit(0))
    rows = cells.count() if rows is None else rows
    accuracy = min(MOST_ACCURACY, max(ACCURACY, 4 * len(shares) * rows // INSIDE))
    sums = counted(cells, keys, value, shares, accuracy)
    upto = F.sum("_c").over(Window.partitionBy(*keys).orderBy(F.col("_k").asc_nulls_first(), "_gap"))
    sums = sums.withColumn("_upto", upto)

    def rank(r: Column) -> Column:  # the value of the r-th row, from 1
        return F.min(F.when(~F.col("_gap") & (F.col("_upto") >= r), F.col("_k")))

    def missed(r: Column) -> Column:
        return F.max(F.col("_gap") & (F.col("_upto") >= r) & (F.col("_upto") - F.col("_c") < r))

    out, wrong = [], F.lit(False)
    for i, p in enumerate(shares):
        place = F.lit(float(places[i])) if places else (F.col("n") - 1) * F.lit(float(p))
        first = F.floor(place)
        a, b, part = rank(first + 1), rank(F.least(first + 2, F.col("n"))), F.first(place - first)
        out.append(F.when((a == b) | (part == 0), a).otherwise(a + (b - a) * part))
        wrong = wrong | missed(first + 1) | missed(F.least(first + 2, F.col("n")))
    made = sums.groupBy(*keys).agg(F.array(*out).alias("q"), wrong.alias("_wrong"))
    return made.select(*groups, F.when(F.col("_wrong"), F.raise_error(F.lit("a rank lies outside its bracket"))).otherwise(F.col("q")).alias("q"))


def exact_quantile(df: DataFrame, value: str, share: float) -> float | None:
    """One quantile of one column; null if it has no values."""
    row = exact_quantiles(df, [], value, [share]).first()
    return None if row is None else row.q[0]
