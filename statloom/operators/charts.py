"""The tables behind charts: bins, densities, boxes, quantile pairs, residual and coefficient tables."""

from __future__ import annotations

from math import factorial, pi, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.functions import scalars
from statloom.operators.bivariate import correlation
from statloom.operators.encode import levels
from statloom.operators.monitor import Monitor, faults
from statloom.operators.ordered import running_sum, with_position
from statloom.operators.select import sampled
from statloom.operators.univariate import unpivoted, with_quartiles


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """(bin, low, high, count) of equal bins between the least and greatest value, both included; empty bins are left out."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    if low is None:
        return df.sparkSession.createDataFrame([], "bin int, low double, high double, count bigint")
    width = (float(high) - float(low)) / bins or 1.0
    at = F.least(F.floor((F.col(column) - float(low)) / width), F.lit(bins - 1)).cast("int")
    return df.where(F.col(column).isNotNull()).groupBy(at.alias("bin")).agg(F.count("*").alias("count")).select("bin", (F.col("bin") * width + float(low)).alias("low"), ((F.col("bin") + 1) * width + float(low)).alias("high"), "count")


#: Cells of a bandwidth, terms of each cell's series and bandwidths beyond which a cell adds nothing.
CELLS, TERMS, REACH = 4, 10, 9


def density(df: DataFrame, column: str, category: str | None = None, points: int = 200) -> DataFrame:
    """Gaussian kernel density, of each category if one is given, at ``points`` places from min - sd to max + sd (population), bandwidth sd * n^(-1/5).

    Values are gathered in cells of a quarter of a bandwidth, each with its first TERMS power sums about the cell's centre. With d a value's distance from there
    and y a place's, in bandwidths, exp(-(y - d)^2 / 2) is the sum of d^k / k! He_k(y) exp(-y^2 / 2). As |He_k(y)| exp(-y^2 / 4) < 1.09 sqrt(k!) and
    |d| <= 1/8, what is left out of a value's kernel is less than 1e-12, and beyond REACH bandwidths the kernel is less than 1e-17.
    So rows are summed where they are read, and cells meet only the places near them. Null or NaN values and null categories do not count; a constant has no density.
    """
    v = F.col(column).cast("double")
    rows = df.select((F.col(category).cast("string") if category else F.lit("")).alias("category"), v.alias("v")).where("category is not null and v is not null and not isnan(v)")
    stats = rows.groupBy("category").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.stddev_pop("v").alias("sd"), (F.stddev_samp("v") * F.pow(F.count("*"), F.lit(-0.2))).alias("h")).where("sd > 0")
    stats = stats.withColumn("step", (F.col("hi") - F.col("lo") + 2 * F.col("sd")) / (points - 1))
    placed = rows.join(stats.select("category", "lo", "h"), "category").select("category", F.round((F.col("v") - F.col("lo")) / F.col("h") * CELLS).alias("cell"), ((F.col("v") - F.col("lo")) / F.col("h")).alias("u"))
    d = F.col("u") - F.col("cell") / CELLS
    sums = [F.count("*").cast("double").alias("m0")]
    power = d
    for k in range(1, TERMS):
        sums.append((F.sum(power) / float(factorial(k))).alias(f"m{k}"))
        power = power * d
    cells = placed.groupBy("category", "cell").agg(*sums).join(stats, "category")
    #: A place x lies at (x - lo) / h - cell / CELLS bandwidths from the centre.
    centre, first = F.col("lo") + F.col("cell") / CELLS * F.col("h"), F.col("lo") - F.col("sd")
    low = F.greatest(F.lit(0), F.ceil((centre - REACH * F.col("h") - first) / F.col("step")))
    high = F.least(F.lit(points - 1), F.floor((centre + REACH * F.col("h") - first) / F.col("step")))
    near = cells.where(low <= high).withColumn("point", F.explode(F.sequence(low, high)))
    x = first + F.col("point") * F.col("step")
    near = near.withColumn("y", (x - centre) / F.col("h"))
    before, now, series = F.lit(1.0), F.col("y"), F.col("m0") + F.col("m1") * F.col("y")
    for k in range(2, TERMS):  # He_k(y) = y He_(k-1)(y) - (k - 1) He_(k-2)(y)
        near = near.withColumns({f"h{k}": F.col("y") * now - (k - 1) * before})
        before, now = now, F.col(f"h{k}")
        series = series + F.col(f"m{k}") * now
    sums = near.groupBy("category", "point").agg(F.sum(series * F.exp(-F.col("y") * F.col("y") / 2)).alias("total"))
    grid = stats.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(points - 1).cast("bigint"))).alias("point"))
    found = grid.join(sums, ["category", "point"], "left")
    return found.select("category", F.col("point").cast("int").alias("point"), (first + F.col("point") * F.col("step")).alias("x"), (F.coalesce("total", F.lit(0.0)) / (F.col("n") * F.col("h") * sqrt(2 * pi))).alias("density"))


def box(df: DataFrame, column: str) -> DataFrame:
    sums = df.agg(F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.min(column).alias("min"), F.max(column).alias("max"))
    return with_quartiles(sums, df, [], column, ("q1", "median", "q3")).select("q1", "median", "q3", "mean", "std", "min", "max")


def strip(df: DataFrame, column: str, seed: int = 1) -> DataFrame:
    return df.where(F.col(column).isNotNull()).select(F.col(column).alias("value"), (F.randn(seed) * 0.04).alias("jitter"))


#: Coefficients of algorithm AS 241 (PPND16), highest power first: numerator and denominator near the middle, and in the tails up to and beyond r = 5.
_AS241 = (
    ((2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457, 13731.693765509461125, 1971.5909503065514427, 133.14166789178437745, 3.387132872796366608), (5226.495278852854561, 28729.085735721942674, 39307.89580009271061, 21213.794301586595867, 5394.1960214247511077, 687.1870074920579083, 42.313330701600911252, 1.0)),
    ((7.7454501427834140764e-4, 0.0227238449892691845833, 0.24178072517745061177, 1.27045825245236838258, 3.64784832476320460504, 5.7694972214606914055, 4.6303378461565452959, 1.42343711074968357734), (1.05075007164441684324e-9, 5.475938084995344946e-4, 0.0151986665636164571966, 0.14810397642748007459, 0.68976733498510000455, 1.6763848301838038494, 2.05319162663775882187, 1.0)),
    ((2.01033439929228813265e-7, 2.71155556874348757815e-5, 0.0012426609473880784386, 0.026532189526576123093, 0.29656057182850489123, 1.7848265399172913358, 5.4637849111641143699, 6.6579046435011037772), (2.04426310338993978564e-15, 1.4215117583164458887e-7, 1.8463183175100546818e-5, 7.868691311456132591e-4, 0.0148753612908506148525, 0.13692988092273580531, 0.59983220655588793769, 1.0)),
)


def normal_quantile_column(p: Column) -> Column:
    """Quantile of the normal law by Wichura's algorithm AS 241, to about 16 digits."""

    def ratio(x: Column, which: int) -> Column:
        top, bottom = (F.lit(c[0]) for c in _AS241[which])
        for a, b in zip(*(c[1:] for c in _AS241[which])):
            top, bottom = top * x + a, bottom * x + b
        return top / bottom

    q, r = p - 0.5, F.sqrt(-F.ln(F.least(p, 1 - p)))
    tail = F.when(r <= 5, ratio(r - 1.6, 1)).otherwise(ratio(r - 5, 2))
    return F.when(F.abs(q) <= 0.425, q * ratio(0.180625 - q * q, 0)).when(q < 0, -tail).otherwise(tail)


def quantile_pairs(df: DataFrame, column: str) -> DataFrame:
    """(position, p, theoretical, observed): the sorted sample against normal quantiles at evenly spaced p from 0.01 to 0.99."""
    values = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("observed")).agg(F.count("*").alias("k"))
    upto = running_sum(values, "observed", "k", "upto")
    placed = upto.select("observed", F.explode(F.sequence(F.col("upto") - F.col("k"), F.col("upto") - 1)).alias("position"))
    n = df.where(F.col(column).isNotNull()).count()
    placed = placed.withColumn("p", 0.01 + F.col("position") * (0.98 / max(n - 1, 1)))
    return placed.select("position", "p", normal_quantile_column(F.col("p")).alias("theoretical"), "observed")


def scaled_colour(df: DataFrame, column: str) -> DataFrame:
    """Adds shade: the column on 0..1 by its range, 0.5 where it is flat."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    return df.withColumn("shade", F.lit(0.5) if low is None or low == high else (F.col(column) - float(low)) / float(high - low))


def fitted_vs_observed(diagnostics: DataFrame) -> DataFrame:
    """Correlations and spreads of a regression's diagnostics: r of fitted and of left-out predictions (null if constant), population sd and largest |residual|."""
    return diagnostics.agg(correlation("observed", "fitted").alias("r_fitted"), correlation("observed", "cv_predicted").alias("r_cv"), F.stddev_pop("residual").alias("residual_sd"), F.max(F.abs("residual")).alias("largest_residual"))


def high_leverage(diagnostics: DataFrame, n: int, terms: int, multi: bool = False) -> DataFrame:
    """Rows whose leverage exceeds 2p/n (2(p + 1)/n for several responses)."""
    return diagnostics.where(F.col("leverage") > 2.0 * (terms + multi) / n)


def axis_range(df: DataFrame, columns: list[str], margin: float = 0.05) -> DataFrame:
    cells = [F.struct(F.lit(c).alias("variable"), (F.min(c) - (F.max(c) - F.min(c)) * margin).cast("double").alias("low"), (F.max(c) + (F.max(c) - F.min(c)) * margin).cast("double").alias("high")) for c in columns]
    return df.agg(F.array(*cells).alias("r")).select(F.inline("r"))


def category_colours(df: DataFrame, column: str) -> DataFrame:
    """(category, colour): levels in sorted order with their colours; nulls are no level."""
    found = [(v, i) for i, v in enumerate(sorted(v for v, _ in levels(df, column)))]
    return df.sparkSession.createDataFrame(found, "category string, _rank int").select("category", scalars.category_colour(F.col("_rank")).alias("colour"))


def trajectory_style(path: DataFrame, n: int) -> DataFrame:
    """Adds colour, width and size to rows with a position from 0: blue to red and growing up to the last segment; the last point is red of size 6."""
    u = F.least(F.col("position") / max(1, n - 2), F.lit(1.0))
    last = F.col("position") >= n - 1
    rgb = F.format_string("rgb(%d,0,%d)", F.floor(u * 255), F.floor((1 - u) * 255))
    return path.withColumns({"colour": F.when(last, "rgb(255,0,0)").otherwise(rgb), "width": F.when(~last | F.lit(n == 1), 1.5 + u * 1.5), "size": F.when(last, 6.0).otherwise(3 + u * 3)})


def shaded_profiles(df: DataFrame, row_id: str, variables: list[str], colour: str | None = None, notes: list[str] | None = None) -> DataFrame:
    """(row_id, variable, value, shade or category, text): profiles with the colour column on 0..1 if it is a number, else as a category; ``notes`` as text."""
    kept = dict.fromkeys([row_id, *(notes or []), *([colour] if colour else [])])
    rows = df.select(*kept, *[c for c in variables if c not in kept])
    numeric = {f for f, t in rows.dtypes if t in ("double", "float", "int", "bigint", "smallint", "tinyint") or t.startswith("decimal")}
    if colour:
        rows = scaled_colour(rows, colour) if colour in numeric else rows.withColumn("category", F.coalesce(F.col(colour).cast("string"), F.lit("Unknown")))
    if notes:
        rows = rows.withColumn("text", scalars.metadata_text(notes, numeric))
    added = [c for c in ("shade", "category", "text") if c in rows.columns and c not in kept]
    return unpivoted(rows, variables, [row_id, *added])


def contribution_bars(table: DataFrame) -> DataFrame:
    """Adds colour: red where the magnitude of the contribution exceeds 1, else blue."""
    return table.withColumn("colour", F.when(F.abs("contribution") > 1, "red").otherwise("blue"))


def correlation_scatter(train: DataFrame, rows: DataFrame, x: str, y: str, n: int = 1000, seed: int = 42) -> DataFrame:
    """(x, y, highlighted): a random cloud of n training rows (the feature) and all of ``rows``."""
    cloud = sampled(train.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")), n, seed)
    return cloud.withColumn("highlighted", F.lit(False)).unionByName(rows.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.lit(True).alias("highlighted")))


def scatter_points(df: DataFrame, x: str, y: str, colour: str, most_levels: int = 20) -> DataFrame:
    """Rows with both numbers, with x, y, colour and whether the colour is a category: text, or at most ``most_levels`` values."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("x"), F.col(y).alias("y"), F.col(colour).alias("colour"))
    text = dict(rows.dtypes)["colour"] in ("string", "boolean")
    few = text or rows.select("colour").distinct().limit(most_levels + 2).where("colour is not null").count() <= most_levels
    return rows.withColumn("categorical", F.lit(few))


def pair_ranges(df: DataFrame, variables: list[str]) -> DataFrame:
    """Axis ranges, 5 % wider on both sides, over rows complete in all variables."""
    return axis_range(df.dropna(subset=variables), variables)


def residuals_by_order(diagnostics: DataFrame, order: str) -> DataFrame:
    """(order, position from 1, residual, low, high, largest): residuals in run order with one population deviation about 0 and the largest magnitude."""
    sd, largest = diagnostics.agg(F.stddev_pop("residual"), F.max(F.abs("residual"))).first()
    lines = {n: F.lit(v).cast("double") for n, v in (("low", None if sd is None else -sd), ("high", sd), ("largest", largest))}
    return with_position(diagnostics.select(order, "residual"), order).select(order, (F.col("position") + 1).alias("position"), "residual", *[e.alias(n) for n, e in lines.items()])


def control_series(df: DataFrame, monitor: Monitor, order: str, base: str | None = None, start: int = 1) -> DataFrame:
    """(order, sample, t2, q, fault, and a column for each limit): statistics in row order, numbered from ``start``; with ``base`` a time, one second a row."""
    placed = with_position(faults(df, monitor, [order]), order).withColumn("sample", F.col("position") + start)
    limits = {f"{n}_limit_{i}": F.lit(float(v)) for n, of in (("t2", monitor.t2_limits), ("q", monitor.q_limits)) for i, v in enumerate(of, 1)}
    out = placed.select(order, "sample", "position", "t2", "q", "fault").withColumns(limits)
    return (out.withColumn("time", scalars.timestamps(F.col("position"), base)) if base else out).drop("position")
