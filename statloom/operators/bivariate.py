"""Correlation, covariance and their p-values; hulls and ranges for charts."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from itertools import combinations
from math import ceil, erfc, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from statloom.functions.dist import chi2_quantile, correlation_p
from statloom.operators.gram import moments
from statloom.operators.quantiles import exact_quantiles

#: Points of a range of values that a task orders at once.
RANGE_POINTS = 500_000
#: Values that one of so many rows has are frequent; there are at most so many of a variable.
FREQUENT = 4096
ROW = "v1 string, v2 string, r double, p double, n bigint"


def correlation(a: str, b: str) -> Column:
    """Pearson's r as an aggregate over the rows that have both; null if one of them is constant there, where the built-in one raises."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    sd = F.stddev_pop(F.when(y.isNotNull(), x)) * F.stddev_pop(F.when(x.isNotNull(), y))
    return F.try_divide(F.covar_pop(x, y), sd)


def _pairs(df: DataFrame, variables: list[str], rows: list[tuple]) -> DataFrame:
    return df.sparkSession.createDataFrame(rows, ROW)


def pearson(df: DataFrame, variables: list[str], pairwise: bool = False) -> DataFrame:
    """Rows (v1, v2, r, p, n) of the upper triangle: over complete rows, or ``pairwise`` over each pair's complete rows. One pass."""
    data = df if pairwise else df.dropna(subset=variables)
    pairs = list(combinations(variables, 2))
    exprs = [e for a, b in pairs for e in (correlation(a, b), F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull()))]
    row = data.agg(*exprs).first()
    out = [(a, b, row[2 * i], correlation_p(row[2 * i], row[2 * i + 1]), row[2 * i + 1]) for i, (a, b) in enumerate(pairs)]
    return _pairs(df, variables, out)


def value_ranks(cells: DataFrame, cuts: list[list[float]]) -> DataFrame:
    """Rows (_i, _v, _k, _r): each distinct value of each variable, its count and tie-averaged rank, summed up within the ranges that the cuts make and over those before."""
    bounds = F.array(*[F.array(*[F.lit(x) for x in c]) for c in cuts])
    counts = cells.groupBy("_i", "_v").agg(F.count("*").alias("_k"))
    counts = counts.withColumn("_piece", F.size(F.filter(F.get(bounds, F.col("_i")), lambda x: x <= F.col("_v"))))
    inside = F.sum("_k").over(Window.partitionBy("_i", "_piece").orderBy("_v"))
    totals = counts.groupBy("_i", "_piece").agg(F.sum("_k").alias("_t"))  # one row a variable and range
    before = totals.select("_i", "_piece", (F.sum("_t").over(Window.partitionBy("_i").orderBy("_piece")) - F.col("_t")).alias("_before"))
    return counts.withColumn("_in", inside).join(F.broadcast(before), ["_i", "_piece"]).select("_i", "_v", "_k", (F.col("_before") + F.col("_in") - (F.col("_k") - 1) / 2.0).alias("_r"))


def ranked(df: DataFrame, variables: list[str], ranges: int = 64, frequent: int = FREQUENT) -> DataFrame:
    """Each variable by its tie-averaged rank, of all variables at once, so that the shuffles do not grow with the variables. Nulls must be gone.

    Values that at least one of ``frequent`` rows has are few, and their ranks are broadcast, so rows of few values never move. What is left has no
    frequent value: rows of one such variable are joined with its ranks; cells of several, as (row, variable, value), are joined and gathered by row.
    """
    others = [c for c in df.columns if c not in variables]
    cuts = df.agg(*[F.percentile_approx(F.col(c).cast("double"), [i / ranges for i in range(1, ranges)], ranges * 100).alias(f"_c{i}") for i, c in enumerate(variables)]).first()
    cuts = [sorted({float(x) for x in c or [0.0]}) for c in cuts]
    cell = lambda i: F.struct(F.lit(i).alias("_i"), F.col(variables[i]).cast("double").alias("_v"))
    n = df.count()
    known = value_ranks(df.select(F.inline(F.array(*map(cell, range(len(variables)))))), cuts).where(F.col("_k") >= n / frequent).toPandas()
    rest = [i for i in range(len(variables)) if known[known["_i"] == i]["_k"].sum() < n]
    rows = df
    for i, c in enumerate(variables):
        few = df.sparkSession.createDataFrame(known[known["_i"] == i][["_v", "_r"]].values.tolist(), f"_v{i} double, _r{i} double")
        rows = rows.join(F.broadcast(few), F.col(c).cast("double") == F.col(f"_v{i}"), "left").drop(f"_v{i}")
    of = lambda i: F.col(f"_r{i}").alias(variables[i])
    if not rest:
        return rows.select(*others, *map(of, range(len(variables))))
    ranks = value_ranks(df.select(F.inline(F.array(*map(cell, rest)))), cuts).where(F.col("_k") < n / frequent)
    if len(rest) == 1:
        c = variables[rest[0]]
        rows = rows.join(ranks.select("_v", F.col("_r").alias("_rest")), F.when(F.col(f"_r{rest[0]}").isNull(), F.col(c).cast("double")) == F.col("_v"), "left")
        return rows.withColumn(f"_r{rest[0]}", F.coalesce(f"_r{rest[0]}", "_rest")).select(*others, *map(of, range(len(variables))))
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    head = F.struct(*others, *[f"_r{i}" for i in range(len(variables))])
    open_ = F.filter(F.array(*[F.when(F.col(f"_r{i}").isNull(), cell(i)) for i in rest]), lambda x: x.isNotNull())
    cells = rows.select("_row", F.posexplode_outer(open_).alias("_at", "_cell"), head.alias("_head")).select("_row", "_cell._i", "_cell._v", F.when(F.coalesce("_at", F.lit(0)) == 0, F.col("_head")).alias("_head"))
    joined = cells.join(ranks, ["_i", "_v"], "left").groupBy("_row").agg(F.max("_head").alias("_head"), *[F.max(F.when(F.col("_i") == i, F.col("_r"))).alias(f"_open{i}") for i in rest])
    found = lambda i: F.coalesce(F.col(f"_head._r{i}"), F.col(f"_open{i}")) if i in rest else F.col(f"_head._r{i}")
    return joined.select(*[F.col("_head")[c].alias(c) for c in others], *[found(i).alias(c) for i, c in enumerate(variables)])


def spearman(df: DataFrame, variables: list[str]) -> DataFrame:
    return pearson(ranked(df.dropna(subset=variables).select(*[F.col(c).cast("double").alias(c) for c in variables]), variables), variables)


def kendall(df: DataFrame, variables: list[str]) -> DataFrame:
    """Tau-b over complete rows, whatever the number of distinct values; p by the normal law with tie corrections."""
    data = df.dropna(subset=variables)
    out = []
    for a, b in combinations(variables, 2):
        points = data.groupBy(F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")).agg(F.count("*").alias("n")).persist()
        total = int(points.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
        out.append((a, b, *_tau_b(total, concordant_pairs(points), _tie_sums(points, "x"), _tie_sums(points, "y"), _tie_sums(points, "x", "y")), total))
        points.unpersist()
    return _pairs(df, variables, out)


def _tie_sums(points: DataFrame, *by: str) -> list[int]:
    """Sums over groups of t rows of t (t - 1), t (t - 1) (2 t + 5) and t (t - 1) (t - 2)."""
    t = F.col("t")
    groups = points.groupBy(*by).agg(F.sum("n").cast("decimal(38,0)").alias("t"))
    pair = t * (t - 1)
    terms = [e.cast("decimal(38,0)") for e in (pair, pair * (2 * t + 5), pair * (t - 2))]
    return [int(v or 0) for v in groups.agg(*[F.sum(e) for e in terms]).first()]


def _tau_b(n: int, concordant: int, tx: list[int], ty: list[int], both: list[int]) -> tuple[float | None, float | None]:
    pairs = n * (n - 1)  # every pair counts twice here, as it does in the sums of ties
    nx, ny = pairs - tx[0], pairs - ty[0]
    if not nx or not ny:
        return None, None
    s = 2 * concordant - (pairs - tx[0] - ty[0] + both[0]) // 2  # concordant less discordant pairs
    var = (pairs * (2 * n + 5) - tx[1] - ty[1]) / 18 + tx[0] * ty[0] / (2 * pairs)
    if n > 2:
        var += tx[2] * ty[2] / (9 * pairs * (n - 2))
    return 2 * s / sqrt(nx) / sqrt(ny), (erfc(abs(s) / sqrt(var) / sqrt(2)) if var > 0 else None)


def rising_pairs(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> int:
    """Pairs of weighted points that rise in both x and y, counted bit by bit of the rank of y."""
    order = np.lexsort((-y, x))  # of equal x the higher y goes first, so it never counts
    rank, n, out = np.unique(y, return_inverse=True)[1][order], n[order].astype(np.int64), 0
    for bit in range(int(rank.max(initial=0)).bit_length() - 1, -1, -1):
        order = np.argsort(rank >> (bit + 1), kind="stable")
        group, high, weight = (rank >> (bit + 1))[order], (rank[order] >> bit & 1).astype(bool), n[order]
        lower = np.cumsum(np.where(high, 0, weight))
        start = np.searchsorted(group, group)
        before = lower - np.where(start > 0, lower[start - 1], 0)
        out += int((weight[high].astype(object) * before[high].astype(object)).sum())
    return out


def concordant_pairs(points: DataFrame, most: int = RANGE_POINTS) -> int:
    """Pairs of rows that x and y order alike; points (x, y, n) are distinct and stand for n rows each.

    Both axes are cut into ranges of about ``most`` points, a value at a cut being a range of its own, so a frequent value
    swells no other range. A pair lies in one range of x, else in one range of y, else in two cells that differ in both:
    ranges are counted in one task each, and the cells are points again, far fewer.
    """
    number = points.count()
    ranges = min(ceil(number / most), int(sqrt(number / 8)))  # so there are at most half as many cells as points
    if ranges < 2:
        cuts = ([], [])
    else:
        shares = [i / ranges for i in range(1, ranges)]
        cuts = tuple(sorted(set(c)) for c in points.agg(*[F.percentile_approx(c, shares, ranges * 20) for c in "xy"]).first())
    x_cuts, y_cuts = (np.array(c, float) for c in cuts)

    def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:  # odd: the value of a cut, even: what lies between two cuts
            yield p.assign(i=np.searchsorted(x_cuts, p.x, "left") + np.searchsorted(x_cuts, p.x, "right"), j=np.searchsorted(y_cuts, p.y, "left") + np.searchsorted(y_cuts, p.y, "right"))

    placed = points.select("x", "y", "n").mapInPandas(place, "x double, y double, n bigint, i bigint, j bigint")

    def counted(x: str):
        return lambda g: pd.DataFrame({"pairs": [Decimal(rising_pairs(g[x].to_numpy(), g["y"].to_numpy(), g["n"].to_numpy()))]})

    found = placed.where("i % 2 = 0").groupBy("i").applyInPandas(counted("x"), "pairs decimal(38,0)")
    if ranges < 2:
        return int(found.agg(F.sum("pairs")).first()[0] or 0)
    found = found.unionByName(placed.where("j % 2 = 0").groupBy("j").applyInPandas(counted("i"), "pairs decimal(38,0)"))
    cells = placed.groupBy(F.col("i").cast("double").alias("x"), F.col("j").cast("double").alias("y")).agg(F.sum("n").alias("n")).persist()
    out = int(found.agg(F.sum("pairs")).first()[0] or 0) + concordant_pairs(cells, most)
    cells.unpersist()
    return out


def covariance(df: DataFrame, variables: list[str]) -> DataFrame:
    """Rows (v1, v2, covariance) for all pairs, over complete rows."""
    data = df.dropna(subset=variables)
    cells = [F.struct(F.lit(a).alias("v1"), F.lit(b).alias("v2"), F.covar_samp(F.col(a).cast("double"), F.col(b).cast("double")).alias("covariance")) for a in variables for b in variables]
    return data.agg(F.array(*cells).alias("r")).select(F.inline("r"))


def correlation_summary(pairs: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Pairs by |r|, with whether p is below alpha and the label of a heat map cell."""
    return pairs.withColumn("significant", F.col("p") < alpha).withColumn("label", F.concat(F.format_number("r", 2), F.when(F.col("p") < alpha, "*").otherwise(""))).orderBy(F.desc(F.abs("r")), "v1", "v2")


def top_variables(pairs: DataFrame, n: int = 7) -> DataFrame:
    """The first n distinct variables met along the ranking of pairs by |r|."""
    ranked_ = pairs.withColumn("at", F.row_number().over(Window.orderBy(F.desc(F.abs("r")), "v1", "v2")))
    return ranked_.select("at", F.posexplode(F.array("v1", "v2")).alias("side", "variable")).groupBy("variable").agg(F.min(F.col("at") * 2 + F.col("side")).alias("at")).orderBy("at").limit(n).select("variable")


def one_against_rest(df: DataFrame, variable: str, others: list[str], n: int = 10) -> DataFrame:
    """(variable, r) of the n other variables of highest |r| with one variable, ties by name; pairs without an r go. One pass."""
    rest = [v for v in others if v != variable]
    if not rest:
        return df.sparkSession.createDataFrame([], "variable string, r double")
    row = df.agg(*[correlation(variable, v) for v in rest]).first()
    found = sorted(((v, r) for v, r in zip(rest, row) if r is not None and r == r), key=lambda x: (-abs(x[1]), x[0]))
    return df.sparkSession.createDataFrame(found[:n], "variable string, r double")


def order_statistic(rows: DataFrame, column: str, k: int, n: int) -> float:
    """The k-th smallest (from 1) of n values without nulls, by selection: equal values are counted, never sorted."""
    return exact_quantiles(rows, [], column, [(k - 1) / max(n - 1, 1)], n, [k - 1]).first().q[0]


def _concentrated(x: np.ndarray, h: int, starts: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Location and covariance of the h rows of least determinant that concentration steps reach from random starts."""
    n, p = x.shape
    best = None
    for _ in range(starts):
        pick = rng.choice(n, min(n, p + 1), replace=False)
        for _ in range(100):
            mean, cov = x[pick].mean(0), np.cov(x[pick].T).reshape(p, p)
            d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.pinv(cov), x - mean)
            new = np.sort(np.argsort(d, kind="stable")[:h])
            if np.array_equal(new, pick):
                break
            pick = new
        mean, cov = x[pick].mean(0), np.cov(x[pick].T).reshape(p, p)
        if best is None or np.linalg.det(cov) < best[0]:
            best = (np.linalg.det(cov), mean, cov)
    return best[1:]


def robust_covariance(df: DataFrame, variables: list[str], starts: int = 30, most_rows: int = 20_000, seed: int = 42, steps: int = 50) -> dict:
    """Minimum covariance determinant of all complete rows: location, covariance, correlation, outliers.

    A random sample of at most ``most_rows`` rows only gives the start; concentration steps (until the determinant falls no more, ``steps`` at most),
    the reweighting and the count of outliers are aggregates over all rows. Rows at the distance of the last one taken in are taken in too.
    """
    data = df.dropna(subset=variables).select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(variables)])
    names, p, n = data.columns, len(variables), data.count()
    if n < p + 2:
        raise ValueError("too few complete rows")
    share = min(1.0, most_rows / n * 1.1)
    x = (data.sample(share, seed) if share < 1 else data).orderBy(F.rand(seed)).limit(most_rows).toPandas().to_numpy()
    mean, cov = _concentrated(x, (len(x) + p + 1) // 2, starts, np.random.default_rng(seed))

    def distances(mean: np.ndarray, cov: np.ndarray) -> DataFrame:
        inverse, c = np.linalg.pinv(cov), [F.col(v) - float(m) for v, m in zip(names, mean)]
        terms = [c[i] * c[j] * float(inverse[i, j] * (1 if i == j else 2)) for i in range(p) for j in range(i, p)]
        return data.withColumn("d", sum(terms[1:], terms[0]))

    def of(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        m = moments(rows, names)
        return m.mean, m.scatter / (m.n - 1)

    h, least = (n + p + 1) // 2, np.inf
    for _ in range(steps):
        rows = distances(mean, cov)
        new = of(rows.where(F.col("d") <= order_statistic(rows, "d", h, n)))
        det = np.linalg.det(new[1])
        if det >= least * (1 - 1e-12):
            break
        (mean, cov), least = new, det
    rows = distances(mean, cov)
    median = (order_statistic(rows, "d", (n + 1) // 2, n) + order_statistic(rows, "d", n // 2 + 1, n)) / 2
    cut = F.col("d") * (chi2_quantile(0.5, p) / median) <= chi2_quantile(0.975, p) if median > 0 else F.col("d") <= 0
    mean, cov = of(rows.where(cut))
    sd = np.sqrt(np.diag(cov))
    return {"location": mean, "covariance": cov, "correlation": cov / np.outer(sd, sd), "outliers": rows.where(~cut).count()}


def hull(points: pd.DataFrame) -> pd.DataFrame:
    """Convex hull of (x, y), counter-clockwise from the leftmost point; nothing for fewer than three distinct points."""
    p = sorted(set(zip(points.x, points.y)))
    if len(p) < 3:
        return pd.DataFrame({"vertex": [], "x": [], "y": []})

    def side(seq) -> list:
        out: list = []
        for q in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    h = side(p) + side(p[::-1])
    return pd.DataFrame({"vertex": range(len(h)), "x": [q[0] for q in h], "y": [q[1] for q in h]})


def convex_hulls(df: DataFrame, x: str, y: str, category: str) -> DataFrame:
    """Hull vertices of each category: hulls of salted parts first, so that no task gathers a whole category."""
    rows = df.dropna(subset=[x, y, category]).select(F.col(category).cast("string").alias("category"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), (F.xxhash64(x, y) % 64).alias("salt"))

    def part(key, g: pd.DataFrame) -> pd.DataFrame:
        h = hull(g)
        points = h[["x", "y"]] if len(h) else g[["x", "y"]].drop_duplicates()
        return points.assign(category=key[0])[["category", "x", "y"]]

    corners = rows.groupBy("category", "salt").applyInPandas(part, "category string, x double, y double")
    return corners.groupBy("category").applyInPandas(lambda key, g: hull(g).assign(category=key[0])[["category", "vertex", "x", "y"]].astype({"vertex": "int64"}), "category string, vertex bigint, x double, y double")
