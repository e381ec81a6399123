"""Pareto fronts and dominance counts: objectives turned to maximisation, distinct points with their counts, and counting by ranges.

How many points are at least as good as one in all objectives is counted by ranges of each objective. A point in a higher range is better there without a
look at its value, so points higher in all objectives come from a table of cell counts. For each set of objectives, points that share the ranges in
these meet in a group and are compared by value in these and by range in the others. A range of a single value needs no look either, so frequent values
make no large group. No points are broadcast and none go to the driver, only counts of cells.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Points that a task peels at once, and points of which the fronts are peeled in one task.
CHUNK, ONE_TASK = 8192, 30_000
#: Points of a group that shares one range, as far as MOST_CELLS cells allow, and comparisons up to which a group is compared pair by pair.
GROUP, MOST_CELLS, PAIRS = 20_000, 1 << 20, 1 << 28


def objective(name: str, kind: str, target: float | None = None, lower: str | None = None, upper: str | None = None) -> Column:
    """A column to maximise: maximize, minimize, target, threshold_above, threshold_below, and their _ci forms, which use the bound columns."""
    x = F.col(name).cast("double")
    low, high = F.col(lower) if lower else x, F.col(upper) if upper else x
    if kind in ("maximize", "maximize_ci"):
        return low if kind.endswith("ci") else x
    if kind in ("minimize", "minimize_ci"):
        return -(high if kind.endswith("ci") else x)
    if kind == "target":
        return -F.abs(x - target)
    if kind == "target_ci":
        return -(F.abs(x - target) + (high - low) / 2)
    if kind.startswith("threshold_above"):
        return F.least((low if kind.endswith("ci") else x) - target, F.lit(0.0))
    if kind.startswith("threshold_below"):
        return F.least(target - (high if kind.endswith("ci") else x), F.lit(0.0))
    raise ValueError(f"unknown objective {kind}")


def under(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Table of which rows of ``p`` (down) are at least as large as rows of ``q`` (across) in all columns."""
    out = p[:, None, 0] >= q[None, :, 0]
    for j in range(1, p.shape[1]):
        out &= p[:, None, j] >= q[None, :, j]
    return out


def front_mask(m: np.ndarray) -> np.ndarray:
    """Which rows no other row dominates (at least as good in all, better in one). Rows are taken by falling sum, so only front rows can dominate later ones."""
    points, place = np.unique(m, axis=0, return_inverse=True)  # of distinct rows one that is as large in all dominates
    order = np.lexsort((*-points.T[::-1], -points.sum(1)))
    keep, front = np.zeros(len(points), bool), np.zeros((0, m.shape[1]))
    for i in range(0, len(points), 512):
        part = points[order[i : i + 512]]
        alive = np.ones(len(part), bool)
        for j in range(0, len(front), 4096):
            alive &= ~under(front[j : j + 4096], part).any(0)
        above = under(part[alive], part[alive])
        np.fill_diagonal(above, False)
        alive[alive] = ~above.any(0)
        keep[order[i : i + 512]] = alive
        front = np.concatenate([front, part[alive]])
    return keep[place.ravel()]


def peeled(m: np.ndarray, fronts: int) -> np.ndarray:
    """Number of the front of each row, from 1; 0 beyond ``fronts``."""
    rank, left = np.zeros(len(m), np.int64), np.arange(len(m))
    for r in range(1, fronts + 1):
        if not len(left):
            break
        best = front_mask(m[left])
        rank[left[best]] = r
        left = left[~best]
    return rank


def _above(ga: np.ndarray, a: np.ndarray, w: np.ndarray, gq: np.ndarray, q: np.ndarray) -> np.ndarray:
    """For each row of ``q`` the weight of the rows of ``a`` of its group that are at least as large in all columns.

    Two rows in order by the first column differ first in some bit of their places; for each bit, those with it meet
    those without in groups of equal higher bits, compared by the other columns. One column is counted by a search.
    """
    if not len(a) or not len(q):
        return np.zeros(len(q), w.dtype)
    _, key = np.unique(np.r_[ga, gq], return_inverse=True)
    if a.shape[1] == 1:
        _, at = np.unique(np.r_[a[:, 0], q[:, 0]], return_inverse=True)
        place = key * np.int64(at.max() + 1) + at
        own, asked = place[: len(a)], place[len(a) :]
        order = np.argsort(own, kind="stable")
        total = np.r_[np.zeros(1, w.dtype), np.cumsum(w[order])]
        ends = (key[len(a) :] + 1) * np.int64(at.max() + 1)
        return total[np.searchsorted(own[order], ends)] - total[np.searchsorted(own[order], asked)]
    order = np.lexsort((np.r_[np.zeros(len(a)), np.ones(len(q))], -np.r_[a[:, 0], q[:, 0]]))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    out = np.zeros(len(q), w.dtype)
    pa, pq, ka, kq = place[: len(a)], place[len(a) :], key[: len(a)], key[len(a) :]
    for k in range(int(len(order) - 1).bit_length()):
        some, more = (pa >> k & 1) == 0, (pq >> k & 1) == 1
        blocks = np.int64((len(order) >> (k + 1)) + 1)
        out[more] += _above(ka[some] * blocks + (pa[some] >> (k + 1)), a[some, 1:], w[some], kq[more] * blocks + (pq[more] >> (k + 1)), q[more, 1:])
    return out


def weight_above(a: np.ndarray, w: np.ndarray, q: np.ndarray) -> np.ndarray:
    """For each row of ``q`` the weight of the rows of ``a`` that are at least as large in all columns."""
    if a.shape[1] < 3 or len(a) * len(q) > PAIRS:
        return _above(np.zeros(len(a), np.int64), a, w, np.zeros(len(q), np.int64), q)
    out = np.zeros(len(q), w.dtype)
    for i in range(0, len(a), 1024):
        part = a[i : i + 1024]
        at_least = part[:, None, 0] >= q[None, :, 0]
        for j in range(1, a.shape[1]):
            at_least &= part[:, None, j] >= q[None, :, j]
        out += w[i : i + 1024] @ at_least
    return out


def dominators(points: DataFrame, names: list[str], weight: str = "k") -> DataFrame:
    """Rows (names, dominated_by): for each of some distinct points, without nulls, the weight of the points that dominate it."""
    d, n = len(names), points.count()
    ranges = max(1, min(int(MOST_CELLS ** (1 / d)), n // GROUP))
    bounds = []
    for cuts in points.agg(*[F.percentile_approx(c, [i / ranges for i in range(1, ranges)] or [0.5], ranges * 100) for c in names]).first():
        cuts = np.array(cuts if ranges > 1 and cuts else [], float)
        value, times = np.unique(cuts, return_counts=True)
        bounds.append(np.unique(np.r_[value, np.nextafter(value[times > 1], np.inf)]))  # a frequent value is a range of its own
    cells, at = [f"_r{i}" for i in range(d)], [len(b) + 1 for b in bounds]

    def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in parts:
            yield g.assign(**{c: np.searchsorted(b, g[x].to_numpy(float), side="right") for c, x, b in zip(cells, names, bounds)})

    columns = ", ".join(f"`{c}` double" for c in names)
    placed = points.select(*names, F.col(weight).cast("bigint").alias("_w")).mapInPandas(place, f"{columns}, _w bigint, " + ", ".join(f"{c} bigint" for c in cells)).persist()
    alone = []
    for x, c, size in zip(names, cells, at):  # one row a range
        same = np.zeros(size, bool)
        for r in placed.groupBy(c).agg((F.min(x) == F.max(x)).alias("same")).collect():
            same[r[c]] = r.same
        alone.append(same)
    table = np.zeros([size + 1 for size in at], np.int64)  # how much lies in a cell or higher ones
    for r in placed.groupBy(*cells).agg(F.sum("_w").alias("w")).collect():  # one row a cell, MOST_CELLS or so at most
        table[tuple(r[c] for c in cells)] = r.w
    for axis in range(d):
        table = np.flip(np.cumsum(np.flip(table, axis), axis), axis)
    sent = placed.sparkSession.sparkContext.broadcast((table, alone))
    subsets = [s for k in range(1, d + 1) for s in combinations(range(d), k)]

    def deal(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        higher, single = sent.value
        for g in parts:
            place = g[cells].to_numpy(np.int64)
            lone = np.stack([single[i][place[:, i]] for i in range(d)], 1)
            least = place + ~lone  # the ranges from which on another point is as good
            found = higher[tuple(least.T)] - g["_w"].to_numpy(np.int64)
            yield g[names].assign(_w=found, _s=-1, _g=0, **{c: least[:, i] for i, c in enumerate(cells)}, **{f"_l{i}": least[:, i] for i in range(d)})
            for k, s in enumerate(subsets):
                some = ~lone[:, s].any(1)
                key = np.zeros(int(some.sum()), np.int64)
                for i in s:
                    key = key * at[i] + place[some][:, i]
                yield g[names][some].assign(_w=g["_w"][some], _s=k, _g=key, **{c: place[some][:, i] for i, c in enumerate(cells)}, **{f"_l{i}": least[some][:, i] for i in range(d)})

    dealt = placed.mapInPandas(deal, f"{columns}, _w bigint, _s int, _g bigint, " + ", ".join(f"{c} bigint" for c in (*cells, *[f"_l{i}" for i in range(d)])))

    def meet(g: pd.DataFrame) -> pd.DataFrame:
        inside = subsets[int(g["_s"].iloc[0])]
        a = np.stack([g[names[i] if i in inside else cells[i]].to_numpy(float) for i in range(d)], 1)
        q = np.stack([g[names[i] if i in inside else f"_l{i}"].to_numpy(float) for i in range(d)], 1)
        return g[names].assign(_w=weight_above(a, g["_w"].to_numpy(np.int64), q))

    whole = dealt.where("_s < 0").select(*names, "_w")
    met = dealt.where("_s >= 0").groupBy("_s", "_g").applyInPandas(meet, f"{columns}, _w bigint")
    return whole.unionByName(met).groupBy(*names).agg(F.sum("_w").alias("dominated_by"))


def fronts_of(points: DataFrame, columns: list[str], fronts: int) -> DataFrame:
    """Rows (columns, pareto_rank) of the distinct points in the first fronts.

    A point's rank among some of the points is no higher than among all, so tasks first drop what lies beyond the first fronts of the
    points they hold, CHUNK or so at a time; whatever a point of the last of these fronts dominates lies beyond, without a look at the
    others. That is done again with ONE_TASK points a task while it halves them. What is left is peeled in one task if it is at most ONE_TASK points;
    else each front is what no point left dominates, counted by ranges, so the work stays spread however many objectives are in conflict.
    """
    schema = ", ".join(f"`{c}` double" for c in columns)

    def drop(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = beyond = np.zeros((0, len(columns)))
        pieces = (p[columns].to_numpy(float)[i:j] for p in parts for i, j in ((0, 1024), (1024, None)))
        for m in pieces:
            for i in range(0, len(beyond), 32):  # points are distinct
                m = m[~under(beyond[i : i + 32], m).any(0)]
            if not len(m):
                continue
            best = np.concatenate([best, m])
            rank = peeled(best, fronts)
            last = best[rank == fronts]
            beyond, best = last[np.argsort(-last.sum(1), kind="stable")[:256]], best[rank > 0]
            if len(best) > CHUNK:
                yield pd.DataFrame(best, columns=columns)
                best = best[:0]
        yield pd.DataFrame(best, columns=columns)

    def peel(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [p[columns] for p in parts]
        if held:
            every = pd.concat(held)
            yield every.assign(pareto_rank=peeled(every.to_numpy(float), fronts)).query("pareto_rank > 0")

    left = points.select(*columns).distinct().mapInPandas(drop, schema).persist()
    n, before = left.count(), None
    while n > ONE_TASK and (before is None or n <= before / 2):
        held, left = left, left.repartition(ceil(n / ONE_TASK)).mapInPandas(drop, schema).persist()
        before, n = n, left.count()
        held.unpersist()
    if n <= ONE_TASK:
        return left.repartition(1).mapInPandas(peel, schema + ", pareto_rank int")
    found = []
    for rank in range(1, fronts + 1):
        counts = dominators(left.withColumn("k", F.lit(1)), columns).persist()
        found.append(counts.where("dominated_by = 0").select(*columns, F.lit(rank).alias("pareto_rank")))
        left = counts.where("dominated_by > 0").select(*columns)
    return reduce(DataFrame.unionByName, found)


def front(points: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that none dominates; equal points are all kept."""
    return points.join(fronts_of(points, columns, 1).drop("pareto_rank"), columns, "left_semi")


def ranked(df: DataFrame, objectives: dict[str, tuple], n_fronts: int = 3, keep: list[str] | None = None) -> DataFrame:
    """Adds pareto_rank (1..n_fronts, the rest n_fronts + 1), crowding_distance and is_dominated. Rows with a null objective count as the rest."""
    names = [f"_o{i}" for i in range(len(objectives))]
    made = df.withColumns({n: objective(c, *spec) for n, (c, spec) in zip(names, objectives.items())})
    ranks = fronts_of(made.select(*names).dropna(), names, n_fronts)
    out = made.join(ranks, names, "left").withColumn("pareto_rank", F.coalesce("pareto_rank", F.lit(n_fronts + 1)))
    out = out.withColumn("_spread", F.when(F.col("pareto_rank") > n_fronts, F.xxhash64(*names)))
    return out.withColumn("is_dominated", F.col("pareto_rank") > 1).withColumns({"crowding_distance": crowding(names, n_fronts)}).drop(*names, "_spread")


def crowding(columns: list[str], n_fronts: int) -> Column:
    """Sum over objectives of the gap between a point's neighbours in its front over the front's range; null beyond the fronts.

    The two ends of each objective are infinite, in a flat one too, so all points of a front of one or two are.
    Rows beyond the fronts are spread over tasks by ``_spread``.
    """
    parts = []
    for i, c in enumerate(columns):
        w = Window.partitionBy("pareto_rank", "_spread").orderBy(c, *columns[:i], *columns[i + 1 :])
        all_ = Window.partitionBy("pareto_rank", "_spread")
        span = F.max(c).over(all_) - F.min(c).over(all_)
        gap = F.lead(c).over(w) - F.lag(c).over(w)
        parts.append(F.when(gap.isNull(), float("inf")).when(span == 0, 0.0).otherwise(gap / span))
    total = reduce(lambda a, b: a + b, parts)
    return F.when(F.col("pareto_rank") <= n_fronts, total)


def dominance_count(df: DataFrame, row_id: str, objectives: dict[str, tuple]) -> DataFrame:
    """(row_id, dominated_by): how many rows dominate each; rows with a null objective neither count nor are listed."""
    names = [f"o{i}" for i in range(len(objectives))]
    made = df.select(row_id, *[objective(c, *spec).alias(n) for n, (c, spec) in zip(names, objectives.items())]).dropna()
    counts = dominators(made.groupBy(*names).agg(F.count("*").alias("k")), names)
    return made.join(counts, names).select(row_id, "dominated_by")
