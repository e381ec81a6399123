"""Contour lines of gridded surfaces as tables.

A grid cell knows its four corners; a level crosses an edge whose ends lie on both sides of it, and a cell with crossings gives pieces from edge to edge with the
higher side on the left. Neighbouring cells name a shared edge alike, so the pieces are links of a list; lines and their order come from doubling
pointers, in as many rounds as the longest line's length has bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.settled import settled

#: Corners of a cell, from its own point on, against the clock; edge i goes from corner i to corner i + 1.
CORNERS = ((0, 0), (1, 0), (1, 1), (0, 1))
#: The point and direction (0: along x, 1: along y) by which both cells know an edge.
EDGES = ((0, 0, 0), (1, 0, 1), (0, 1, 0), (0, 0, 1))
PIECES = "level double, ix bigint, iy bigint, way int, to_ix bigint, to_iy bigint, to_way int, x double, y double, to_x double, to_y double"


def levels_between(rows: DataFrame, n: int = 15, value: str = "z") -> list[float]:
    """n levels that cut the range of a surface evenly."""
    low, high = rows.agg(F.min(value), F.max(value)).first()
    return [] if low is None or low == high else [low + (high - low) * (i + 1) / (n + 1) for i in range(n)]


def pieces(rows: DataFrame, levels: list[float], value: str = "z") -> DataFrame:
    """Directed pieces of the lines: where each starts and ends, by edge and by coordinates. Cells without all four corners have none."""
    at = F.explode(F.array(*[F.struct((F.col("ix") - a).cast("bigint").alias("cx"), (F.col("iy") - b).cast("bigint").alias("cy"), F.lit(i).alias("corner")) for i, (a, b) in enumerate(CORNERS)]))
    seats = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(at.alias("at"), F.struct("x", "y", F.col(value).cast("double").alias("z")).alias("p")).select("at.*", "p")
    corner = lambda i: F.max(F.when(F.col("corner") == i, F.col("p")))
    cells = seats.groupBy("cx", "cy").agg(F.count("*").alias("n"), *[corner(i).alias(f"p{i}") for i in range(4)]).where("n = 4")
    cells = cells.select("cx", "cy", *[F.col(f"p{i}")[c].alias(f"{c}{i}") for i in range(4) for c in "xyz"])

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in parts:
            x, y, z = (g[[f"{c}{i}" for i in range(4)]].to_numpy(float) for c in "xyz")
            cell = g[["cx", "cy"]].to_numpy(np.int64)
            for level in levels:
                high = z > level
                after = np.roll(high, -1, 1)
                start, end = high & ~after, ~high & after  # a line comes in where the higher corner is first
                top = z.mean(1) > level
                with np.errstate(divide="ignore", invalid="ignore"):
                    share = (level - z) / (np.roll(z, -1, 1) - z)
                px, py = x + share * (np.roll(x, -1, 1) - x), y + share * (np.roll(y, -1, 1) - y)
                for i in range(4):
                    # At a saddle the middle tells which corners hang together: a line goes on to the next edge that it can leave by, or to the last.
                    ahead = np.select([end[:, (i + k) % 4] for k in (1, 2, 3)], [(i + k) % 4 for k in (1, 2, 3)], -1)
                    behind = np.select([end[:, (i - k) % 4] for k in (1, 2, 3)], [(i - k) % 4 for k in (1, 2, 3)], -1)
                    some = np.flatnonzero(start[:, i])
                    if not len(some):
                        continue
                    j = np.where(top, ahead, behind)[some]
                    edge, own = np.array(EDGES), cell[some]
                    yield pd.DataFrame(
                        {"level": level, "ix": own[:, 0] + edge[i, 0], "iy": own[:, 1] + edge[i, 1], "way": edge[i, 2], "to_ix": own[:, 0] + edge[j, 0], "to_iy": own[:, 1] + edge[j, 1], "to_way": edge[j, 2], "x": px[some, i], "y": py[some, i], "to_x": px[some, j], "to_y": py[some, j]}
                    )

    return cells.mapInPandas(cut, PIECES)


def _doubled(state: DataFrame, more: dict[str, Column]) -> DataFrame:
    """Each node's jump goes on by the jump of where it leads; other columns are joined with that node's (prefix ``_``)."""
    there = state.select("level", F.col("node").alias("jump"), F.col("jump").alias("_jump"), *[F.col(c).alias(f"_{c}") for c in more])
    return settled(state.join(there, ["level", "jump"], "left").select("level", "node", F.col("_jump").alias("jump"), *[e.alias(c) for c, e in more.items()]))


def chained(links: DataFrame) -> DataFrame:
    """(level, node, line, at, closed) of directed links (level, node, next), at most one from and one to each node: line is the first node, of a ring its least."""
    nodes = settled(links.select("level", "node", "next").unionByName(links.select("level", F.col("next").alias("node"), F.lit(None).cast("string").alias("next"))).groupBy("level", "node").agg(F.max("next").alias("next")))
    most = nodes.groupBy("level").count().agg(F.max("count")).first()[0] or 0
    rings = nodes.select("level", "node", F.col("next").alias("jump"), F.col("node").alias("low"))
    for _ in range(int(most).bit_length()):
        rings = _doubled(rings, {"low": F.least("low", F.coalesce("_low", "low"))})
    rings = rings.where("jump is not null").select("level", "node", "low")
    cut = nodes.join(rings, ["level", "node"], "left").withColumn("open", F.col("next").isNotNull() & ~F.coalesce(F.col("next") == F.col("low"), F.lit(False)))
    before = cut.where("open").select("level", F.col("next").alias("node"), F.col("node").alias("jump"))
    state = settled(cut.select("level", "node", F.col("low").isNotNull().alias("closed")).join(before, ["level", "node"], "left"))
    closed = state.select("level", "node", "closed")
    state = state.select("level", "node", "jump", F.coalesce("jump", "node").alias("line"), F.col("jump").isNotNull().cast("bigint").alias("at"))
    while state.where("jump is not null").count():
        state = _doubled(state, {"line": F.coalesce("_line", "line"), "at": F.col("at") + F.coalesce("_at", F.lit(0))})
    return state.drop("jump").join(closed, ["level", "node"])


def contours(rows: DataFrame, levels: list[float], value: str = "z") -> DataFrame:
    """(level, line, vertex, x, y, closed): the contour lines of a surface (ix, iy, x, y, value), vertices from 0 along each line; a closed line ends where it starts.

    Lines are numbered from 1 within their level, by their first edge. A value equal to a level counts as below it. Points without a value cut
    lines off; a level that nothing crosses has no rows.
    """
    found = settled(pieces(rows, levels, value))
    name = lambda a, b, w: F.concat_ws(":", F.lpad(F.col(a).cast("string"), 12, "0"), F.lpad(F.col(b).cast("string"), 12, "0"), F.col(w).cast("string"))
    links = found.select("level", name("ix", "iy", "way").alias("node"), name("to_ix", "to_iy", "to_way").alias("next"), "x", "y", "to_x", "to_y")
    order = chained(links)
    place = links.select("level", "node", "x", "y").unionByName(links.select("level", F.col("next").alias("node"), F.col("to_x").alias("x"), F.col("to_y").alias("y"))).groupBy("level", "node").agg(F.min(F.struct("x", "y")).alias("p"))
    placed = order.join(place, ["level", "node"])
    sizes = order.groupBy("level", "line").agg(F.count("*").alias("n"))
    numbers = sizes.select("level", "line", "n", F.expr("row_number() over (partition by level order by line)").alias("number"))
    placed = placed.join(numbers, ["level", "line"])
    spots = F.when(F.col("closed") & (F.col("at") == 0), F.array(F.col("at"), F.col("n"))).otherwise(F.array("at"))
    return placed.select("level", F.col("number").cast("int").alias("line"), F.explode(spots).alias("vertex"), "p.x", "p.y", "closed")
