"""Operators along a row order, without ever putting the whole table into one task.

Rows get their dense position from ranges of the order key (positions within a range plus the rows of the ranges
before it, a table as long as the number of ranges). Frames then run within blocks of consecutive positions; rows near an edge
are also sent, as guests, to the block that needs them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Ranges of the order, from the rows: one for RANGE_ROWS rows, no fewer and no more than these. Rows of a block.
RANGE_ROWS, FEWEST_RANGES, MOST_RANGES, BLOCK = 1_000_000, 16, 4096, 1 << 20


def _ranges_below(value: Column, bounds: list) -> Column:
    """How many of the sorted bounds are at most the value, by a two-step search; all for null."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    top, full = F.array(*[F.lit(b) for b in bounds[::step]]), F.array(*[F.lit(b) for b in bounds])
    coarse = F.greatest(F.size(F.filter(top, lambda b: b <= value)) - 1, F.lit(0))
    fine = F.size(F.filter(F.slice(full, coarse * step + 1, F.lit(step)), lambda b: b <= value))
    return F.when(value.isNull(), len(bounds)).otherwise(coarse * step + fine)


def range_bounds(df: DataFrame, order: str, range_rows: int = RANGE_ROWS) -> list:
    """Values that cut the rows into ranges of about equal size, as many as their number asks for."""
    shares = ", ".join(f"{i / MOST_RANGES}D" for i in range(1, MOST_RANGES))
    row = df.select(order).agg(F.expr(f"percentile_approx(`{order}`, array({shares}), {MOST_RANGES * 10})"), F.count(order)).first()
    ranges = min(MOST_RANGES, max(FEWEST_RANGES, -(-row[1] // range_rows)))
    cuts = row[0] or []
    return sorted({cuts[i * MOST_RANGES // ranges - 1] for i in range(1, ranges)}) if cuts else []


def with_position(df: DataFrame, order: str, name: str = "position", by: list[str] | None = None) -> DataFrame:
    """Adds the 0-based position of each row in ascending ``order`` (a column whose values are unique; nulls last), with ``by`` within each group.

    Rows are numbered within a range of the order, and of the group, by one task each; the rows of a group's ranges before it are added up from counts.
    """
    by = by or []
    piece = _ranges_below(F.col(order), range_bounds(df, order))
    keys = [*by, "_piece"]
    rows = df.withColumn("_piece", piece)
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).asc_nulls_last())) - 1
    counts = df.select(*dict.fromkeys([*by, order])).withColumn("_piece", piece).groupBy(*keys).agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*by).orderBy("_piece").rowsBetween(Window.unboundedPreceding, 0))
    offsets = counts.select(*keys, (upto - F.col("_n")).alias("_before"))
    if not by:  # one row a range
        placed = rows.withColumn("_at", at).join(F.broadcast(offsets), "_piece")
        return placed.withColumn(name, (F.col("_before") + F.col("_at")).cast("bigint")).drop("_piece", "_at", "_before")
    offsets = offsets.withColumnsRenamed({k: f"_own{i}" for i, k in enumerate(keys)})
    placed = rows.withColumn("_at", at).join(offsets, [F.col(k).eqNullSafe(F.col(f"_own{i}")) for i, k in enumerate(keys)])
    return placed.withColumn(name, (F.col("_before") + F.col("_at")).cast("bigint")).drop("_piece", "_at", "_before", *[f"_own{i}" for i in range(len(keys))])


def over_rows(df: DataFrame, order: str, columns: Callable[[], dict[str, Column]], before: int = 0, after: int = 0, by: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """Adds columns built from expressions over ``rows()``, a window along ``order`` that sees ``before`` and ``after`` rows around each.

    ``columns`` takes the window and gives name to expression. With ``by`` the order runs within each group.
    """
    block = max(block, before + after + 1)
    rows = with_position(df, order, "_pos", by)
    own, at = F.floor(F.col("_pos") / block), F.col("_pos") % block
    seats = [F.struct(own.alias("b"), F.lit(True).alias("own"))]
    guest = lambda d, need: F.when(need, F.struct((own + d).alias("b"), F.lit(False).alias("own")))
    if before:
        seats.append(guest(1, at >= block - before))
    if after:
        seats.append(guest(-1, at < after))
    spread = rows.withColumn("_seat", F.explode(F.filter(F.array(*seats), lambda s: s.isNotNull())))
    made = columns(Window.partitionBy(*(by or []), "_seat.b").orderBy("_pos"))
    return spread.withColumns(made).where("_seat.own").drop("_seat", "_pos")


def differences(df: DataFrame, order: str, variables: list[str], degree: int = 1, by: list[str] | None = None) -> DataFrame:
    """First or second differences down the rows; rows without enough rows before them go."""

    def made(w) -> dict[str, Column]:
        lag = lambda c, k: F.lag(c, k).over(w)
        one = {c: F.col(c) - lag(c, 1) if degree == 1 else F.col(c) - 2 * lag(c, 1) + lag(c, 2) for c in variables}
        return {**one, "_whole": lag(F.lit(1), degree).isNotNull()}

    return over_rows(df, order, made, before=degree, by=by).where("_whole").drop("_whole")


def moving_average(df: DataFrame, order: str, variables: list[str], window: int, by: list[str] | None = None) -> DataFrame:
    """Centred mean of ``window`` rows (an even window reaches one row further back); rows with an incomplete window in any variable go."""
    back, ahead = window // 2, (window - 1) // 2

    def made(w) -> dict[str, Column]:
        frame = w.rowsBetween(-back, ahead)
        whole = [F.count(c).over(frame) == window for c in variables]
        ok = whole[0]
        for x in whole[1:]:
            ok = ok & x
        return {**{c: F.avg(c).over(frame) for c in variables}, "_whole": ok}

    return over_rows(df, order, made, before=back, after=ahead, by=by).where("_whole").drop("_whole")


def segments(df: DataFrame, order: str, category: str) -> DataFrame:
    """Runs of equal category along the order: (segment, category, first, last, n), numbered from 1."""
    flagged = over_rows(df.select(order, category), order, lambda w: {"_new": (~F.lag(category).over(w).eqNullSafe(F.col(category)) | F.lag(F.lit(1)).over(w).isNull()).cast("int")}, before=1)
    starts = with_position(flagged.where("_new = 1").select(F.col(order).alias("first"), F.col(category).alias("category")), "first", "segment")
    placed = running_sum(flagged, order, "_new", "segment")
    ends = placed.groupBy("segment").agg(F.max(order).alias("last"), F.count("*").alias("n"))
    return starts.withColumn("segment", F.col("segment") + 1).join(ends, "segment").select("segment", "category", "first", "last", "n")


def running_sum(df: DataFrame, order: str, value: str, name: str, block: int = BLOCK) -> DataFrame:
    """Adds the sum of ``value`` over all rows up to each row: sums within blocks plus the totals of the blocks before."""
    rows = with_position(df, order, "_pos").withColumn("_b", F.floor(F.col("_pos") / block))
    totals = rows.groupBy("_b").agg(F.sum(value).alias("_t"))
    before = totals.select("_b", F.coalesce(F.sum("_t").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.sum(value).over(Window.partitionBy("_b").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_in", inside).join(F.broadcast(before), "_b").withColumn(name, F.col("_in") + F.col("_before")).drop("_b", "_pos", "_in", "_before")


def trajectory(df: DataFrame, order: str, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """Line pieces (order, x, y, x_next, y_next) from each point to the next along the order."""
    made = over_rows(df, order, lambda w: {"x_next": F.lead(x).over(w), "y_next": F.lead(y).over(w), "_last": F.lead(F.lit(1)).over(w).isNull()}, after=1, by=by)
    return made.where("not _last").select(order, *(by or []), F.col(x).alias("x"), F.col(y).alias("y"), "x_next", "y_next")
