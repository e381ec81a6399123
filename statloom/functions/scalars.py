"""Scalar functions over columns and names: coercion, header names, joins of items, colours, stars and bands."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_number(c: str) -> Column:
    return F.expr(f"try_cast(`{c}` as double)")


def header_names(names: list[str]) -> list[str]:
    """Letters, digits, _ and . only; others become one _, none leads; repeated names get _1, _2, ..."""
    out: list[str] = []
    for n in names:
        base = re.sub(r"_+", "_", re.sub(r"[^A-Za-z0-9_.]", "_", n.strip())).lstrip("_") or "column"
        name, k = base, 0
        while name in out:
            k += 1
            name = f"{base}_{k}"
        out.append(name)
    return out


def join_items(items: Column, separator: str = "\n") -> Column:
    """Items as one text; nulls as empty ones."""
    return F.array_join(F.transform(items, lambda x: F.coalesce(x.cast("string"), F.lit(""))), separator)


def stars(p: Column) -> Column:
    return F.when(p <= 0.001, "***").when(p <= 0.01, "**").when(p <= 0.05, "*").otherwise("")


def subscript(text: Column) -> Column:
    return F.translate(text, "0123456789", "₀₁₂₃₄₅₆₇₈₉")


def superscript(text: Column) -> Column:
    return F.translate(text, "0123456789", "⁰¹²³⁴⁵⁶⁷⁸⁹")


def blue_to_red(x: Column, low: float, high: float) -> Column:
    """rgb(r, 0, b) by place in low..high, kept within it; grey for null, purple for a flat range."""
    u = F.lit(0.5) if low == high else F.least(F.greatest((x - low) / (high - low), F.lit(0.0)), F.lit(1.0))
    return F.when(x.isNull(), "rgb(128,128,128)").otherwise(F.format_string("rgb(%d,0,%d)", F.floor(u * 255), F.floor((1 - u) * 255)))


# Named colours of categories, in order of use, with their red, green and blue.
NAMED_COLOURS = {
    "black": (0, 0, 0), "red": (255, 0, 0), "green": (0, 128, 0), "blue": (0, 0, 255), "orange": (255, 165, 0), "purple": (128, 0, 128), "brown": (165, 42, 42),
    "hotpink": (255, 105, 180), "gray": (128, 128, 128), "olive": (128, 128, 0), "cyan": (0, 255, 255), "magenta": (255, 0, 255), "gold": (255, 215, 0), "navy": (0, 0, 128),
    "darkgreen": (0, 100, 0), "darkred": (139, 0, 0), "indigo": (75, 0, 130), "coral": (255, 127, 80), "teal": (0, 128, 128), "chocolate": (210, 105, 30),
    "crimson": (220, 20, 60), "darkviolet": (148, 0, 211), "darkorange": (255, 140, 0), "darkslategray": (47, 79, 79), "royalblue": (65, 105, 225), "saddlebrown": (139, 69, 19),
}


def category_colour(rank: Column) -> Column:
    """The colour of the rank-th category (from 0, in sorted order): a named one while they last, then golden-angle hues."""
    return F.coalesce(F.get(F.array(*[F.lit(c) for c in NAMED_COLOURS]), rank.cast("int")), F.format_string("hsl(%d, 70%%, 50%%)", ((rank * 137) % 360).cast("int")))


def rgba(name: Column, alpha: float = 0.5) -> Column:
    """A named colour as rgba(r, g, b, alpha); grey for any other name."""
    known = F.create_map(*[F.lit(x) for n, (r, g, b) in NAMED_COLOURS.items() for x in (n, f"rgba({r}, {g}, {b}, {alpha})")])
    return F.coalesce(F.try_element_at(known, F.coalesce(F.lower(name), F.lit(""))), F.lit(f"rgba(128, 128, 128, {alpha})"))


def order_colour(position: Column, n: int) -> Column:
    """Blue to red by place among n rows (position from 0); blue for a single row."""
    if n <= 1:
        return F.lit("rgb(0, 0, 255)")
    u = position / (n - 1)
    return F.format_string("rgb(%d,0,%d)", F.floor(u * 255), F.floor((1 - u) * 255))


def hue(rank: Column) -> Column:
    """A colour for the rank-th category: golden-angle steps round the wheel."""
    return F.format_string("hsl(%d,70%%,50%%)", (rank * 137) % 360)


def metadata_text(columns: list[str], numeric: set[str]) -> Column:
    """'name: value | ...', numbers with two decimals."""
    return F.concat_ws(" | ", *[F.concat(F.lit(f"{c}: "), F.format_string("%.2f", F.col(c).cast("double")) if c in numeric else F.col(c).cast("string")) for c in columns])


def timestamps(row_number: Column, base: str) -> Column:
    """base plus one second for each row."""
    return F.timestamp_add("SECOND", row_number.cast("int"), F.lit(base).cast("timestamp"))
