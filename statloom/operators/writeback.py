"""Transformed blocks of columns back in their table, and what a transform changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def transformed_name(dataset: str, code: str) -> str:
    """Name of a transformed dataset: the original's up to its first dot and without _ORIGINAL, a dot, the transform's code."""
    return f"{dataset.split('.')[0].replace('_ORIGINAL', '')}.{code}"


def written_back(df: DataFrame, transformed: DataFrame, row_id: str, old: list[str], new: list[str]) -> DataFrame:
    """``df`` with the neighbouring columns ``old`` replaced by ``new`` of ``transformed``, others before and after them as they are.

    New columns take the first of the old names; a transform may give fewer columns, not more. Rows that it left out go. Rows meet by
    ``row_id``, which must tell them apart.
    """
    at = df.columns.index(old[0])
    if df.columns[at : at + len(old)] != old:
        raise ValueError("the old columns must be neighbours, in their order")
    if len(new) > len(old):
        raise ValueError("a transform gives no more columns than it takes")
    values = transformed.select(F.col(row_id).alias("_id"), *[F.col(c).alias(f"_n{i}") for i, c in enumerate(new)])
    both = df.join(values, F.col(row_id) == F.col("_id"))
    middle = [F.col(f"_n{i}").alias(old[i]) for i in range(len(new))]
    return both.select(*df.columns[:at], *middle, *df.columns[at + len(old) :])


def array_written_back(df: DataFrame, array: str, old: list[str], size: int) -> DataFrame:
    """The same for a row transform held as an array of ``size`` elements beside the row: no rows have to meet."""
    at = df.columns.index(old[0])
    if df.columns[at : at + len(old)] != old:
        raise ValueError("the old columns must be neighbours, in their order")
    if size > len(old):
        raise ValueError("a transform gives no more columns than it takes")
    return df.select(*[c for c in df.columns[:at] if c != array], *[F.get(F.col(array), i).alias(old[i]) for i in range(size)], *[c for c in df.columns[at + len(old) :] if c != array])


def before_and_after(df: DataFrame, row_id: str, old: list[str], array: str) -> DataFrame:
    """(row_id, position, variable, before, after) of profiles before and after a row transform; after is null beyond the transformed ones."""
    cells = [F.struct(F.lit(i + 1).alias("position"), F.lit(c).alias("variable"), F.col(c).cast("double").alias("before"), F.get(F.col(array), i).alias("after")) for i, c in enumerate(old)]
    return df.select(row_id, F.inline(F.array(*cells)))
