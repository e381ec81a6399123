"""A table as samples by variables: which columns are variables, which column tells rows apart, and NaN as null."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def clean(df: DataFrame) -> DataFrame:
    """NaN to null in every floating column: Spark's aggregates skip null but not NaN."""
    kinds = (T.DoubleType, T.FloatType)
    return df.select(*[F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name) if isinstance(f.dataType, kinds) else F.col(f.name) for f in df.schema.fields])


@dataclass
class Dataset:
    df: DataFrame
    row_id: str
    variables: list[str] = field(default_factory=list)
    name: str = "data"

    def __post_init__(self) -> None:
        self.df = clean(self.df)
        self.variables = self.variables or [c for c in numeric_columns(self.df) if c != self.row_id]

    @property
    def metadata(self) -> list[str]:
        return [c for c in self.df.columns if c not in {*self.variables, self.row_id}]
