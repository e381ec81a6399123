"""Writers: delimited text, JSON, spectral text, and sets of tables as one folder each."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.dataset import numeric_columns


def write_csv(df: DataFrame, path: str, header: bool = True, separator: str = ",") -> None:
    df.write.mode("overwrite").csv(path, header=header, sep=separator)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def spectral_lines(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One text line per row: cells joined by tabs, missing ones as 0.0."""
    return df.select(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("0.0")) for c in columns or df.columns]).alias("value"))


def write_spectral(df: DataFrame, path: str, header: bool = True) -> None:
    """Text lines, after a block of lines that begin with # and name the columns."""
    body = spectral_lines(df)
    if header:
        head = df.sparkSession.createDataFrame([("# Spectral data",), (f"# Columns: {len(df.columns)}",), ("# " + "\t".join(df.columns),)], "value string").coalesce(1)
        body = head.unionByName(body)
    body.write.mode("overwrite").text(path)


def write_tables(tables: dict[str, DataFrame], path: str, kind: str = "parquet", metadata: dict | None = None) -> list[str]:
    """Each table in its own folder under ``path`` (names cut to 31 characters without []:*?/\\), and metadata.json's content as a table."""
    made = []
    for name, df in tables.items():
        clean = "".join(c for c in name if c not in "[]:*?/\\")[:31]
        writer = df.write.mode("overwrite")
        writer.csv(f"{path}/{clean}", header=True) if kind == "csv" else writer.format(kind).save(f"{path}/{clean}")
        made.append(f"{path}/{clean}")
    if metadata is not None:
        first = next(iter(tables.values()))
        first.sparkSession.createDataFrame([(json.dumps(metadata, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/Metadata")
        made.append(f"{path}/Metadata")
    return made


def statistics_rows(df: DataFrame, statistics: dict[str, dict[str, float]]) -> DataFrame:
    """{column: {statistic: value}} as rows (Column, statistic, value)."""
    return df.sparkSession.createDataFrame([(c, s, None if v is None else float(v)) for c, d in statistics.items() for s, v in d.items()], "Column string, statistic string, value double")


def pareto_tables(ranked: DataFrame, objectives: dict[str, tuple], n_fronts: int = 3) -> dict[str, DataFrame]:
    """Objectives, Statistics, Front_1.. (crowding first) and All_Points (rank, then crowding)."""
    spark = ranked.sparkSession
    out = {"Objectives": spark.createDataFrame([(n, str(s[0])) for n, s in objectives.items()], "objective string, kind string"), "Statistics": ranked.groupBy("pareto_rank").count()}
    for r in range(1, n_fronts + 1):
        out[f"Front_{r}"] = ranked.where(F.col("pareto_rank") == r).orderBy(F.desc("crowding_distance"))
    return out | {"All_Points": ranked.orderBy("pareto_rank", F.desc("crowding_distance"))}


def transposed_csv(df: DataFrame, row_id: str, path: str) -> None:
    from statloom.operators.select import transposed

    write_csv(transposed(df, row_id, [c for c in numeric_columns(df) if c != row_id]), path)
